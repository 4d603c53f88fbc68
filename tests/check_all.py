"""Compare all queries with their SQL: python tests/check_all.py <folder> [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from oracle import difference, duck  # noqa: E402

from eventflow.session import build_session  # noqa: E402


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("eventflow-check", "local[8]", 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failed = duck(folder), entry.oracle_sql(), 0
    queries = entry.queries()
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, connection, oracles[name])
            else:
                problem = None if df.count() else "no rows"
            state = "ok" if problem is None else f"FAILED {problem}"
        except Exception:
            state = "ERROR " + traceback.format_exc()[-1500:]
        failed += state != "ok"
        print(f"{name}: {time.time() - started:.1f}s {state}", flush=True)
    print("failed", failed, "without SQL", sorted(set(queries) - set(oracles)))
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
