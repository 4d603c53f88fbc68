"""End-to-end latency of a streaming query: first arrivals, log and profile.

A result row arrives when its micro-batch is written. Only the first arrival of
each result time matters to the log.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.functions.timing import Duration
from eventflow.operators.latency import latency_log, latency_profile, profile_lines
from eventflow.operators.shaping import before, comma_lines, ticker_suffix
from eventflow.operators.windows import sliding_count
from eventflow.session import checkpoint_root, use_rocksdb_state
from eventflow.sinks.files import write_lines
from eventflow.sources.small import names_in, read_text, write_text
from eventflow.streaming.running import start


def trade_monitor(
    trades: DataFrame,
    size: Duration,
    slide: Duration,
    suffix: str | None = "AA",
    method: str = "auto",
) -> DataFrame:
    """Trades per ticker and sliding window, for tickers that end in ``suffix``.

    The filter is on the key, so Spark applies it before anything is counted.
    """
    counts = sliding_count(trades, "time", "ticker", size, slide, method)
    return counts if suffix is None else ticker_suffix(counts, suffix)


def measure(
    results: DataFrame,
    ts: str,
    mode: str = "append",
    folder: str | None = None,
    clock: Callable[[int], int] | None = None,
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """Run a streaming query over its available input; ``ts, arrival`` of its result times.

    A micro-batch is stamped after its rows are written, whole, under ``folder``: whatever work a row
    needs is in its latency. ``clock`` gives the time of the stamp of a micro-batch, in microseconds;
    without it the clock is the driver's. A repeated micro-batch is stamped again, later. ``finish``
    ends the inputs (see ``run_to_table``).
    """
    spark = results.sparkSession
    use_rocksdb_state(spark)
    root = folder or f"{checkpoint_root(spark)}/measured-{uuid.uuid4().hex}"
    now = clock or (lambda _: time.time_ns() // 1000)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch_id={number}")
        write_text(spark, f"{root}/stamps/{number}", str(now(number)))

    for ending in (None, finish):
        if ending is not None:
            ending()
        start(results, write, f"{root}/checkpoint", mode).awaitTermination()
        if finish is None:
            break
    numbers = [n for n in names_in(spark, f"{root}/stamps") if n.isdigit()]
    stamps = [(int(n), int(read_text(spark, f"{root}/stamps/{n}"))) for n in numbers]
    stamped = spark.createDataFrame(stamps, "stamped bigint, at bigint")
    if not stamps:
        return results.sparkSession.createDataFrame([], "ts timestamp, arrival timestamp")
    shape = T.StructType([*results.schema.fields, T.StructField("batch_id", T.LongType())])
    seen = spark.read.schema(shape).parquet(f"{root}/rows").select(F.col(ts).alias("ts"), "batch_id").distinct()
    met = seen.join(stamped, F.col("batch_id") == F.col("stamped"))
    return met.select("ts", F.timestamp_micros("at").alias("arrival"))


def write_report(arrivals: DataFrame, path: str, warmup_ms: int, total_ms: int) -> None:
    """Write ``<path>/log`` (lines ``elapsed,latency``) and ``<path>/histogram`` (the profile)."""
    log = latency_log(arrivals, "ts", "arrival")
    lines = comma_lines(before(log, "elapsed_ms", total_ms), "elapsed_ms", "latency_ms")
    write_lines(lines, f"{path}/log")
    profile = latency_profile(log, warmup_ms, total_ms).orderBy("percentile").coalesce(1)
    write_lines(profile_lines(profile), f"{path}/histogram")
