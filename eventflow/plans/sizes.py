"""Input sizes: how many parts to cut rows into, and whether Catalyst will broadcast a side."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Rows are cut into slices of about this many bytes of input files.
SLICE_BYTES = 128 * 1024 * 1024
# Spark gives inputs without files, such as rows from the driver, the largest size there is.
_UNKNOWN = 2**62


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of all inputs the plan reads, from file sizes; None if unknown.

    Leaves are summed, so estimates of joins and filters play no part.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
        total = 0
        while leaves.hasNext():
            total += int(str(leaves.next().stats().sizeInBytes()))
        return total
    except AttributeError:  # Spark Connect has no JVM handle
        return None


def slices_for(df: DataFrame) -> int:
    """Slices for the size of the input, if known, and no fewer than shuffles have partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    if size is None or size >= _UNKNOWN:
        return least
    return max(least, -(-size // SLICE_BYTES))


def will_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's own estimate of these rows lies below its broadcast threshold."""
    try:
        plan = df._jdf.queryExecution()
        limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        return int(str(plan.optimizedPlan().stats().sizeInBytes())) <= limit
    except AttributeError:  # Spark Connect has no JVM handle
        return False
