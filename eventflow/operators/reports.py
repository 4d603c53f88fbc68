"""Source reports: throughput, worst delay, gaps, watermark delay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.functions.timing import (
    Duration,
    as_interval,
    epoch_micros,
    epoch_millis,
    floor_to_grid,
    micros_of,
    time_type,
)
from eventflow.operators.windows import flat_window, slot_of, window_bounds
from eventflow.plans.prefix import running, trailing


def batch_max_latency(df: DataFrame, batch: str | Column, latency: str = "latency_ms") -> DataFrame:
    """Highest latency of each fetched batch, not below 0."""
    key = F.col(batch) if isinstance(batch, str) else batch
    return df.groupBy(key.alias("batch")).agg(
        F.greatest(F.max(latency), F.lit(0)).alias("max_latency_ms")
    )


def throughput_report(
    df: DataFrame,
    ts: str,
    producer: str,
    period: Duration,
    delay: str | None = None,
    at_least: float | None = None,
) -> DataFrame:
    """Rows per second and worst delay per producer and reporting period.

    ``at_least`` keeps the periods with that many rows per second or more.
    """
    width = micros_of(period)
    measures = [F.count(F.lit(1)).alias("n")]
    if delay is not None:
        measures.append(F.max(delay).alias("worst_delay_ms"))
    if df.isStreaming:
        counted = flat_window(
            df.groupBy(F.window(ts, as_interval(period)), producer).agg(*measures)
        )
    else:
        bounds = window_bounds(F.col("__slot"), width, width, time_type(df, ts))
        counted = (
            df.where(F.col(ts).isNotNull())
            .withColumn("__slot", slot_of(df, ts, width))
            .groupBy("__slot", producer)
            .agg(*measures)
        )
        rest = [c for c in counted.columns if c != "__slot"]
        counted = counted.select(*bounds, *rest)
    report = counted.withColumn("per_second", F.col("n") / F.lit(width / 1_000_000))
    return report if at_least is None else report.where(F.col("per_second") >= at_least)


def gaps(
    df: DataFrame,
    ts: str,
    keys: Sequence[str] | str,
    threshold_ms: int = 10,
    order: Sequence[str] = (),
    spread: bool | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Rows that come more than ``threshold_ms`` after the previous row of their key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    options = {} if block_rows is None else {"block_rows": block_rows}
    rows = df.select(
        *keys, ts, *[c for c in order if c not in (ts, *keys)], epoch_micros(df, ts).alias("__t")
    )
    seen = trailing(
        rows,
        keys,
        ["__t", *order],
        -1,
        -1,
        lambda frame: {"__previous": F.max("__t").over(frame)},
        spread,
        **options,
    )
    gap = F.expr("(__t - __previous) div 1000")
    return seen.withColumn("gap_ms", gap).where(F.col("gap_ms") > threshold_ms).select(
        *keys, ts, "gap_ms"
    )


def watermark_delay(
    df: DataFrame,
    ts: str,
    arrival: str,
    grid_ms: int = 1,
    limit_ms: int = 20,
    spread: bool | None = None,
) -> DataFrame:
    """How far the watermark is behind the clock when each row comes in.

    The watermark is the highest event time so far (rows in order of arrival,
    then event time), floored to ``grid_ms``; ``behind`` flags delays above the
    limit. For a running stream see its progress report.
    """
    rows = df.withColumns(
        {"__t": epoch_millis(df, ts), "__a": epoch_millis(df, arrival)}
    )
    seen = running(
        rows, [], [arrival, ts], {"__high": ("max", F.col("__t"))}, spread
    )
    mark = floor_to_grid(F.col("__high"), grid_ms)
    delay = F.col("__a") - mark
    return seen.select(
        *df.columns,
        mark.alias("watermark_ms"),
        delay.alias("delay_ms"),
        (delay > limit_ms).alias("behind"),
    )
