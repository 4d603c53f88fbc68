"""Latency samples, profiles, alerts and statistics of latency logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventflow.functions.timing import epoch_micros, epoch_millis, time_on_day
from eventflow.functions.values import whole_number, without_last_char
from eventflow.operators.shaping import split_fields
from eventflow.plans.prefix import running
from eventflow.session import pin

# Fixed value: the profile reports five steps for each halving of the rest up to 100 %.
TICKS_PER_HALVING = 5
# Counts are bigint, so 63 halvings pass every possible share.
_HALVINGS = 63


def latency_log(
    df: DataFrame, ts: str, arrival: str, spread: bool | None = None
) -> DataFrame:
    """First arrival of every new highest timestamp: ``elapsed_ms, latency_ms``.

    Rows are taken in order of (arrival, ts); a row counts if its timestamp is
    above all earlier ones. That is the same as: no larger timestamp arrived
    earlier, which needs only the first arrival of each distinct timestamp.
    """
    first = (
        df.select(epoch_micros(df, ts).alias("__t"), epoch_micros(df, arrival).alias("__a"))
        .groupBy("__t")
        .agg(F.min("__a").alias("__a"))
    )
    if spread is not False:
        first = pin(first)
    start = first.agg(F.min_by("__t", F.struct("__a", "__t")).alias("start")).scalar()
    flagged = running(
        first, [], [F.col("__t").desc()], {"__earliest": ("min", F.col("__a"))}, spread
    )
    new_highest = flagged.where(F.col("__a") == F.col("__earliest")).withColumn("__start", start)
    return new_highest.select(
        F.expr("__t div 1000 - __start div 1000").alias("elapsed_ms"),
        no_skew(F.expr("__a div 1000 - __t div 1000")).alias("latency_ms"),
    )


def no_skew(latency: Column) -> Column:
    """-1 ms is clock skew and becomes 0; anything lower is an error."""
    return (
        F.when(latency >= 0, latency)
        .when(latency == -1, F.lit(0).cast("bigint"))
        .when(
            latency.isNotNull(),
            F.raise_error(F.concat(F.lit("negative latency: "), latency.cast("string"))),
        )
    )


def record_latency(df: DataFrame, ts: str, arrival: str) -> DataFrame:
    """Latency of every row, with the other columns kept."""
    return df.withColumn("latency_ms", epoch_millis(df, arrival) - epoch_millis(df, ts))


def latency_alerts(log: DataFrame, threshold: int) -> DataFrame:
    return log.where(F.col("latency_ms") >= threshold)


def phase_of(elapsed: Column, warmup: int, total: int) -> Column:
    """Whether a sample falls into the warm-up, the measurement or after it."""
    return (
        F.when(elapsed < warmup, "warming up")
        .when(elapsed < total, "measuring")
        .otherwise("done")
    )


def measured_histogram(log: DataFrame, warmup: int, total: int) -> DataFrame:
    """Samples per latency after the warm-up, up to and including the first at or past ``total``.

    One pass: all later samples fall into one group of which only the first counts.
    """
    grouped = (
        log.where(F.col("elapsed_ms") >= warmup)
        .groupBy(F.when(F.col("elapsed_ms") < total, F.col("latency_ms")).alias("latency"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("latency_ms", "elapsed_ms").alias("first"),
        )
    )
    late = F.col("latency").isNull()
    return (
        grouped.select(
            F.coalesce("latency", "first").alias("latency_ms"),
            F.when(late, F.lit(1).cast("bigint")).otherwise(F.col("n")).alias("n"),
        )
        .groupBy("latency_ms")
        .agg(F.sum("n").alias("n"))
    )


def latency_profile(
    log: DataFrame,
    warmup: int,
    total: int,
    ticks: int = TICKS_PER_HALVING,
    spread: bool | None = None,
) -> DataFrame:
    """Percentile table: ``latency_ms, percentile, total_count, inverse``.

    Percentile levels get denser towards 1; each shows the lowest latency that
    reaches it. The last row is the maximum at percentile 1, whose inverse
    1 / (1 - p) is null. Latencies are not rounded.
    """
    counts = measured_histogram(log, warmup, total)
    if spread is not False:
        counts = pin(counts)
    ranked = running(
        counts, [], ["latency_ms"], {"total_count": ("sum", F.col("n"))}, spread
    )
    everything = counts.agg(F.sum("n").alias("all")).scalar()
    with_share = ranked.withColumn("__all", everything).withColumns(
        {
            "__to": 100.0 * F.col("total_count") / F.col("__all"),
            "__from": 100.0 * (F.col("total_count") - F.col("n")) / F.col("__all"),
        }
    )
    at_end = F.col("total_count") == F.col("__all")
    lowest = F.col("total_count") == F.col("n")
    levels = F.array(*[F.lit(p) for p in profile_levels(ticks)])
    reached = F.filter(
        levels,
        lambda p: (p <= F.col("__to")) & ((p > F.col("__from")) | (lowest & (p == 0.0))),
    )
    # Past the maximum only one level is shown before the closing 100 %.
    shown = F.when(
        at_end, F.concat(F.slice(reached, 1, 1), F.array(F.lit(100.0)))
    ).otherwise(reached)
    rows = with_share.select("latency_ms", "total_count", F.explode(shown).alias("__p"))
    return rows.select(
        "latency_ms",
        (F.col("__p") / 100.0).alias("percentile"),
        "total_count",
        F.when(F.col("__p") < 100.0, 100.0 / (100.0 - F.col("__p"))).alias("inverse"),
    )


def profile_levels(ticks: int = TICKS_PER_HALVING) -> list[float]:
    """Percentile levels in per cent: each half of the rest is cut into ``ticks`` steps."""
    return [
        100.0 * (1.0 - 0.5**h) + j * (50.0 / ticks) * 0.5**h
        for h in range(_HALVINGS)
        for j in range(ticks)
        if 100.0 * (1.0 - 0.5**h) + j * (50.0 / ticks) * 0.5**h < 100.0
    ]


def histogram(log: DataFrame, column: str = "latency_ms") -> DataFrame:
    """Samples per latency. Histograms of several workers add up in ``merge_histograms``."""
    return log.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(partial: DataFrame, column: str = "latency_ms") -> DataFrame:
    return partial.groupBy(column).agg(F.sum("n").alias("n"))


def profile_lines(profile: DataFrame) -> DataFrame:
    """The profile as text: four columns apart by blanks, three in the closing line."""
    head = F.format_string(
        "%12.3f %2.12f %10d",
        F.col("latency_ms").cast("double"),
        F.col("percentile"),
        F.col("total_count"),
    )
    tail = F.format_string(" %14.2f", F.col("inverse"))
    return profile.select(
        F.when(F.col("inverse").isNull(), head).otherwise(F.concat(head, tail)).alias("value")
    )


def parse_profile(lines: DataFrame, column: str = "value") -> DataFrame:
    """Profile text back to columns; comments and short lines are left out."""
    parts = F.split(F.trim(F.col(column)), " +")
    return (
        lines.where(~F.col(column).startswith("#"))
        .select(parts.alias("p"))
        .where(F.size("p") == 4)
        .select(
            F.col("p")[0].try_cast("double").alias("latency_ms"),
            F.col("p")[1].try_cast("double").alias("percentile"),
            F.col("p")[2].try_cast("bigint").alias("total_count"),
            F.col("p")[3].try_cast("double").alias("inverse"),
        )
        .where(F.col("latency_ms").isNotNull() & F.col("inverse").isNotNull())
    )


def latency_log_stats(
    lines: DataFrame,
    day: str,
    n_fields: int = 5,
    column: str = "value",
    observation: Observation | None = None,
) -> DataFrame:
    """Count, min, max and average latency per log time; newest first when sorted by ``time``.

    Field 0 is a local time on ``day``, the last field the latency in ms.
    """
    fields = split_fields(lines, n_fields, column, observation)
    samples = fields.select(
        time_on_day(day, F.col("fields")[0]).alias("time"),
        whole_number(F.col("fields")[n_fields - 1]).alias("latency_ms"),
    )
    return _stats(samples)


def folder_log_stats(
    lines: DataFrame, n_fields: int = 3, observation: Observation | None = None
) -> DataFrame:
    """Statistics per ``t-<ms>`` folder: lines ``(key,count,latency)`` with their ``batch_ms``."""
    fields = split_fields(lines, n_fields, "value", observation)
    samples = fields.select(
        F.timestamp_millis("batch_ms").alias("time"),
        whole_number(without_last_char(F.col("fields")[n_fields - 1])).alias("latency_ms"),
    )
    return _stats(samples)


def newest_first(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.col("time").desc())


def latency_log_summary(stats: DataFrame) -> DataFrame:
    """Lowest, highest and unweighted mean of the statistics; -1 where there are none."""
    none = F.lit(-1).cast("bigint")
    return stats.agg(
        F.coalesce(F.avg("avg_ms").cast("bigint"), none).alias("avg_ms"),
        F.coalesce(F.min("min_ms"), none).alias("min_ms"),
        F.coalesce(F.max("max_ms"), none).alias("max_ms"),
    )


def _stats(samples: DataFrame) -> DataFrame:
    return samples.groupBy("time").agg(
        F.count("latency_ms").alias("n"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.avg("latency_ms").alias("avg_ms"),
    )
