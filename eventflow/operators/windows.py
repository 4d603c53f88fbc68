"""Event-time windows: sliding, tumbling, keyed, global, and windows over window results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventflow.functions.timing import (
    Duration,
    as_interval,
    epoch_micros_text,
    from_epoch_micros,
    micros_of,
    time_type,
)

# Up to this many windows per row, copying the row beats building panes.
DIRECT_RATIO = 8
# Slots of one key handled together when windows are built from panes.
CHUNK_SLOTS = 4096


def with_event_time(df: DataFrame, ts: str = "ts", lag: Duration = "0 seconds") -> DataFrame:
    """Event time from the record, allowing ``lag`` of disorder.

    Watermarks need a timestamp with zone, so zone-less times are cast.
    """
    if time_type(df, ts) != "timestamp":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, as_interval(lag))


def slot_of(df: DataFrame, ts: str, width: int) -> Column:
    """Number of the ``width`` microseconds wide slot the event time falls into."""
    micros = epoch_micros_text(df, ts)
    return F.expr(f"({micros} - pmod({micros}, {width})) div {width}")


def window_bounds(
    first_slot: Column, slide: int, size: int, type_name: str
) -> tuple[Column, Column]:
    start = first_slot * slide
    return (
        from_epoch_micros(start, type_name).alias("window_start"),
        from_epoch_micros(start + size, type_name).alias("window_end"),
    )


def pane_method(method: str, width: int, step: int) -> str:
    if method != "auto":
        return method
    return "panes" if width % step == 0 and width // step > DIRECT_RATIO else "direct"


def sliding_count(
    df: DataFrame,
    ts: str,
    keys: Sequence[str] | str,
    size: Duration,
    slide: Duration | None = None,
    method: str = "auto",
) -> DataFrame:
    """Rows per key in every window: ``window_start, window_end, <keys>, n``.

    ``method`` is ``direct`` (each row is copied into its windows), ``panes``
    (rows are counted per slide-wide pane first) or ``auto``. A slide equal to
    the size, or left out, gives tumbling windows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    width, step = micros_of(size), micros_of(size if slide is None else slide)
    divides = width % step == 0
    method = pane_method(method, width, step)
    if method == "panes":
        if not divides:
            raise ValueError("panes need a slide that divides the window size")
    elif method != "direct":
        raise ValueError("method must be auto, direct or panes")
    if df.isStreaming:
        return flat_window(window_counts(df, ts, keys, size, slide, method))
    if method == "panes":
        return _count_by_panes(df, ts, keys, width, step)
    if not divides:
        return flat_window(window_counts(df, ts, keys, size, slide, "direct"))
    counted = (
        _copy_to_windows(df.select(ts, *keys), ts, width, step)
        .groupBy("__slot", *keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bounds = window_bounds(F.col("__slot"), step, width, time_type(df, ts))
    return counted.select(*bounds, *keys, "n")


def sliding_total(
    df: DataFrame, ts: str, size: Duration, slide: Duration | None = None, method: str = "auto"
) -> DataFrame:
    """Rows in every window, without a key."""
    return sliding_count(df, ts, [], size, slide, method)


def tumbling_count(df: DataFrame, ts: str, keys: Sequence[str] | str, size: Duration) -> DataFrame:
    return sliding_count(df, ts, keys, size)


def with_arrival(df: DataFrame, name: str = "arrival") -> DataFrame:
    """The time a row comes in: on a stream, that of its micro-batch."""
    return df.withColumn(name, F.current_timestamp())


def arrival_window_count(
    df: DataFrame, arrival: str, keys: Sequence[str] | str, size: Duration, slide: Duration
) -> DataFrame:
    """Sliding counts by the time rows came in rather than by their event time."""
    return sliding_count(df, arrival, keys, size, slide)


def window_counts(
    df: DataFrame,
    ts: str,
    keys: Sequence[str],
    size: Duration,
    slide: Duration | None = None,
    method: str = "direct",
) -> DataFrame:
    """Counts with Spark's ``window`` struct, which further windows can build on."""
    width, step = as_interval(size), as_interval(size if slide is None else slide)
    if method == "panes":
        panes = (
            df.groupBy(F.window(ts, step), *keys)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.window_time("window").alias("__pane_time"), *keys, "n")
        )
        return panes.groupBy(F.window("__pane_time", width, step), *keys).agg(
            F.sum("n").alias("n")
        )
    return df.groupBy(F.window(ts, width, step), *keys).agg(F.count(F.lit(1)).alias("n"))


def flat_window(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *rest,
    )


def top_n_per_window(
    counts: DataFrame, key: str, n: int, value: str = "n", rank: str = "rank"
) -> DataFrame:
    """The ``n`` largest values of each window, ties by lowest key.

    Ranking with a limit lets Spark drop all but ``n`` rows per window and task
    before the shuffle, so no task receives a whole window.
    """
    best = Window.partitionBy("window_end").orderBy(F.col(value).desc(), F.col(key))
    ranked = counts.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= n)
    return ranked.select("window_start", "window_end", rank, key, value)


def _copy_to_windows(df: DataFrame, ts: str, width: int, step: int) -> DataFrame:
    """Each row once per window, with the slot the window starts at in ``__slot``."""
    ratio = width // step
    pane = df.where(F.col(ts).isNotNull()).withColumn("__slot", slot_of(df, ts, step))
    if ratio == 1:
        return pane
    return pane.withColumn(
        "__slot", F.explode(F.sequence(F.col("__slot") - (ratio - 1), F.col("__slot")))
    )


def _count_by_panes(
    df: DataFrame, ts: str, keys: list[str], width: int, step: int
) -> DataFrame:
    """Window counts from pane counts without copying panes into windows.

    A pane adds its count to ``ratio`` consecutive windows: +n at the first and
    -n after the last. Running sums of these steps are the window counts, and a
    sum holds until the next step. Slots are cut into chunks so that a key's
    time line is spread over tasks; a pane touches two chunks at most.
    """
    ratio = width // step
    chunk = max(CHUNK_SLOTS, ratio)
    panes = (
        df.where(F.col(ts).isNotNull())
        .select(slot_of(df, ts, step).alias("__pane"), *keys)
        .groupBy(*keys, "__pane")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    begin, end = F.col("__begin"), F.col("__end")
    first = F.expr(f"(__begin - pmod(__begin, {chunk})) div {chunk}")
    last = F.expr(f"(__end - 1 - pmod(__end - 1, {chunk})) div {chunk}")

    def change(at_chunk: Column, slot: Column, n: Column) -> Column:
        return F.struct(at_chunk.alias("chunk"), slot.alias("slot"), n.alias("change"))

    minus = -F.col("n")
    steps = F.when(
        first == last,
        F.array(change(first, begin, F.col("n")), change(first, end, minus)),
    ).otherwise(
        F.array(
            change(first, begin, F.col("n")),
            change(last, last * chunk, F.col("n")),
            change(last, end, minus),
        )
    )
    changes = (
        panes.withColumn("__begin", F.col("__pane") - (ratio - 1))
        .withColumn("__end", F.col("__pane") + 1)
        .select(*keys, F.explode(steps).alias("s"))
        .select(*keys, "s.chunk", "s.slot", "s.change")
    )
    line = Window.partitionBy(*keys, "chunk").orderBy("slot")
    chunk_end = (F.col("chunk") + 1) * chunk
    held = (
        changes.withColumn(
            "n",
            F.sum("change").over(
                line.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("until", F.coalesce(F.lead("slot").over(line), chunk_end))
        .where((F.col("n") > 0) & (F.col("until") > F.col("slot")))
        .withColumn("__slot", F.explode(F.sequence(F.col("slot"), F.col("until") - 1)))
    )
    bounds = window_bounds(F.col("__slot"), step, width, time_type(df, ts))
    return held.select(*bounds, *keys, "n")
