"""Text, tab- and comma-separated files, per-batch folders, fan-out and looking at rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from eventflow.sources.small import names_in, read_text, write_text


def run_path(base: str, run_id: int | None = None) -> str:
    """A path of its own for each run: the base and the current ms, or a given run number."""
    return f"{base}_{int(time.time() * 1000) if run_id is None else run_id}"


def write_lines(
    df: DataFrame, path: str, checkpoint: str | None = None, column: str = "value"
) -> DataStreamWriter | None:
    """Lines to text files. Batch: written at once. Stream: a writer, ready to start."""
    lines = df.select(F.col(column).alias("value"))
    if not df.isStreaming:
        lines.write.mode("errorifexists").text(path)
        return None
    return _appending(lines, checkpoint).format("text").option("path", path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Key, tab, value: nothing is quoted."""
    text = F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])
    df.select(text.alias("value")).write.mode("errorifexists").text(path)


def write_csv(
    df: DataFrame, path: str, single: bool = False, checkpoint: str | None = None
) -> DataStreamWriter | None:
    """CSV files; ``single`` asks for one file and so for one writing task."""
    if df.isStreaming:
        return _appending(df, checkpoint).format("csv").option("path", path)
    (df.coalesce(1) if single else df).write.mode("errorifexists").csv(path)
    return None


def write_per_batch(
    df: DataFrame,
    prefix: str,
    checkpoint: str,
    batch_millis: Callable[[int], int] | None = None,
) -> DataStreamWriter:
    """One folder ``<prefix>/t-<ms>`` per micro-batch.

    ``batch_millis`` gives the time of a batch number. It should depend on the
    number alone, so that a repeated batch overwrites its own folder. Without it
    the clock is read once per batch and written down beside the checkpoint first.
    """
    lines = df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]).alias("value"))

    def first_time(spark: SparkSession, batch_id: int) -> int:
        folder = f"{checkpoint}-times"
        if str(batch_id) not in names_in(spark, folder):
            write_text(spark, f"{folder}/{batch_id}", str(int(time.time() * 1000)))
        return int(read_text(spark, f"{folder}/{batch_id}"))

    def write(batch: DataFrame, batch_id: int) -> None:
        millis = batch_millis(batch_id) if batch_millis else first_time(batch.sparkSession, batch_id)
        batch.write.mode("overwrite").text(f"{prefix}/t-{millis}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def fan_out(
    df: DataFrame, checkpoint: str, *writers: Callable[[DataFrame, int], None]
) -> DataStreamWriter:
    """One stream, several sinks: each micro-batch is computed once and given to all."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for writer in writers:
                writer(kept, batch_id)
        finally:
            kept.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def peek(
    df: DataFrame, observation: Observation | str = "peek", **metrics: Column
) -> DataFrame:
    """Watch rows pass by: their number and any given metrics, without another pass."""
    watched = [F.count(F.lit(1)).alias("rows")]
    watched += [column.alias(name) for name, column in metrics.items()]
    return df.observe(observation, *watched)


def print_rows(df: DataFrame) -> StreamingQuery:
    """Start a stream that prints its rows on the driver."""
    return df.writeStream.format("console").option("truncate", "false").start()


def _appending(df: DataFrame, checkpoint: str | None) -> DataStreamWriter:
    if checkpoint is None:
        raise ValueError("a stream needs a checkpoint folder")
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
