"""Text, tables, trade messages and latency logs as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventflow.functions.codec import decode_trade
from eventflow.session import pin
from eventflow.sinks.tables import read_keyed

TOPIC = "trades"


def read_lines(
    spark: SparkSession,
    path: str | Sequence[str],
    stream: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Text lines in column ``value``; several paths are read one after the other."""
    if not stream:
        return spark.read.text(path if isinstance(path, str) else list(path))
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)


def read_lines_with_offset(
    spark: SparkSession, path: str | Sequence[str], spread: bool | None = None
) -> DataFrame:
    """Lines keyed by file and byte offset: ``path, offset, line``.

    Lines end with LF or CR LF. Files are read twice: first the sizes
    of the splits, a row each, are summed up per file and written; then each task counts on from where its split
    starts. No line is shuffled while the table of splits is below Spark's broadcast threshold. Where the first line of a split stands depends on the split's start alone, so it does no
    harm if the second reading splits otherwise, as long as the first one knows its starts; else the
    reading fails. ``spread`` is accepted from earlier callers and changes nothing.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path if isinstance(path, str) else list(path))
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("value").cast("binary").alias("line"),
        )
    )
    sizes = lines.groupBy("path", "split").agg(F.sum(F.octet_length("line") + 1).alias("size"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known when the join is planned: a row per split, broadcast while that is small.
    bases = pin(
        sizes.select(
            F.col("path").alias("of"),
            F.col("split").alias("start"),
            F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"),
        )
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at = None, 0  # the split of the last row, and the size of its lines so far
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column(0).dictionary_encode().indices.to_numpy()
            splits = batch.column(1).to_numpy()
            fresh = np.concatenate([[True], (paths[1:] != paths[:-1]) | (splits[1:] != splits[:-1])])
            if (batch.column(0)[0].as_py(), splits[0]) != before:
                at = 0
            widths = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) + 1
            ends = np.cumsum(widths) + at
            starts = ends - widths
            first = np.flatnonzero(fresh)
            zero = np.repeat(starts[first], np.diff(np.append(first, len(starts))))
            zero[: first[1] if len(first) > 1 else len(zero)] = 0  # counts on from the batch before
            before, at = (batch.column(0)[-1].as_py(), splits[-1]), int(ends[-1] - zero[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(starts - zero), batch.column(2)], ["path", "split", "inside", "line"]
            )

    found = lines.mapInArrow(placed, "path string, split bigint, inside bigint, line binary")
    met = found.join(bases, (F.col("path") == F.col("of")) & (F.col("split") == F.col("start")), "left")
    known = F.coalesce("base", F.raise_error(F.lit("the files were split anew while they were read")).cast("bigint"))
    return met.select(
        "path",
        (known + F.col("inside")).alias("offset"),
        F.regexp_replace(F.col("line").cast("string"), "\r$", "").alias("line"),
    )


def read_table(
    spark: SparkSession, name: str, keys: Sequence[str] | None = None
) -> DataFrame:
    """A catalog table by name, a parquet folder by path, or a keyed table by path and keys."""
    if keys is not None:
        return read_keyed(spark, name, keys)
    return spark.read.parquet(name) if "/" in name else spark.read.table(name)


def trade_stream_options(
    servers: str,
    topic: str = TOPIC,
    starting: str = "latest",
    min_partitions: int | None = None,
    max_offsets_per_trigger: int | None = None,
) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
    }
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_trades_kafka(
    spark: SparkSession,
    servers: str,
    topic: str = TOPIC,
    starting: str = "latest",
    min_partitions: int | None = None,
    max_offsets_per_trigger: int | None = None,
    stream: bool = True,
) -> DataFrame:
    """Trades from a Kafka topic of 21-byte messages (needs Spark's Kafka package)."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    options = trade_stream_options(
        servers, topic, starting, min_partitions, max_offsets_per_trigger
    )
    return decode_trade(reader.options(**options).load())


def read_latency_log(spark: SparkSession, path: str | Sequence[str], layout: str = "csv") -> DataFrame:
    """Lines of latency logs.

    ``csv``: plain files of comma-separated lines. ``folders``: a tree with
    ``t-<ms>`` folders that hold ``part-*`` files at any depth; adds
    ``batch_ms`` from the folder name, and ``run``, the folder above it.
    """
    paths = path if isinstance(path, str) else list(path)
    if layout == "csv":
        return spark.read.text(paths)
    if layout != "folders":
        raise ValueError("layout must be csv or folders")
    lines = spark.read.option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "part*"
    ).text(paths)
    return lines.select(
        "value",
        F.regexp_extract("_metadata.file_path", r"/([^/]+)/t-\d+/", 1).alias("run"),
        F.regexp_extract("_metadata.file_path", r"/t-(\d+)/", 1)
        .try_cast("bigint")
        .alias("batch_ms"),
    ).where(F.col("batch_ms").isNotNull())
