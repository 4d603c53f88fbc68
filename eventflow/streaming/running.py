"""Start, finish and read back streaming queries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventflow.plans.sizes import input_bytes
from eventflow.session import checkpoint_root, use_rocksdb_state
from eventflow.sinks.tables import last_per_key

_ASK_SECONDS = 1


def table_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """A parquet table as a stream; the schema is read from the files at once.

    Zone-less times become timestamps, which event time needs.
    """
    table = spark.read.parquet(path)
    schema = table.schema
    reader = spark.readStream.schema(schema)
    if _is_file(spark, path):
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(path)
    return rows.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name)
            if isinstance(f.dataType, T.TimestampNTZType)
            else F.col(f.name)
            for f in schema.fields
        ]
    )


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(place).isFile()


def start(
    df: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start a query whose micro-batches go to ``sink``.

    State and progress live in ``checkpoint``: a restart goes on from there.
    With a sink that repeats a batch safely, each row counts exactly once;
    otherwise at least once. ``every`` is the trigger interval; None works off
    what is there and stops.
    """
    writer = df.writeStream.outputMode(mode).foreachBatch(sink)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def dropped_rows(query: StreamingQuery) -> dict[int, int]:
    """Rows that stateful operators dropped as late, for each micro-batch whose progress the query still has."""
    return {
        progress.batchId: sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        for progress in query.recentProgress
    }


def _work_off(query: StreamingQuery, timeout_seconds: float | None) -> int:
    """Wait for the query's end; return the rows it dropped as late.

    A query keeps the progress of its last hundred micro-batches only, so it is asked on the way.
    """
    until = None if timeout_seconds is None else time.monotonic() + timeout_seconds
    late: dict[int, int] = {}
    while not query.awaitTermination(_ASK_SECONDS):
        late |= dropped_rows(query)
        if until is not None and time.monotonic() > until:
            query.stop()
            raise TimeoutError(f"stream not finished after {timeout_seconds} s")
    return sum((late | dropped_rows(query)).values())


def run_to_table(
    df: DataFrame,
    mode: str = "append",
    folder: str | None = None,
    per_batch: Callable[[DataFrame], DataFrame] | None = None,
    timeout_seconds: int | None = None,
    allow_late: bool = False,
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """Work off all available input into parquet and return what was written.

    ``per_batch`` is applied to the rows of each micro-batch before they are written.
    Each micro-batch has its folder, which a repeated batch overwrites. Column
    ``batch_id`` is added for modes other than append, where a key comes out again
    when it changes. Rows that came too late for the watermark are an error, unless
    ``allow_late`` says that they may be left out.

    ``finish`` is called when all input is worked off. It adds rows far ahead in time to
    inputs that have ended; the query then goes on from its checkpoint, and the windows
    that the watermark had not passed come out.
    """
    spark = df.sparkSession
    use_rocksdb_state(spark)
    root = folder or f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    target = f"{root}/rows"
    shape = df.schema if per_batch is None else per_batch(spark.createDataFrame([], df.schema)).schema
    schema = T.StructType([*shape.fields, T.StructField("batch_id", T.LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if per_batch is None else per_batch(batch)
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    late = _work_off(start(df, write, f"{root}/checkpoint", mode), timeout_seconds)
    if finish is not None:
        finish()
        late += _work_off(start(df, write, f"{root}/checkpoint", mode), timeout_seconds)
    if late and not allow_late:
        raise RuntimeError(f"{late} rows came behind the watermark; a longer lag is needed")
    try:
        written = spark.read.schema(schema).parquet(target)
    except AnalysisException:  # no input, so no micro-batch and no folder
        written = spark.createDataFrame([], schema)
    return written.drop("batch_id") if mode == "append" else written


def current_rows(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key from the rows of an update-mode run."""
    return last_per_key(written, keys, "batch_id").drop("batch_id")


def partitions_for(
    table: Callable[[str], DataFrame], names: Iterable[str], bytes_each: int = 64 * 1024 * 1024
) -> int:
    """State partitions for the size of the given tables: one for each 64 MiB, 8 at least."""
    sizes = [input_bytes(table(name)) or 0 for name in names]
    return max(8, -(-sum(sizes) // bytes_each))


@contextmanager
def state_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Start streams with ``n`` state partitions; a query keeps the number it began with.

    AQE does not merge the partitions of a stateful operator, so a number far
    above what the data needs costs an idle state store each.
    """
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(n))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def watermark_of(query: StreamingQuery) -> str | None:
    """The event-time watermark a running query last reported."""
    progress = query.lastProgress
    return progress.eventTime.get("watermark") if progress else None
