"""Session set-up and the few session facts the operators depend on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_UTC_NAMES = {"UTC", "Z", "GMT", "Etc/UTC", "+00:00", "Etc/GMT"}

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(
    app: str = "eventflow",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """A session with the settings the library is tuned for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset, so that
    ``spark-submit`` decides; AQE then merges or splits shuffle partitions by
    their measured size.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory is not None:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB with changelog checkpoints.

    ``transformWithState`` needs this provider; for window aggregates and joins
    it keeps state off the heap.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    spark.conf.set(
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"
    )


def is_utc(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.session.timeZone") in _UTC_NAMES


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names, or a temporary one in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="eventflow-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return context.getCheckpointDir()


_PINNED = "eventflow-pinned"


def pin(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the checkpoint folder and go on from there.

    Used where several branches must see the very same rows, or would otherwise
    compute them again. Each branch reads only the columns it needs, and a lost
    executor re-reads files instead of partitioning anew.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{_PINNED}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_pinned(spark: SparkSession) -> None:
    """Delete what this application has pinned, once its results are written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{checkpoint_root(spark)}/{_PINNED}"
    )
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folder, True)
