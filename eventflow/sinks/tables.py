"""Keyed tables: the last write of a key wins.

A keyed table is a folder of numbered versions. ``full=00000001`` holds the
whole table, ``part=00000002`` the keys written since. A version counts once its
``_SUCCESS`` mark exists, so a job that dies while writing changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ORDER = "__order"


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """One row per key, the one with the highest ``order``; null orders are the lowest."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("__row"))
    return best.select(*[c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def merge_last(
    old: DataFrame | None, new: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """Rows of ``old`` with those of ``new`` laid over them, key by key.

    Any new row replaces the old one; among new rows the highest ``order`` wins.
    Both sides meet in one aggregation, so a key written very often is reduced
    before the shuffle.
    """
    if old is None:
        return last_per_key(new, keys, order)
    both = old.withColumn(_ORDER, F.lit(0)).unionByName(new.withColumn(_ORDER, F.lit(1)))
    return last_per_key(both, keys, F.struct(_ORDER, order)).drop(_ORDER)


def upsert_table(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    order: str,
    clear: bool = False,
    write_id: str | None = None,
    rewrite: bool = True,
) -> str:
    """Write ``df`` into the keyed table at ``path``; returns the new version's folder.

    ``clear`` starts from an empty table. With ``rewrite`` off only the given keys
    are written, and laid over the rest when the table is read. A write that
    names itself by ``write_id`` (letters, digits and hyphens) counts once: when
    a version bears that name, nothing is written again. One writer at a time.
    """
    spark = df.sparkSession
    written = versions(spark, path)
    newest = max(written, default=0)
    if write_id is not None:
        for folder in written.values():
            if folder.endswith(f".{write_id}"):
                return folder
    whole = clear or not written or rewrite
    old = None if clear or not written or not rewrite else read_keyed(spark, path, keys)
    target = f"{path}/{'full' if whole else 'part'}={newest + 1:08d}"
    if write_id is not None:
        target += f".{write_id}"
    merge_last(old, df, keys, order).write.mode("overwrite").parquet(target)
    return target


def upsert_stream(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    order: str,
    checkpoint: str,
    rewrite_every: int = 32,
):
    """A stream writer that lays each micro-batch over the keyed table.

    A micro-batch writes its own keys only; every ``rewrite_every``-th one writes
    the table anew, so that a reader never merges many more versions than that.
    A micro-batch is known by its checkpoint folder and its number: a repeated one
    counts once, and writes of other streams or of batch jobs may come in between.
    """
    stream = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        whole = (batch_id + 1) % rewrite_every == 0
        upsert_table(batch, path, keys, order, write_id=f"{stream}-{batch_id}", rewrite=whole)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_keyed(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The current rows of a keyed table."""
    written = versions(spark, path)
    if not written:
        raise FileNotFoundError(f"no keyed table at {path}")
    base = max((n for n, folder in written.items() if "/full=" in folder), default=0)
    current = sorted(n for n in written if n >= base)
    if len(current) == 1:
        return spark.read.parquet(written[current[0]])
    merged = None
    for number in current:
        rows = spark.read.parquet(written[number]).withColumn(_ORDER, F.lit(number))
        merged = rows if merged is None else merged.unionByName(rows)
    return last_per_key(merged, keys, _ORDER).drop(_ORDER)


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Folders of the complete versions by number."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return {}
    found = {}
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        kind, _, number = name.partition("=")
        number = number.partition(".")[0]
        complete = files.exists(hadoop.Path(entry.getPath(), "_SUCCESS"))
        if kind in ("full", "part") and number.isdigit() and complete:
            found[int(number)] = f"{path}/{name}"
    return found
