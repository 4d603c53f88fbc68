"""Helpers the training-data operators share: written intermediates, prefix sums, batch sizes."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventflow.session import checkpoint_root, pin

BATCH_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 4_000


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the folder that driver and executors share."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()  # the driver serves the file while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.basename(package)
    context.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", os.path.dirname(package), name))
    _shipped.add(context.applicationId)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def arrow_batches(spark: SparkSession) -> Iterator[None]:
    """Bound what Python is handed at once, in bytes too: a text can be megabytes long.

    Only for jobs that end inside the block; the caller's settings come back.
    """
    ship(spark)
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def pin_python(df: DataFrame) -> DataFrame:
    """``pin`` for rows that come out of Python, in bounded batches."""
    with arrow_batches(df.sparkSession):
        return pin(df)


def root_of(n: int) -> int:
    """Groups of about as many rows each as there are groups."""
    return max(1, math.isqrt(max(0, n)))


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & left[name].eqNullSafe(right[name])
    return found


def preceding_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str], weight: Column, name: str
) -> DataFrame:
    """Add, as ``name``, the sum of ``weight`` over the rows before this one in its group.

    The order inside a group is (hash of ``order``, ``order``): it depends on
    the rows alone. A group is summed in about as many buckets as a bucket has
    rows, so none of any size meets in one task. ``df`` is read more than once
    and must give the same rows each time: a table, or pinned.
    """
    buckets = root_of(df.count())
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*group, "_bucket"]
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = (
        rows.groupBy(*keys)
        .agg(F.sum(weight).alias("_total"))
        .select(
            *[F.col(k).alias(f"_b_{k}") for k in keys],
            F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"),
        )
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    summed = rows.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    matched = F.lit(True)
    for k in keys:
        matched = matched & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return summed.join(base, matched).select(
        *df.columns, (F.col("_base") + F.col("_inside")).cast("long").alias(name)
    )


def repeated(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Number equal rows from 0, so that each row can be told from its copies.

    Copies are counted before the shuffle and laid out again after it.
    """
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn(name, F.explode(F.expr("sequence(0L, _copies - 1)")))
        .drop("_copies")
    )


def single_spaced(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, none of a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def keep_rows(docs: DataFrame, keepers: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, digest) is in ``keepers``, one of each; all columns stay."""

    def named(value: Column) -> Column:
        return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), value)

    wanted = keepers.select(named(F.col("digest")).alias("__keep_wanted")).distinct()
    met = docs.withColumn("__keep_named", named(digest)).join(
        wanted, F.col("__keep_named") == F.col("__keep_wanted"), "left_semi"
    )
    # Partitioned as the join is: numbering moves nothing again. Rows that differ elsewhere stand in one order.
    order = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    number = F.row_number().over(Window.partitionBy("__keep_named").orderBy(order))
    return met.withColumn("__keep_number", number).where("__keep_number = 1").select(*docs.columns)
