"""Filters, unions and row shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventflow.functions.values import comma_fields, has_suffix


def sieve(df: DataFrame, column: str, n: int) -> DataFrame:
    """Every n-th key; a factor below 1 keeps all rows."""
    return df.where(F.col(column) % max(1, n) == 0)


def ticker_suffix(df: DataFrame, suffix: str = "AA", column: str = "ticker") -> DataFrame:
    return df.where(has_suffix(F.col(column), suffix))


def before(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows below a cut-off, such as log lines of the first ``limit`` ms."""
    return df.where(F.col(column) < limit)


def tagged_union(**streams: DataFrame) -> DataFrame:
    """Bag union of differently shaped inputs; ``kind`` names the input of a row."""
    merged = None
    for kind, df in streams.items():
        tagged = df.withColumn("kind", F.lit(kind))
        merged = (
            tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
        )
    if merged is None:
        raise ValueError("nothing to merge")
    return merged


def split_fields(
    df: DataFrame, n: int, column: str = "value", observation: Observation | None = None
) -> DataFrame:
    """Lines with exactly ``n`` comma-separated fields, as array column ``fields``.

    Other lines are dropped; an observation given here counts them as
    ``bad_rows`` (and ``good_rows``) in the same pass.
    """
    fields = df.withColumn("fields", comma_fields(F.col(column)))
    good = F.size("fields") == n
    if observation is not None:
        fields = fields.observe(
            observation,
            F.count_if(good).alias("good_rows"),
            F.count_if(~good).alias("bad_rows"),
        )
    return fields.where(good)


def comma_lines(df: DataFrame, *columns: str | Column) -> DataFrame:
    """One text line per row: the given columns with commas between them."""
    chosen = [F.col(c) if isinstance(c, str) else c for c in (columns or df.columns)]
    return df.select(F.concat_ws(",", *[c.cast("string") for c in chosen]).alias("value"))


def keyed_lines(df: DataFrame) -> DataFrame:
    """Lines with offsets as a key-value table; the key is (path, offset)."""
    return df.select("path", F.col("offset").alias("key"), F.col("line").alias("value"))
