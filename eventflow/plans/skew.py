"""Equi-joins that stay balanced when one key holds a large share of a side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.plans.sizes import will_broadcast

_SALT = "__salt"

# A key is hot from this many rows on, whatever its share of the table. The list of hot
# keys is bounded: it holds the HOT_KEYS most frequent ones.
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000
SALTS = 64


def hot_keys(
    df: DataFrame, key: str, share: float | None = None, min_rows: int | None = None
) -> list:
    """Keys that hold at least ``min_rows`` rows and, if given, at least ``share`` of all.

    One pass over one column with a mergeable heavy-hitter sketch: nothing is
    shuffled by key, and one row of bounded size comes back. The answer steers
    how a join is spread out, never which rows it returns.
    """
    min_rows = HOT_ROWS if min_rows is None else min_rows
    most = HOT_KEYS if share is None else int(1 / share)
    row = df.agg(
        F.count(key).alias("rows"),
        F.expr(f"approx_top_k(`{key}`, {most}, {most * 10})").alias("top"),
    ).first()
    floor = min_rows if share is None else max(min_rows, share * row["rows"])
    return [item["item"] for item in row["top"] or [] if item["count"] >= floor]


def skew_safe_join(
    big: DataFrame,
    other: DataFrame,
    big_key: str,
    other_key: str,
    how: str = "inner",
    extra: Column | None = None,
    salt_by: Sequence[str] | None = None,
    hot: list | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join on one key; rows of ``big`` with a hot key are split over ``salts`` tasks.

    ``other`` is repeated for hot keys only. Column names of the two sides must
    differ. ``how`` is inner or left (``big`` is the kept side). Whether
    ``other`` is broadcast is left to Catalyst, which checks its size; where it
    will be, no key can be too hot and ``big`` is not looked through for any.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if hot is None:
        hot = [] if big.isStreaming or will_broadcast(other) else hot_keys(big, big_key)
    condition = big[big_key] == other[other_key]
    if not hot:
        return big.join(other, condition if extra is None else condition & extra, how)

    spread_by = [F.col(c) for c in (salt_by or big.columns)]
    left = big.withColumn(
        _SALT,
        F.when(
            F.col(big_key).isin(hot), F.pmod(F.xxhash64(*spread_by), F.lit(salts))
        ).otherwise(F.lit(0).cast("bigint")),
    )
    copies = F.when(
        F.col(other_key).isin(hot), F.expr(f"sequence(0L, {salts - 1}L)")
    ).otherwise(F.expr("array(0L)"))
    right = other.withColumn(f"{_SALT}_o", F.explode(copies))
    condition = (F.col(big_key) == F.col(other_key)) & (
        F.col(_SALT) == F.col(f"{_SALT}_o")
    )
    joined = left.join(right, condition if extra is None else condition & extra, how)
    return joined.drop(_SALT, f"{_SALT}_o")
