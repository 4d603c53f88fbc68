"""Shards by rendezvous hashing: the highest score of (key, shard) takes the record.

A score depends on the key and one shard only. A shard that is added therefore
takes records from the others in proportion to its weight and moves none among
them. Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import preceding_sum
from eventflow.session import pin

_DIGITS = 13  # 52 bits of the digest, exact as a double


def score(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight for a uniform u of key and shard; the least score wins.

    u comes from the MD5 digest of ``key:shard``; a null key counts as empty.
    """
    label = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), shard.cast("string"))
    digits = F.conv(F.substring(F.md5(label.cast("binary")), 1, _DIGITS), 16, 10).cast("double")
    return -F.log((digits + 0.5) / F.lit(float(16**_DIGITS))) / weight


def assign_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that takes the key. Weights must be positive; equal keys go together."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scored = F.array(
        *[
            F.struct(score(key, F.lit(i), F.lit(float(w))).alias("score"), F.lit(i).alias("shard"))
            for i, w in enumerate(weights)
        ]
    )
    return F.array_min(scored)["shard"]


def shard_records(
    df: DataFrame, key: str, weights: Sequence[float], order: Sequence[str], grown: Sequence[float] = ()
) -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 in each shard) and, with further weights, ``grown_shard``.

    Rows that agree in ``order`` are interchangeable. Null keys share a shard.
    A shard is numbered in buckets, so a large one is not a large task.
    """
    rows = df.withColumn("shard", assign_shard(F.col(key), weights))
    if grown:
        rows = rows.withColumn("grown_shard", assign_shard(F.col(key), [*weights, *grown]))
    return preceding_sum(pin(rows), ["shard"], order, F.lit(1), "slot")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What sharding documents needs of them: ``doc_id, size, text_crc32``, one row per document.

    Size is the text's UTF-8 bytes plus 1. A null text has none and is summed as empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
