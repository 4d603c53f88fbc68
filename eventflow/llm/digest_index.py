"""Exact duplicates against a persistent index of digests, bucketed and sorted by digest.

The index is a Parquet table at a path; any session can open it. New data is
reduced to one row per digest, joined with the index bucket by bucket (a sort-merge
anti-join that moves the new rows only) and appended. Built-in expressions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.llm.common import partitions, single_spaced
from eventflow.session import pin


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with runs of white space as one space, as lower-case hex; null is empty."""
    return F.sha2(single_spaced(text), 256)


class DigestIndex:
    """``digest, keep_id`` of every distinct text seen so far.

    ``buckets`` is fixed when the index is made; opening it later takes the same number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or partitions(spark)
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append the digests of ``groups`` that the index has not; a repeated call adds nothing."""
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        placed = pin(fresh.select("digest", "keep_id")).repartition(self.buckets, "digest")
        placed.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def deduplicate(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

        Of equal texts that are new, the smallest key stays (null keys count as
        the largest, and of equal rows one stays); of texts the index has, none.
        ``group_size`` counts this input's rows. The new digests are in the index
        when this returns.
        """
        tagged = pin(
            docs.select(
                F.col(key).cast("long").alias("doc_id"),
                text_digest(F.col(text)).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            )
        )
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
        groups = tagged.groupBy("digest").agg(
            F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")
        )
        known = self.rows().select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
        decided = pin(
            groups.join(known.hint("merge"), "digest", "left").select(
                F.col("digest").alias("of"),
                F.when(F.col("known"), F.col("known_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
                F.when(F.col("known").isNull(), F.col("first.row")).alias("keep_row"),
                "group_size",
            )
        )
        self.add(decided.where("keep_row is not null").select(F.col("of").alias("digest"), "keep_id"))
        return tagged.join(decided, tagged["digest"] == decided["of"]).select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
