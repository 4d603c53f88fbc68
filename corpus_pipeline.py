"""From documents to packed training sequences, one operator a stage.

A stage is ``(spark, docs, folder) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.llm import digest_index, mixing, order_minhash, packing, quality_model, queries
from eventflow.llm.common import keep_rows, new_folder, pin_python
from eventflow.llm.tokens import BYTE_BPE
from eventflow.session import pin

# The classifier, the alignment and the tokenizer have no SQL form.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop what the ordinal model rejects: rows with too small a chance of the best grade."""
    labels = queries.table(spark, folder, "labels")
    model = quality_model.train(quality_model.rated(docs, labels))
    graded = quality_model.grade(docs, model, prefix="__graded_")
    good = graded.where(F.col("__graded_tail_probability") >= queries.MIN_TAIL)
    return pin_python(good.select(*docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one row of each text, white space aside."""
    index = digest_index.DigestIndex(spark, new_folder(spark, "digest-index"))
    decided = index.deduplicate(docs).where("kept")
    keepers = decided.select("doc_id", F.col("text_sha256").alias("digest"))
    return keep_rows(docs, keepers, digest_index.text_digest(F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    keepers = order_minhash.near_duplicates(docs).where("kept").select("doc_id", "digest")
    return keep_rows(docs, keepers, order_minhash.text_digest(F.col("text")))


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Take words of each source to its target; a document comes back as often as its words are taken."""
    return mixing.Mix(docs, queries.WEIGHTS, queries.MOST_TAKES).documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    path = public_tokenizers.path(BYTE_BPE)
    return packing.pack_documents(docs, path, queries.END_OF_PACKED_DOC, queries.CAPACITY)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir))
    return docs
