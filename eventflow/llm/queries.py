"""The training-data operators as queries over the driver's tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.llm import (
    chat_format,
    conversation_repair,
    digest_index,
    filter_audit,
    mixing,
    order_minhash,
    packing,
    quality_model,
    quality_rules,
    sharding,
    suffix_dedup,
    token_counts,
    token_files,
)
from eventflow.llm.common import new_folder, pin_python
from eventflow.llm.tokens import BYTE_BPE, WORD_BPE

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 16
END_OF_FILE_DOC = 1
END_OF_PACKED_DOC = 0
CAPACITY = 2048
WEIGHTS = (5, 2, 1)
MOST_TAKES = 3
MIN_TAIL = 0.3  # of the best grade: what is below is rejected
PIECES = "piece_bpe_32k.model"
PROBE = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write_tokens(
        table(spark, folder, "documents"), path, public_tokenizers.path(WORD_BPE), END_OF_FILE_DOC
    )
    return token_files.read_all(spark, path).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op2_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = sharding.sized(table(spark, folder, "documents"))
    sharded = sharding.shard_records(
        docs, "doc_id", [1.0] * SHARDS, ["doc_id", "text_crc32", "size"], grown=[1.0]
    )
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op3_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model.train(quality_model.rated(docs, table(spark, folder, "labels")))
    graded_ = quality_model.grade(docs, model).select("doc_id", "expected_grade", "tail_probability")
    return pin_python(graded_).withColumn("kept", F.col("tail_probability") >= MIN_TAIL)


def op4_gram_ratio_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    trusted = quality_rules.trusted_ids(table(spark, folder, "labels"))
    marked = docs.join(F.broadcast(trusted), F.col("doc_id") == F.col("rated_id"), "left")  # MOST_TRUSTED rows
    ratios = quality_rules.log_ratios(marked, F.col("trusted"))
    return quality_rules.judge(docs, ratios)


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op6_trie_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    return pin_python(token_counts.count_tokens(table(spark, folder, "documents"), path))


def op7_digest_index(spark: SparkSession, folder: str) -> DataFrame:
    index = digest_index.DigestIndex(spark, new_folder(spark, "digest-index"))
    return index.deduplicate(table(spark, folder, "documents"))


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.Mix(table(spark, folder, "documents"), WEIGHTS, MOST_TAKES)
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = order_minhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), END_OF_PACKED_DOC, CAPACITY
    )


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    counters = filter_audit.audit_files(
        spark, f"{folder}/documents.parquet", table(spark, folder, "labels")
    )
    return filter_audit.all_orders(counters)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversation_repair.summary(rows, conversation_repair.repair(conversation_repair.damage(rows)))


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    pieces = chat_format.format_conversations(rows.unionByName(probe), public_tokenizers.path(BYTE_BPE))
    return chat_format.read_back(pieces)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_token_files, op2_rendezvous_shards, op3_ordinal_quality, op4_gram_ratio_rules, op5_suffix_dedup, op6_trie_token_counts, op7_digest_index, op8_source_mix, op9_order_minhash, op10_best_fit_packing, op11_filter_audit, op12_conversation_repair, op13_chat_format)
}
