"""Token ids in binary shards, with a minimal perfect hash index from document keys to their place.

File format, two Parquet tables in one folder:

* ``blocks``: ``shard, block, ids, n_ids, docs``. ``ids`` holds the ids of
  consecutive documents, end to end, as little-endian unsigned 32-bit integers.
  ``docs`` says which: key, place in the block, number of ids, ids before it in
  the shard. Shards are ranges of keys in ascending order, null keys first.
* ``index``: one row per part of the key space: the bit fields of the hash
  function, and per slot a 32-bit fingerprint and the document's place.

The hash function of a part is built level by level: a key whose place in a bit
field no other key shares is done, the others go to the next, smaller field.
The rank of its bit is the key's slot, so a look-up costs the same for any key.

Null texts are empty texts. Rows with equal keys are all written; the index
leads to the first of them (smallest hash of the text), and ``read_all`` finds
the others by position. Null keys have no index entry. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.llm.common import arrow_batches, partitions, root_of, ship
from eventflow.llm.tokens import encoder
from eventflow.session import pin

BLOCK_IDS = 65_536

_DOC = "struct<key: bigint, at: int, n: int, before: bigint>"
_BLOCKS = f"shard int, block int, ids binary, n_ids bigint, docs array<{_DOC}>"
_PLACES = ("shard", "block", "at", "n", "start", "copies")
_INDEX = "part bigint, sizes binary, bits binary, marks binary, " + ", ".join(
    f"{c} binary" for c in _PLACES
)


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
) -> None:
    """Encode every text, append ``end_id`` and write blocks and index to ``folder``."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(
        F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    ranged = given.repartitionByRange(shards or partitions(spark), "key", "h")
    ordered = ranged.sortWithinPartitions("key", "h", "text").select("key", "text")
    with arrow_batches(spark):
        ordered.mapInArrow(_writer(tokenizer, end_id), _BLOCKS).write.parquet(f"{folder}/blocks")
    _index(documents(spark, folder)).write.parquet(f"{folder}/index")


def _writer(tokenizer: str, end_id: int):
    kinds = pa.schema(
        [
            ("shard", pa.int32()),
            ("block", pa.int32()),
            ("ids", pa.binary()),
            ("n_ids", pa.int64()),
            (
                "docs",
                pa.list_(
                    pa.struct(
                        [
                            ("key", pa.int64()),
                            ("at", pa.int32()),
                            ("n", pa.int32()),
                            ("before", pa.int64()),
                        ]
                    )
                ),
            ),
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        parts: list[bytes] = []
        places: list[dict] = []
        held = 0

        def row() -> pa.RecordBatch:
            one = {"shard": shard, "block": block, "ids": b"".join(parts), "n_ids": held}
            return pa.RecordBatch.from_pylist([one | {"docs": places}], schema=kinds)

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, ids in zip(keys, encoder(tokenizer).encode(batch.column(1)), strict=True):
                n = len(ids) + 1
                places.append({"key": k, "at": held, "n": n, "before": before})
                parts += [ids.tobytes(), end]
                held, before = held + n, before + n
                if held >= BLOCK_IDS:
                    yield row()
                    block, held, parts, places = block + 1, 0, [], []
        if places:
            yield row()

    return write


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every document: ``key, shard, block, at, n, start``, without reading ids."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One number per shard comes to the driver; their running sum goes back.
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    upto = np.cumsum([0] + [r.n for r in sums])
    base = spark.createDataFrame(
        [(r.shard, int(upto[i])) for i, r in enumerate(sums)], "of_shard int, base long"
    )
    return (
        blocks.select("shard", "block", F.explode("docs").alias("d"))
        .join(F.broadcast(base), F.col("shard") == F.col("of_shard"))
        .select(
            "d.key", "shard", "block", "d.at", "d.n", (F.col("base") + F.col("d.before")).alias("start")
        )
    )


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well-spread 64-bit value of each key and the seed; different keys stay different."""
    x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit fields for distinct 64-bit keys, and the slot of each: a number below their count."""
    fields, slots = [], np.empty(len(keys), np.int64)
    left, done = np.arange(len(keys)), 0
    while len(left):
        size = max(64, 2 * len(left))
        place = (_mixed(keys[left], len(fields)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, bool)
        bits[place[alone]] = True
        slots[left[alone]] = done + np.cumsum(bits)[place[alone]] - 1
        done += int(alone.sum())
        fields.append(bits)
        left = left[~alone]
    return fields, slots


def find_slots(fields: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 if no field has its bit."""
    slots = np.full(len(keys), -1, np.int64)
    left, done = np.arange(len(keys)), 0
    for level, bits in enumerate(fields):
        place = (_mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[place]
        slots[left[hit]] = done + np.cumsum(bits)[place[hit]] - 1
        done += int(bits.sum())
        left = left[~hit]
    return slots


_MARK = 1 << 20  # the seed of the fingerprints, beyond any level


def _marks(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, _MARK) >> np.uint64(32)).astype(np.uint32)


def _index(places: DataFrame) -> DataFrame:
    first = (
        places.where("key is not null")
        .groupBy("key")
        .agg(
            F.min(F.struct("start", "shard", "block", "at", "n")).alias("p"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select("key", "p.*", "copies")
    )
    parts = root_of(places.count())

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["key"].to_numpy().astype(np.int64).view(np.uint64)
        fields, slots = perfect_hash(keys)
        order = np.argsort(slots)
        out = {
            "part": rows["part"].iloc[0],
            "sizes": np.array([len(b) for b in fields], "<i8").tobytes(),
            "bits": b"".join(np.packbits(b).tobytes() for b in fields),
            "marks": _marks(keys)[order].tobytes(),
        }
        out |= {c: rows[c].to_numpy().astype("<i8")[order].tobytes() for c in _PLACES}
        return pd.DataFrame([out])

    part = F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")
    kept = first.select(part, F.lit(parts).alias("parts"), "key", *_PLACES)
    built = kept.groupBy("part").applyInPandas(build, _INDEX)
    return built.withColumn("parts", F.lit(parts))


def look_up(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The place of each distinct key of ``keys`` (column ``key``) by the index.

    A key that was never written is found by chance once in 2^32; ``fetch``
    compares keys as well.
    """
    ship(spark)
    index = spark.read.parquet(f"{folder}/index")
    row = index.select("parts").first()
    parts = row.parts if row else 1

    def find(wanted: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        names = ["key", *_PLACES]
        if not len(wanted) or not len(entry):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in names})
        e = entry.iloc[0]
        fields, at = [], 0
        for size in np.frombuffer(e["sizes"], "<i8"):
            width = (int(size) + 7) // 8
            packed = np.frombuffer(e["bits"][at : at + width], np.uint8)
            fields.append(np.unpackbits(packed)[:size].astype(bool))
            at += width
        keys64 = wanted["key"].to_numpy().astype(np.int64)
        slots = find_slots(fields, keys64.view(np.uint64))
        stored = np.frombuffer(e["marks"], np.uint32)
        right = (slots >= 0) & (stored[slots] == _marks(keys64.view(np.uint64)))
        out = {"key": keys64[right]}
        out |= {c: np.frombuffer(e[c], "<i8")[slots[right]] for c in _PLACES}
        return pd.DataFrame(out)[names]

    asked = keys.where("key is not null").select("key").distinct()
    asked = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    kinds = ", ".join(f"{c} long" for c in ("key", *_PLACES))
    return asked.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(find, kinds)


def _with_ids(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """Take the ids of ``places`` (``key, shard, block, at, n, start``) out of their blocks."""
    wanted = places.groupBy("shard", "block").agg(
        F.collect_list(F.struct("key", "at", "n", "start")).alias("wanted")
    )  # at most BLOCK_IDS of a block, since each document has an id at least
    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "ids", "docs")
    return (
        blocks.join(wanted, ["shard", "block"])
        .select("ids", F.explode("wanted").alias("d"))
        .select(
            "d.key",
            "d.start",
            F.col("d.n").cast("long").alias("n_tokens"),
            F.expr("substring(ids, cast(4 * d.at + 1 as int), cast(4 * d.n as int))").alias("ids"),
        )
    )


def fetch(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """``key, start, n_tokens, ids`` of the distinct keys asked for; unknown ones are left out."""
    found = look_up(spark, folder, keys)
    real = documents(spark, folder).select("key", "shard", "block", "at")
    return _with_ids(spark, folder, found.join(real, ["key", "shard", "block", "at"], "left_semi"))


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """``key, start, n_tokens, ids`` of every document, found through the index.

    Documents the index doesn't lead to (null keys, further rows of a key) are
    taken by their position.
    """
    everything = documents(spark, folder)
    found = pin(look_up(spark, folder, everything.select("key")))
    rest = everything.join(found.select("shard", "block", "at"), ["shard", "block", "at"], "left_anti")
    named = ["key", "shard", "block", "at", "n", "start"]
    return _with_ids(spark, folder, found.select(*named).unionByName(rest.select(*named)))
