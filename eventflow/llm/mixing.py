"""Mix sources to target weights by drawing fixed-length blocks of words.

The words of a source are laid end to end and cut into blocks of one length (the
last may be shorter). A mix is a row of slots, cut into output shards. How many
slots of a shard a source gets is a multinomial draw from what its quota has left,
so every quota is met exactly. A source's slots are numbered through all shards;
slot t takes block ``permutation(t mod blocks)``, another permutation for each
round through the source. Slots and blocks then meet in a join on (source, block).
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventflow.llm.common import count_words, partitions, preceding_sum, repeated, words_of
from eventflow.session import pin

MOST_SOURCES = 100_000
SHARD_SLOTS = 1 << 22
_RANGE_SLOTS = 4_096


def targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of the sum of sizes by weight, none above ``most`` times its size.

    What a source cannot take is shared by the others by weight, until none is above.
    """
    total, open_, out = float(sum(sizes)), [i for i, s in enumerate(sizes) if s], [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if total * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = total * weights[i] / weight
            break
        for i in above:
            out[i] = most * sizes[i]
            total -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def draw_shards(quotas: Sequence[int], shard_slots: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot of the source, slots) with each source's slots summing to its quota."""
    left = np.array(quotas, np.int64)
    used = np.zeros(len(left), np.int64)
    rows, shard = [], 0
    while left.sum():
        slots = min(shard_slots, int(left.sum()))
        rng = np.random.Generator(np.random.PCG64([seed, shard]))
        got = np.minimum(rng.multinomial(slots, left / left.sum()), left)
        while short := slots - int(got.sum()):  # what a used-up source left is drawn from the others
            rest = left - got
            got += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
        rows += [(shard, i, int(used[i]), int(got[i])) for i in np.flatnonzero(got)]
        used, left, shard = used + got, left - got, shard + 1
    return rows


def _step(x: Column, side: Column, rounds: Column, source: Column) -> Column:
    """Four Feistel rounds over the places of a square: a permutation of them."""
    left, right = F.floor(x / side).cast("long"), F.pmod(x, side)
    for i in range(4):
        left, right = right, F.pmod(left + F.pmod(F.xxhash64(right, rounds, source, F.lit(i)), side), side)
    return left * side + right


def _walked(slots: DataFrame) -> DataFrame:
    """``block`` for each slot: a place in the least square that holds all blocks, walked on
    along its cycle while it is none of them."""
    side = F.ceil(F.sqrt(F.col("blocks").cast("double"))).cast("long")
    rounds = F.floor(F.col("t") / F.col("blocks")).cast("long")
    one = slots.withColumns({"side": side, "round": rounds}).withColumn(
        "x", _step(F.pmod("t", "blocks"), F.col("side"), F.col("round"), F.col("source_no"))
    )
    # A place outside leads back inside after as many steps as its cycle has outside
    # places in a row, at most side * side - n < 2 side + 1.
    again = F.aggregate(
        F.expr("sequence(1L, 2 * side + 1)"),
        F.col("x"),
        lambda x, _: F.when(x < F.col("blocks"), x).otherwise(
            _step(x, F.col("side"), F.col("round"), F.col("source_no"))
        ),
    )
    return one.withColumn(
        "block", F.when(F.col("x") < F.col("blocks"), F.col("x")).otherwise(again)
    ).drop("x", "side", "round")


class Mix:
    """A mix of documents. ``order`` and contents decide it; a rerun gives the same.

    ``docs`` needs ``doc_id, text, source``. Null texts have no words; a null
    source is one more source, the last. Sources are taken in code point order
    and weigh ``weights`` in turn. Their table comes to the driver: more than
    ``MOST_SOURCES`` are refused.
    """

    def __init__(
        self, docs: DataFrame, weights: Sequence[float], most: int = 3, block_words: int = 128,
        shard_slots: int = SHARD_SLOTS, seed: int = 0,
    ):
        self.block_words = block_words
        counted = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            count_words(F.col("text")).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"),
        )
        columns = ["source", "doc_id", "crc", "size"]
        self.docs = pin(repeated(counted, columns, "copy"))
        found = self.docs.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
        sizes = [r.n for r in found]
        aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
        blocks = [-(-n // block_words) for n in sizes]
        quotas = [min(most * b, round(a * b / n)) if n else 0 for a, b, n in zip(aims, blocks, sizes, strict=True)]
        # A name-based number keeps a source's permutation when others come or go.
        marks = [zlib.crc32(repr(r.source).encode()) for r in found]
        spark = docs.sparkSession
        self.sources = spark.createDataFrame(
            [(r.source, r.source is None, n, float(a), b, m) for r, n, a, b, m in zip(found, sizes, aims, blocks, marks, strict=True)],
            "of string, of_null boolean, source_size long, target double, blocks long, source_no long",
        )
        drawn = [
            (shard, marks[i], blocks[i], first, first + n, found[i].source)
            for shard, i, first, n in draw_shards(quotas, shard_slots, seed)
        ]
        self._n_slots = sum(quotas)
        self._drawn = spark.createDataFrame(
            drawn, "shard int, source_no long, blocks long, first long, end long, source string"
        )

    def slots(self) -> DataFrame:
        """``shard, source, t, block``: what each slot of each output shard takes."""
        step = _RANGE_SLOTS
        ranges = self._drawn.withColumn("low", F.explode(F.expr(f"sequence(first, end - 1, {step}L)")))
        # A number of its own: the ranges are tiny before they are laid out, and would be merged into one task.
        number = max(partitions(ranges.sparkSession), -(-self._n_slots // (4 * step)))
        spread = ranges.repartition(number, F.col("low"), F.col("source_no"), F.col("shard"))
        every = spread.withColumn("t", F.explode(F.expr(f"sequence(low, least(low + {step}, end) - 1)")))
        return _walked(every).select("shard", "source", "t", "block")

    def pieces(self) -> DataFrame:
        """Which words of which document are in a block: ``source, block, doc_id, crc, copy, first, words``."""
        order = ["doc_id", "crc", "copy"]
        placed = preceding_sum(self.docs, ["source"], order, F.col("size"), "upto")
        b = self.block_words
        cut = placed.where("size > 0").withColumn(
            "block", F.explode(F.expr(f"sequence(upto div {b}, (upto + size - 1) div {b})"))
        )
        low = F.greatest(F.col("upto"), F.col("block") * b)
        high = F.least(F.col("upto") + F.col("size"), (F.col("block") + 1) * b)
        return cut.select("source", "block", *order, (low - F.col("upto")).alias("first"), (high - low).alias("words"))

    def _times(self) -> DataFrame:
        """The pieces that the mix takes, with how often."""
        times = self.slots().groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
        times = times.select(F.col("source").alias("of"), F.col("block").alias("of_block"), "times")
        same = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))
        return self.pieces().join(times, same).drop("of", "of_block")

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix as rows of ``docs``, the table it was made from.

        Row c of a document holds, in order, the words taken c times or more: its own
        text if that is all of it, else those words with spaces between them.
        """
        key = F.concat_ws(
            ":",
            F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("string"),
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")),
        )
        number = F.row_number().over(Window.partitionBy("__mix_same").orderBy("__mix_same")) - 1
        rows = docs.withColumn("__mix_same", key).withColumn("__mix_row", F.concat_ws(":", number, "__mix_same"))
        lists = (
            self._times()
            .select(
                F.concat_ws(
                    ":",
                    F.col("copy").cast("string"),
                    F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                    F.col("crc").cast("string"),
                    F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")),
                ).alias("__mix_of"),
                F.struct("first", "words", "times").alias("part"),
            )
            .groupBy("__mix_of")
            .agg(F.sort_array(F.collect_list("part")).alias("__mix_parts"))  # a document's own blocks
        )
        met = rows.join(lists, F.col("__mix_row") == F.col("__mix_of")).withColumn("__mix_words", words_of(F.col("text")))
        most = F.array_max(F.transform("__mix_parts", lambda p: p["times"]))
        each = met.withColumn("__mix_c", F.explode(F.sequence(F.lit(1).cast("long"), most)))
        used = F.filter("__mix_parts", lambda p: p["times"] >= F.col("__mix_c"))
        words = F.flatten(
            F.transform(used, lambda p: F.slice(F.col("__mix_words"), (p["first"] + 1).cast("int"), p["words"].cast("int")))
        )
        chosen = each.withColumn("__mix_chosen", words)
        whole = F.size("__mix_chosen") == F.size("__mix_words")
        text = F.when(whole, F.col("text")).otherwise(F.array_join("__mix_chosen", " "))
        out = chosen.withColumn("text", text)
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return out.select(*docs.columns)

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every document."""
        met = self._times()
        key = ["source", "doc_id", "crc", "copy"]
        sums = met.groupBy(*key).agg(F.sum(F.col("words") * F.col("times")).alias("n"))
        sums = sums.select(*[F.col(k).alias(f"_{k}") for k in key], "n")
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        known = self.docs.join(
            F.broadcast(self.sources),  # at most MOST_SOURCES rows
            F.col("source").eqNullSafe(F.col("of")),
        )
        return known.join(sums, same, "left").select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken")
        )
