"""Find faults in conversations and repair their role order with the cheapest edits.

Rows are put in order over many tasks and numbered, faults are found with joins on those numbers, and
every stretch of at most ``SEGMENT`` rows of a conversation becomes a sequence of letters. Distinct
sequences, counted, are compressed with Re-Pair: in each round the most frequent neighbours become a
rule. Each rule has one matrix (``repair_grammar``), which all sequences share. Conversations of several
stretches multiply their matrices in a tree of ``FAN_IN`` children and hand the chosen states down again,
so no task holds more than a stretch or a few matrices of one conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventflow.llm import repair_grammar as grammar
from eventflow.llm.common import pin_python, ship
from eventflow.llm.conversations import Sha256, fold_keys, in_order
from eventflow.session import pin

SEGMENT_BITS = 10  # rows of a stretch: at most 1,024
FAN_IN = 64
ROUNDS, RULES_EACH = 12, 64

_SPACE = r"\x20\x09-\x0D"
_EMPTY_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
_NODES = "conv_id bigint, idx bigint, costs array<bigint>, audits array<string>"


def damage(rows: DataFrame) -> DataFrame:
    """Faults for trying out a repair, by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 takes ``[.!?]`` out, 3 repeats it, 4 makes its role user.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    marked = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        spaced("role").alias("role"),
        spaced("text").alias("text"),
        kind.alias("kind"),
    ).where("kind <> 0")
    changed = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _marks(rows: DataFrame) -> DataFrame:
    """Per row, without its text: place, stretch, role class and first fault."""
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    ended = F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    named = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    initial = F.substring("role", 1, 1)
    seen = rows.select(
        "place",
        "conv_id",
        "turn",
        F.shiftright("place", SEGMENT_BITS).alias("block"),
        F.when(initial.isin(*"sua"), initial).otherwise(F.lit("x")).alias("initial"),
        F.when(blank, grammar.BLANK).when(ended, grammar.OK).otherwise(grammar.TRUNCATED).alias("own"),
        F.unhex(F.sha2(named, 256)).alias("digest"),
    )
    firsts = seen.groupBy("conv_id", "digest").agg(F.min("place").alias("first")).select("first")
    met = seen.join(firsts, F.col("place") == F.col("first"), "left")
    fault = F.when(F.col("first").isNull() & (F.col("own") != grammar.BLANK), grammar.DUPLICATE)
    marked = met.select(
        "place", "conv_id", "turn", "block", "initial", fault.otherwise(F.col("own")).alias("fault")
    )
    code = 4 * (F.instr(F.lit(grammar.ROLES), F.col("initial")) - 1) + F.col("fault")
    return pin(marked.withColumn("letter", F.char(F.lit(grammar.FIRST_LETTER) + code)))


def _segments(marks: DataFrame) -> DataFrame:
    """Per conversation and stretch: places and letters in order, and its number in the conversation."""
    rows = F.array_sort(F.collect_list(F.struct("place", "letter", "initial")))
    made = marks.groupBy("conv_id", "block").agg(rows.alias("rows"))
    stretches = made.select(
        "conv_id",
        "block",
        F.col("rows.place").alias("places"),
        F.array_join("rows.letter", "").alias("letters"),
        F.array_join("rows.initial", "").alias("roles"),
    )
    inside = Window.partitionBy("conv_id").orderBy("block")
    border = F.concat(F.lag(F.right("roles", F.lit(1)), 1, "").over(inside), F.left("roles", F.lit(1)))
    legal = F.regexp_count("roles", F.lit("(?=su|ua|au)")) + F.when(
        border.isin("su", "ua", "au"), 1
    ).otherwise(0)
    pairs = F.length("roles") - F.when(F.length(border) == 2, 0).otherwise(1)
    return pin(
        stretches.select(
            "conv_id",
            "places",
            "letters",
            (F.row_number().over(inside) - 1).cast("long").alias("idx"),
            (pairs - legal).cast("long").alias("illegal"),
            F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("stretches"),
        )
    )


def _counts(marks: DataFrame, segments: DataFrame) -> DataFrame:
    def having(fault: int) -> Column:
        return F.sum(F.when(F.col("fault") == fault, 1).otherwise(0)).cast("long")

    turns = marks.groupBy("conv_id", "turn").agg(
        having(grammar.BLANK).alias("blank"),
        having(grammar.DUPLICATE).alias("duplicate"),
        having(grammar.TRUNCATED).alias("truncated"),
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    per_conv = turns.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"),
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")],
    )
    illegal = segments.groupBy(F.col("conv_id").alias("of")).agg(F.sum("illegal").alias("illegal"))
    return per_conv.join(illegal, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def learn_rules(sequences: DataFrame, rounds: int = ROUNDS, each: int = RULES_EACH) -> list[tuple[str, str]]:
    """Re-Pair over all of ``letters, n``: rules (pair, symbol) in the order they were made.

    A round counts all neighbours and takes the most frequent pairs that share no symbol, ``each`` at
    most. It ends when no pair occurs twice, or after ``rounds``: what is not compressed then is
    multiplied symbol by symbol, with the same result.
    """
    rules: list[tuple[str, str]] = []
    ship(sequences.sparkSession)
    for _ in range(rounds):
        known = list(rules)

        def pairs(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                texts = [grammar.apply_rules(t, known) for t in texts]
                found = grammar.count_pairs(zip(texts, counts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pair", "n"]
                )

        counted = sequences.select("letters", "n").mapInArrow(pairs, "pair string, n bigint")
        often = counted.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        best = often.orderBy(F.desc("n"), "pair").limit(4 * each).collect()
        made = grammar.choose_pairs([row.pair for row in best], rules, each)
        if not made:
            break
        rules += made
    return rules


def _evaluated(sequences: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``letters, costs, audits``: the matrix of each distinct sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grammar.Grammar(rules)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 500):
                part = texts[at : at + 500]
                costs, audits = zip(*(grammar.packed(known.matrix(t)) for t in part), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.string()),
                        pa.array(costs, pa.list_(pa.int64())),
                        pa.array(audits, pa.list_(pa.string())),
                    ],
                    ["letters", "costs", "audits"],
                )

    return sequences.select("letters").mapInArrow(
        run, "letters string, costs array<bigint>, audits array<string>"
    )


def _combined(nodes: DataFrame) -> DataFrame:
    """One level up: the product of each ``FAN_IN`` neighbouring nodes of a conversation."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        made = None
        for costs, audits in zip(rows["costs"], rows["audits"], strict=True):
            one = grammar.unpacked(costs, audits)
            made = one if made is None else grammar.product(made, one)
        costs, audits = grammar.packed(made)
        return pd.DataFrame({"conv_id": [key[0]], "idx": [key[1]], "costs": [costs], "audits": [audits]})

    parents = nodes.groupBy("conv_id", (F.floor(F.col("idx") / FAN_IN)).alias("parent"))
    return parents.applyInPandas(run, _NODES)


def _roots(nodes: DataFrame) -> DataFrame:
    """Of whole conversations: cost, audit, state before closing inserts, and those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [
                grammar.best_end(grammar.unpacked(c, a))
                for c, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            if ends:
                costs, audits, states, tails = zip(*ends, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(costs, pa.int64()),
                        pa.array(audits, pa.string()),
                        pa.array(states, pa.int32()),
                        pa.array(tails, pa.string()),
                    ],
                    ["conv_id", "cost", "path", "state", "tail"],
                )

    schema = "conv_id bigint, cost bigint, path string, state int, tail string"
    return nodes.select("conv_id", "costs", "audits").mapInArrow(run, schema)


def _handed_down(children: DataFrame, chosen: DataFrame) -> DataFrame:
    """The states around each child on its parent's way: ``conv_id, idx, start, state``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        matrices = [grammar.unpacked(c, a) for c, a in zip(rows["costs"], rows["audits"], strict=True)]
        path = grammar.best_path(matrices, int(rows["p_start"].iloc[0]), int(rows["p_state"].iloc[0]))
        starts, states = zip(*path, strict=True)
        return pd.DataFrame({"conv_id": rows["conv_id"].array, "idx": rows["idx"].array, "start": starts, "state": states})

    above = chosen.select(
        F.col("conv_id").alias("p_conv"), F.col("idx").alias("p_idx"),
        F.col("start").alias("p_start"), F.col("state").alias("p_state"),
    )
    of = F.floor(F.col("idx") / FAN_IN)
    met = children.withColumn("parent", of).join(
        above, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("parent") == F.col("p_idx"))
    )
    return met.groupBy("conv_id", "parent").applyInPandas(
        run, "conv_id bigint, idx bigint, start int, state int"
    )


def _solved(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation cost and audit, and per stretch its states and its part of the audit."""
    sequences = pin(segments.groupBy("letters").agg(F.count(F.lit(1)).alias("n")))
    matrices = pin_python(_evaluated(sequences, learn_rules(sequences)))
    nodes = pin(segments.select("conv_id", "idx", "stretches", "letters").join(matrices, "letters").drop("letters"))
    whole = nodes.where("stretches = 1")
    levels = [nodes.where("stretches > 1")]
    most = nodes.agg(F.max("stretches")).first()[0] or 0
    while most > 1:
        levels.append(pin_python(_combined(levels[-1])))
        most = -(-most // FAN_IN)
    shape = [part.split()[0] for part in _NODES.split(", ")]
    tops = whole.select(*shape) if len(levels) == 1 else whole.select(*shape).unionByName(levels[-1].select(*shape))
    roots = pin_python(_roots(tops))
    chosen = roots.select("conv_id", F.lit(0).cast("long").alias("idx"), F.lit(0).alias("start"), "state")
    if len(levels) > 1:
        several = levels[-1].select(F.col("conv_id").alias("of"))
        top = chosen.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
        for level in reversed(levels[:-1]):
            top = pin_python(_handed_down(level.select(*shape), top))
        alone = whole.select(F.col("conv_id").alias("of"))
        single = chosen.join(alone, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
        chosen = single.unionByName(top)
    at = F.col("start") * grammar.STATES + F.col("state")
    ways = chosen.withColumnsRenamed({"conv_id": "c_conv", "idx": "c_idx"})
    parts = nodes.join(
        ways, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("idx") == F.col("c_idx"))
    ).select("conv_id", "idx", "start", F.get("audits", at).alias("part"))
    return roots, parts


def _edits(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """Per row: ``place``, roles inserted before it, its edit, and its new role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, start, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, edits, roles = zip(*grammar.rows_of(part, start), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(places, pa.int64()),
                        pa.array(before, pa.list_(pa.string())),
                        pa.array(edits, pa.string()),
                        pa.array(roles, pa.string()),
                    ],
                    ["edited", "before", "edit", "new_role"],
                )

    named = parts.withColumnsRenamed({"conv_id": "p_conv", "idx": "p_idx"})
    met = segments.join(
        named, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("idx") == F.col("p_idx"))
    )
    return met.select("places", "start", "part").mapInArrow(
        run, "edited bigint, before array<string>, edit string, new_role string"
    )


def _tails(roots: DataFrame) -> DataFrame:
    """Rows inserted after the last one."""
    follow = F.when(F.col("state") == 2, F.array(F.lit("assistant"))).otherwise(
        F.array(F.lit("user"), F.lit("assistant"))
    )
    return roots.where("tail <> ''").select(
        "conv_id",
        F.lit((1 << 63) - 1).alias("place"),
        F.posexplode(F.slice(follow, 1, F.length("tail"))).alias("sub", "role"),
        F.lit("").alias("text"),
        F.lit("I").alias("edit"),
    )


def _repaired(rows: DataFrame, edits: DataFrame, roots: DataFrame) -> DataFrame:
    met = rows.join(edits, F.col("place") == F.col("edited"))
    inserted = met.where("size(before) > 0").select(
        "conv_id",
        "place",
        F.posexplode("before").alias("sub", "role"),
        F.lit("").alias("text"),
        F.lit("I").alias("edit"),
    )
    stayed = met.where("edit <> 'D'").select(
        "conv_id", "place", F.lit(9).alias("sub"), F.coalesce("new_role", "role").alias("role"), "text", "edit"
    )
    return stayed.unionByName(inserted).unionByName(_tails(roots))


@dataclass
class Repair:
    """``audits``: a row per conversation; ``turns``: the repaired rows."""

    audits: DataFrame
    turns: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Faults and cheapest edits of all conversations in ``rows`` (conv_id, turn, role, text).

    A conversation's rows stand by turn, null first, ties by role and text; rows without conv_id are
    one conversation, and other columns are left out. Null roles and texts count as one space. The
    first fault of a row counts: blank, duplicate (role and text seen before in the conversation),
    truncated (the last character that is not white space is none of ``.!?``). A role's initial is its
    first character; where that is none of s, u, a the row cannot be kept as it is.

    ``audits``: conv_id, gaps, blank, duplicate, truncated, illegal (neighbours other than su, ua, au),
    cost and audit (of the edits in order, the least by ASCII of the cheapest). ``turns``: conv_id,
    place, sub (these two order a conversation's rows), role, text, edit (K, R or I). Conversations
    without rows are in neither; one of which nothing stays is in ``audits`` only.
    """
    read = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")],
    )
    placed = pin(in_order(read).withColumn("place", F.monotonically_increasing_id()))
    marks = _marks(placed)
    segments = _segments(marks)
    roots, parts = _solved(segments)
    edits = pin_python(_edits(segments, pin(parts)))
    costs = roots.select(
        F.col("conv_id").alias("of"), "cost", F.translate("path", "L", "K").alias("audit")
    )
    counts = _counts(marks, segments)
    audits = counts.join(costs, counts["conv_id"].eqNullSafe(costs["of"])).drop("of")
    return Repair(audits, _repaired(placed, edits, roots))


class _Lines:
    """Digest of ``role:text`` lines."""

    def __init__(self):
        self._digest, self._lines = Sha256(), 0

    def add(self, batch: pa.RecordBatch) -> None:
        for row in batch.to_pylist():
            self._digest.add(("\n" if self._lines else "") + row["role"] + ":" + row["text"])
            self._lines += 1

    def end(self) -> tuple:
        return (self._digest.hex(),)


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of the repaired ``role:text`` lines."""
    rows = turns.select("conv_id", "place", "sub", "role", "text")
    return pin_python(
        fold_keys(rows, "conv_id", ["place", "sub"], _Lines, "conv_id bigint, repaired_sha256 string")
    )


def summary(original: DataFrame, repaired: Repair) -> DataFrame:
    """One row per conv_id of ``original``; those of which no rows were given have zeros."""
    every = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    audits = repaired.audits.withColumnRenamed("conv_id", "a_conv")
    digests = turn_digests(repaired.turns).withColumnRenamed("conv_id", "d_conv")
    met = every.join(audits, F.col("conv_id").eqNullSafe(F.col("a_conv")), "left").join(
        digests, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left"
    )
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return met.select(
        "conv_id",
        *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(_EMPTY_DIGEST)).alias("repaired_sha256"),
    )
