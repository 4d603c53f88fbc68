"""Near duplicates by order MinHash and banded alignment.

A text's k-mers are its runs of five words, told apart by how often they came
before. For each of ``TABLES`` permutations the two least k-mers, in text order,
give one number: texts that differ by few edits share most of these. A bucket is
what agrees in a number. Its members are compared with its most popular member;
then with more and more members, turn by turn, until each pair of a bucket is in one
class, was compared, or cannot be similar by its rarest k-mers (see ``_rest``). A link
can only be missed where two texts share no number; the README has the recall.

Two texts are linked if an alignment of their k-mers, in order, matches m with
m / (a + b - m) >= ``SIMILARITY``. Texts of fewer than five words are one k-mer;
null and empty texts have none and are linked with each other. Classes are the
connected components of the links. Equal texts are one node of that graph.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventflow.llm.common import pin_python, ship
from eventflow.llm.components import components, joined, tasks_for
from eventflow.session import pin

WORDS = 5
TABLES = 12
SIMILARITY = 0.8
PART_PAIRS = 500_000  # aligned at once
PAIRS_PER_TASK = 2_000
LEAST_ALIGNING = 24
GROWTH = 16  # members of a key that have had their turn, from one turn to the next
TEXTS_PER_TASK = 10_000
BLOCK_BITS = 8192

_SEEDS = np.random.default_rng(9).integers(1, 2**63, TABLES, dtype=np.uint64) | np.uint64(1)
_POWERS = [pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(WORDS)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def kmers(texts: pa.Array) -> list[np.ndarray]:
    """The 64-bit hashes of each text's runs of five words, in order."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    values = pd.util.hash_array(np.array(known, object), categorize=False) if known else np.empty(0, np.uint64)
    codes = coded.indices.to_numpy()
    real = np.array([w != "" for w in known] + [True])[codes] if len(codes) else np.empty(0, bool)
    cuts = np.concatenate([[0], np.cumsum(real)])[ends]
    words = _mix(values)[codes[real]] if len(codes) else values
    runs = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for i, power in enumerate(_POWERS):
        runs += words[i : len(words) - WORDS + 1 + i] * np.uint64(power) if len(runs) else runs
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= WORDS:
            out.append(runs[a : b - WORDS + 1])
        else:
            short = [int(w) * p for w, p in zip(words[a:b], _POWERS, strict=False)]
            out.append(np.array([sum(short) % 2**64] if short else [], np.uint64))
    return out


def labelled(runs: np.ndarray) -> np.ndarray:
    """The k-mers told apart by how often they came before; the first of each is as it is."""
    n = len(runs)
    if len(np.unique(runs)) == n:
        return runs
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.arange(n)
    times = np.empty(n, np.uint64)
    times[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return runs + _mix(times)  # which is 0 for 0


def sketch(runs: np.ndarray) -> np.ndarray:
    """One number for each table; all zero for a text without k-mers."""
    n = len(runs)
    if not n:
        return np.zeros(TABLES, np.int64)
    ranks = _mix(labelled(runs)[:, None] * _SEEDS[None, :])
    if n == 1:
        return (ranks[0] | np.uint64(1)).astype(np.int64)
    least = np.argpartition(ranks, 1, axis=0)[:2]
    least.sort(axis=0)
    got = np.take_along_axis(ranks, least, axis=0)
    return (_mix(got[0] * np.uint64(3) + got[1]) | np.uint64(1)).astype(np.int64)


def matched(a: list[int], b: list[int], band: int) -> int:
    """The longest common subsequence that keeps within ``band`` of the diagonal.

    Columns of the alignment table are bits (set where the row above has the
    same value), in blocks; only blocks that the band touches are worked on.
    """
    blocks = [a[i : i + BLOCK_BITS] for i in range(0, len(a), BLOCK_BITS)]
    masks: list[dict[int, int]] = []
    for block in blocks:
        where: dict[int, int] = {}
        for i, x in enumerate(block):
            where[x] = where.get(x, 0) | 1 << i
        masks.append(where)
    full = [(1 << len(block)) - 1 for block in blocks]
    columns = list(full)
    for j, y in enumerate(b):
        low = max(0, (j - band) // BLOCK_BITS)
        high = min(len(blocks) - 1, (j + band) // BLOCK_BITS)
        carry = 0
        for k in range(low, high + 1):
            v = columns[k]
            hit = v & masks[k].get(y, 0)
            total = v + hit + carry
            carry = total >> len(blocks[k])
            columns[k] = (total & full[k]) | (v & ~hit)
    return sum(len(block) - v.bit_count() for block, v in zip(blocks, columns, strict=True))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the k-mers of two texts align well enough."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    total = len(a) + len(b)
    need = least * total / (1 + least)  # m / (total - m) >= least
    n = min(len(a), len(b))
    if n < need:
        return False
    same = a[:n] == b[:n]
    front = n if same.all() else int(np.argmin(same))
    rest = n - front
    same = a[len(a) - rest :][::-1] == b[len(b) - rest :][::-1]
    back = rest if same.all() else int(np.argmin(same))
    x, y = a[front : len(a) - back].tolist(), b[front : len(b) - back].tolist()
    got = front + back
    # Common k-mers at all bound those in order.
    if got + sum((Counter(x) & Counter(y)).values()) < need:
        return False
    band = int(total - 2 * need) + 1
    return got + (matched(x, y, band) if x and y else 0) >= need


def text_digest(text: Column) -> Column:
    """The SHA-256 of a text as lower-case hex; null is empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id, digest``) and one node per distinct text with its sketch, both written."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([sketch(r) for r in kmers(batch.column(2))], np.int64).reshape(-1, TABLES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(table[:, i]) for i in range(TABLES))],
                ["doc_id", "digest", *_NAMES],
            )

    ship(docs.sparkSession)
    kinds = ", ".join(f"{c} bigint" for c in _NAMES)
    given = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.col("text"))
    rows = pin_python(given.mapInArrow(sketched, f"doc_id bigint, digest string, {kinds}"))
    texts = rows.groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), *[F.max(c).alias(c) for c in _NAMES]
    )
    named = texts.select(
        F.monotonically_increasing_id().alias("node"), F.xxhash64("digest").alias("tie"), "digest", "least_id", *_NAMES
    )
    return rows.select("doc_id", "digest"), pin(named.coalesce(tasks_for(rows.count())))


_NAMES = [f"s{i}" for i in range(TABLES)]


def _aligned(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Those of about ``n`` ``pairs`` (``u, v``) whose texts are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = kmers(batch.column(2)), kmers(batch.column(3))
            good = pa.array([similar(a, b) for a, b in zip(left, right, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    one = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    other = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    both = pairs.join(one, "u").join(other, "v").select("u", "v", "text_u", "text_v")
    both = both.coalesce(max(LEAST_ALIGNING, -(-n // PAIRS_PER_TASK)))
    return pin_python(both.mapInArrow(check, "u bigint, v bigint"))


def _heads(keyed: DataFrame) -> DataFrame:
    """Pairs (``u, v``) of a bucket's members with its most popular one. The texts decide, not the
    numbers of their nodes, which differ from run to run."""
    groups = pin(
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max_by("node", "rank").alias("head"))
        .where("n > 1")
        .select(F.col("key").alias("of"), "head")
        .coalesce(tasks_for(keyed.count()))
    )
    met = keyed.join(groups, F.col("key") == F.col("of")).where("node <> head")
    return met.select(F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v")).distinct()


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Each row with the ``root`` of its node so far."""
    named = roots.select(F.col("node").alias("of_node"), "root")
    met = members.join(named, F.col("node") == F.col("of_node"), "left")
    return met.withColumn("root", F.coalesce("root", "node")).drop("of_node")


def _prefixes(texts: DataFrame) -> DataFrame:
    """``key, node, n, place, rank, size, draw``: the rarest k-mers of each text, ``n`` in all, that another text has too.

    Two texts of which m of a + b - m k-mers agree, at ``SIMILARITY`` or above, have a k-mer in
    common among the n // 5 + 1 first of each, in whatever order all texts follow. With rare ones first, a
    passage that many texts have is no key unless it is most of a text. ``rank`` is the mean log
    count of all k-mers of a text: the text that others were made from has none that only it has.
    ``draw`` lies between 0 and the ``size`` of the key, evenly, by the text's hash.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [labelled(r) for r in kmers(batch.column(2))]
            sizes = np.array([len(r) for r in runs], np.int64)
            columns = [np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1)]
            flat = np.concatenate([*runs, np.empty(0, np.uint64)]).astype(np.int64)
            given = [*columns, np.repeat(sizes, sizes), flat]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in given], ["node", "tie", "n", "key"])

    given = texts.select("node", F.xxhash64("text").alias("tie"), "text")
    each = pin_python(given.mapInArrow(split, "node bigint, tie bigint, n bigint, key bigint"))
    often = pin(each.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("key").alias("of"), "times"))
    counted = each.join(often, F.col("key") == F.col("of"), "left").withColumn("times", F.coalesce("times", F.lit(1)))
    one = Window.partitionBy("node")
    placed = counted.withColumn("place", F.row_number().over(one.orderBy("times", "key"))).withColumn(
        "rank", F.struct(F.round(F.avg(F.log("times")).over(one), 6), "tie")
    )
    keyed = pin(placed.where("times > 1 and place <= floor(n / 5) + 1").select("key", "node", "n", "place", "rank"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("key").alias("of"), "size")
    drawn = F.pmod(F.xxhash64("key", "rank.tie"), F.lit(1 << 30)) / F.lit(1 << 30) * F.col("size")
    met = keyed.join(sizes, F.col("key") == F.col("of")).withColumn("draw", drawn).drop("of")
    return pin(met.coalesce(tasks_for(keyed.count())))


def _apart(members: DataFrame, turn: int) -> DataFrame | None:
    """Pairs of members of a key in different components that are due in this turn.

    Turn 0 pairs a key's members with the best-ranked one, turn t with those whose draw is below
    ``GROWTH`` ** t and that had no turn yet. So a key has a turn only while it is in several components
    and some member had none, and what a turn lays out is at most ``GROWTH`` times what the one before did.
    Pairs too unlike in length, or with too few k-mers left after the key, cannot be similar.
    None if no key is due, now or later.
    """
    before = GROWTH ** (turn - 1) if turn > 1 else 0
    parts = members.where(F.col("size") > before).groupBy("key").agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.max(F.struct("rank", "node", "root", "n", "place")).alias("best")
    )
    mixed = pin(parts.where("a <> b").select(F.col("key").alias("of"), "best").coalesce(tasks_for(members.count())))
    if mixed.isEmpty():
        return None
    names = ("node", "root", "n", "place")
    if turn:
        due = members.where((F.col("draw") >= before) & (F.col("draw") < GROWTH**turn)).join(mixed.select("of"), F.col("key") == F.col("of"), "left_semi")
        pivots = due.select(F.col("key").alias("of"), *[F.col(c).alias(f"{c}2") for c in names])
    else:
        pivots = mixed.select("of", *[F.col(f"best.{c}").alias(f"{c}2") for c in names])
    need = F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("n") + F.col("n2")) - 1e-6
    left = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1
    met = members.join(pivots, (F.col("key") == F.col("of")) & (F.col("root") != F.col("root2")) & (left >= need))
    return met.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct()


def _rest(ours: DataFrame, texts: DataFrame, roots: DataFrame, tested: DataFrame) -> DataFrame:
    """``roots`` with the links among what the heads left apart.

    A bucket is open if it has three members or more and they are in different components. Members of
    open buckets are compared within the keys of ``_prefixes``, turn by turn, until every pair of a key
    is tested, in one component, or cannot be similar. Components are taken in after every turn.
    """
    members = _rooted(ours.where("n > 2").select("key", "node"), roots)
    unsettled = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    wanted = pin(members.join(unsettled.select("key"), "key", "left_semi").select("node").distinct().coalesce(tasks_for(ours.count())))
    if wanted.isEmpty():
        return roots
    keyed = _prefixes(texts.join(wanted, "node"))
    rows = keyed.count()
    turn = 0
    while (due := _apart(pin(_rooted(keyed, roots).coalesce(tasks_for(rows))), turn)) is not None:
        pairs = pin(due.join(tested, ["u", "v"], "left_anti").coalesce(tasks_for(rows)))
        n = pairs.count()
        parts = -(-n // PART_PAIRS)
        for i in range(parts):
            some = pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(parts)) == i) if parts > 1 else pairs
            if i:  # what earlier parts have put into one component is settled
                for c in ("u", "v"):
                    to = roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
                    some = some.join(to, c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
                some = some.where("root_u <> root_v").select("u", "v")
            roots = joined(roots, _aligned(some, texts, min(n, PART_PAIRS)))
        tested = tested.unionByName(pairs)
        turn += 1
    return roots


def linked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, root`` by the links between nodes: candidates by bucket, each one aligned.

    A node's rank grows with how many nodes share its numbers. A text that others
    were made from keeps more of theirs than they have of each other, so the member
    of highest rank is the one to compare a bucket with first. ``_rest`` does all others.
    """
    sketches = F.array(
        *[F.struct(F.lit(1 << i).alias("mask"), F.xxhash64(F.lit(i), F.col(c)).alias("key")) for i, c in enumerate(_NAMES)]
    )
    rows = nodes.count()
    tasks = tasks_for(rows * TABLES)
    single = nodes.select("node", "tie", F.explode(sketches).alias("k")).select("node", "tie", "k.key")
    shared = pin(single.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("of"), "n").coalesce(tasks))
    ours = pin(single.join(shared, F.col("key") == F.col("of")).select("node", "tie", "key", "n").coalesce(tasks))
    # How popular, in steps of about one per cent, above 51 bits of the text's hash.
    popular = F.floor(F.log2(F.sum("n")) * 64) * F.lit(1 << 51)
    involved = pin(ours.groupBy("node", "tie").agg((popular + F.pmod("tie", F.lit(1 << 51))).alias("rank")).coalesce(tasks_for(rows)))
    wanted = nodes.join(involved.select("node"), "node").select("node", F.col("digest").alias("of"))
    given = docs.select(text_digest(F.col("text")).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    met = given.join(wanted, F.col("d") == F.col("of"))
    texts = pin(met.groupBy("node").agg(F.first("text").alias("text")).coalesce(max(LEAST_ALIGNING, -(-rows // TEXTS_PER_TASK))))

    ranked = pin(ours.select("node", "key").join(involved.select("node", "rank"), "node").coalesce(tasks))
    tested = pin(_heads(ranked).coalesce(tasks))
    return _rest(ours, texts, components(_aligned(tested, texts, tested.count())), tested)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept, digest``.

    ``class_id`` is the least id in the class; ``kept`` marks the rows of the
    text that has it. Null ids count as larger than any; a class of null ids
    only has a null ``class_id``. ``digest`` is the SHA-256 of the text.
    """
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, nodes = _nodes(given)
    roots = linked(given, nodes)
    named = nodes.select("node", "digest", "least_id")
    tasks = tasks_for(nodes.count())
    named = pin(named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).coalesce(tasks))
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    sizes = named.join(copies, "digest").select("root", "copies", "least_id", "digest")
    order = F.struct(F.col("least_id").isNull(), F.col("least_id"), F.col("digest"))
    classes = pin(
        sizes.groupBy("root").agg(F.sum("copies").alias("class_size"), F.min(order).alias("first"))
        .select(F.col("root").alias("of_root"), "class_size", F.col("first.least_id").alias("class_id"), F.col("first.digest").alias("keeper"))
        .coalesce(tasks)
    )
    decided = pin(
        named.join(classes, F.col("root") == F.col("of_root")).select(
            F.col("digest").alias("of"), "class_id", "class_size", "least_id", (F.col("digest") == F.col("keeper")).alias("best")
        ).coalesce(tasks)
    )
    return rows.join(decided, F.col("digest") == F.col("of")).select(
        "doc_id",
        "class_id",
        "class_size",
        (F.col("best") & F.col("doc_id").eqNullSafe(F.col("least_id"))).alias("kept"),
        "digest",
    )
