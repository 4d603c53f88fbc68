"""Strings of ``LENGTH`` bytes that appear earlier in the corpus are taken out of its texts.

Every window of ``LENGTH`` bytes has an anchor: the stretch of ``CORE`` bytes in it with
the least hash, the first of equals. Equal windows have equal anchors at equal places, so
only windows whose anchor appears twice need a look, and an anchor stands for all the
neighbouring windows that chose it (its extent: their bytes together).

1. Anchors are counted by hash; those that appear once are dropped.
2. Extents that are equal as a whole form a class. All windows of its members but the
   first are repeats. Large groups of copies end here, in a partial aggregate.
3. First members whose anchor has other classes are laid side by side, anchor by anchor,
   and sorted as suffixes from the anchor on (``suffix_sort``). Windows are equal where a
   run of neighbours shares enough to the right and the bytes to the left agree.
4. An anchor with more than ``MOST`` classes, as in a line that stands in very many texts,
   is split: half of its windows get a longer stretch around the anchor as their key, the
   other half another one, down to single windows.
5. Repeated windows are gathered by text, and their bytes removed.

Positions are ordered by key, then by hash of the text, then by place. Null keys come
last. Null texts are empty. Of rows equal in key and text one counts as the first.
Texts move compressed; they are written once, bucketed by key, for the joins.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.llm.common import arrow_batches, new_folder, partitions, pin_python, ship
from eventflow.llm.suffix_sort import Hashed, sorted_suffixes
from eventflow.session import pin

LENGTH = 100
CORE = 24
SPAN = LENGTH - CORE + 1  # places an anchor can have in a window
MOST = 2_000
SEGMENT = 1 << 19  # bytes looked at together (twice that at most); places fit 24 bits
SORTED_BYTES = 2 << 20

_LAST = 2**63 - 1
_RANGE = "id bigint, th bigint, first bigint, last bigint"


# Anchors


def anchors(buffer: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of a buffer of texts: (hash, place, first window, last window).

    ``doc`` tells the text of each byte; windows lie in one text.
    """
    n = len(buffer) - LENGTH + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    text = Hashed(buffer)
    cores = np.arange(len(buffer) - CORE + 1)
    hashes = text.at(cores, CORE)
    mixed = hashes ^ (hashes >> np.uint64(31))
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << 24) - 1)
    value = (mixed & ~low) | cores.astype(np.uint64)  # ties go to the first
    # Least of every SPAN neighbours: from the right inside blocks, and from the left.
    m = len(value)
    whole = -(-m // SPAN) * SPAN
    padded = np.full(whole, np.uint64(2**64 - 1))
    padded[:m] = value
    blocks = padded.reshape(-1, SPAN)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(from_right[:n], from_left[SPAN - 1 : SPAN - 1 + n])
    valid = np.flatnonzero(doc[:n] == doc[LENGTH - 1 :])
    if not len(valid):
        return hashes[:0], valid, valid, valid
    chosen = (least[valid] & low).astype(np.int64)
    new = np.flatnonzero(
        np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1] + 1)])
    )
    ends = np.concatenate([new[1:], [len(valid)]]) - 1
    place = chosen[new]
    return hashes[place], place, valid[new], valid[ends]


def _segments(sizes: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) of about SEGMENT bytes; longer texts in overlapping parts."""
    held, total = [], 0
    for i, size in enumerate(sizes):
        for low in range(0, max(1, size - LENGTH + 1), SEGMENT):
            high = min(size, low + SEGMENT + LENGTH - 1)
            if total + high - low > 2 * SEGMENT:
                yield held
                held, total = [], 0
            held.append((i, low, high))
            total += high - low
    if held:
        yield held


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        for parts in _segments(np.diff(ends)):
            buffer = np.concatenate([data[ends[i] + lo : ends[i] + hi] for i, lo, hi in parts])
            lengths = np.array([hi - lo for _, lo, hi in parts])
            part = np.repeat(np.arange(len(parts)), lengths)
            core, place, first, last = anchors(buffer, part)
            of = part[first] if len(first) else np.empty(0, np.int64)
            shift = np.array([lo for _, lo, _ in parts]) - (np.cumsum(lengths) - lengths)
            which = pa.array(np.array([i for i, _, _ in parts])[of])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(which),
                    batch.column(1).take(which),
                    pa.array(core.view(np.int64)),
                    *(pa.array(x + shift[of]) for x in (place, first, last)),
                ],
                ["id", "th", "key", "at", "first", "last"],
            )


# Texts, compressed and bucketed


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        bodies = [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], ["id", "th", "body"]
        )


class _Texts:
    """All texts in a table bucketed by (id, th), which joins on both read in place."""

    def __init__(self, given: DataFrame):
        spark = given.sparkSession
        self.spark, self.name = spark, f"texts_{uuid.uuid4().hex}"
        n = partitions(spark)
        spark.sql(
            f"CREATE TABLE {self.name} (id BIGINT, th BIGINT, body BINARY) USING parquet "
            f"CLUSTERED BY (id, th) SORTED BY (id, th) INTO {n} BUCKETS "
            f"LOCATION '{new_folder(spark, 'texts')}'"
        )
        with arrow_batches(spark):
            packed = given.mapInArrow(_packed, "id bigint, th bigint, body binary")
            packed.repartition(n, "id", "th").write.mode("append").insertInto(self.name)

    def with_places(self, places: DataFrame, how: str) -> DataFrame:
        """Texts joined with ``places`` of them, gathered in a list (as many as a text has at most)."""
        columns = [c for c in places.columns if c not in ("id", "th")]
        lists = places.groupBy("id", "th").agg(F.collect_list(F.struct(*columns)).alias("places"))
        return self.spark.table(self.name).join(lists.hint("merge"), ["id", "th"], how)


def _extent_hash(bodies: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(bodies, object), categorize=False).view(np.int64)


def _extents(keep_bytes: bool):
    """Rows (key, same, id, th, at, first, last[, body]) of the listed anchors of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                places = batch.column(3)[i].values
                names = [f.name for f in places.type]
                key, at, first, last = (
                    places.field(names.index(c)).to_numpy() for c in ("key", "at", "first", "last")
                )
                text = open_(batch.column(2)[i].as_py())
                bodies = [text[a : b + LENGTH] for a, b in zip(first, last, strict=True)]
                # Equal extents must also lie alike around the anchor.
                same = _extent_hash(bodies) ^ ((at - first) * 0x9E3779B1)
                n = len(bodies)
                out = [
                    pa.array(key),
                    pa.array(same),
                    pa.array(np.full(n, batch.column(0)[i].as_py(), np.int64)),
                    pa.array(np.full(n, batch.column(1)[i].as_py(), np.int64)),
                    pa.array(at),
                    pa.array(first),
                    pa.array(last),
                ]
                named = ["key", "same", "id", "th", "at", "first", "last"]
                if keep_bytes:
                    out.append(pa.array(bodies, pa.binary()))
                    named.append("body")
                yield pa.RecordBatch.from_arrays(out, named)

    return rows


_EXTENT = "key bigint, same bigint, id bigint, th bigint, at bigint, first bigint, last bigint"


# Classes


def _classes(extents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated windows of members that are not first, first members whose key has other classes)."""
    order = F.struct("id", "th", "at", "first", "last")
    groups = extents.groupBy("key", "same").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n"))
    classes = pin(groups.select(F.col("key").alias("k"), F.col("same").alias("s"), "head", "n"))
    several = classes.where("n > 1").select("k", "s", "head")
    met = extents.join(several, (F.col("key") == F.col("k")) & (F.col("same") == F.col("s")))
    repeats = met.where(order != F.col("head")).select("id", "th", "first", "last")
    mixed = classes.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("k").alias("mk"))
    firsts = classes.join(mixed, F.col("k") == F.col("mk")).select(F.col("k").alias("key"), "head.*")
    return repeats, firsts


def repeated_windows(
    key: np.ndarray, rank: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, bodies: list[bytes]
) -> np.ndarray:
    """For each extent and offset of the anchor in a window: whether an extent of lower rank has that window.

    Equal windows have equal keys, so extents of many keys can be looked at together.
    """
    n = len(bodies)
    found = np.zeros((n, SPAN), bool)
    lengths = np.fromiter(map(len, bodies), np.int64, n)
    text = Hashed(np.frombuffer(b"".join(bodies), np.uint8))
    begin = np.cumsum(lengths) - lengths
    anchor = begin + (at - first)
    order, shared = sorted_suffixes(text, anchor, np.minimum(begin + lengths - anchor, LENGTH))
    sorted_at, sorted_rank = anchor[order], rank[order]
    near, far = (at - last)[order], (at - first)[order]
    for o in range(SPAN):
        mine = np.flatnonzero((near <= o) & (o <= far))
        if len(mine) < 2:
            continue
        run = np.cumsum(shared < LENGTH - o)[mine]
        met = run[1:] == run[:-1]
        several = np.concatenate([[False], met]) | np.concatenate([met, [False]])
        run, mine = run[several], mine[several]
        if not len(mine):
            continue
        left = text.at(sorted_at[mine] - o, o)
        by = np.lexsort((sorted_rank[mine], left, run))
        r, h, m = run[by], left[by], mine[by]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
        head = m[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = np.flatnonzero(~new)
        if not len(later):
            continue
        column = np.arange(o)
        a = text.bytes[(sorted_at[m[later]] - o)[:, None] + column]
        b = text.bytes[(sorted_at[head[later]] - o)[:, None] + column]
        if (a == b).all():
            found[order[m[later]], o] = True
        else:  # a hash misled: by the bytes themselves
            seen: set[tuple[int, bytes]] = set()
            for x, j in zip(run[np.argsort(sorted_rank[mine])], mine[np.argsort(sorted_rank[mine])], strict=True):
                what = (int(x), text.bytes[sorted_at[j] - o : sorted_at[j]].tobytes())
                found[order[j], o] = what in seen
                seen.add(what)
    return found


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows among rows (key, id, th, at, first, last, body) that come ordered by key."""

    def done(rows: pd.DataFrame) -> pa.RecordBatch:
        place = rows[["id", "th", "at"]].to_numpy()
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((place[:, 2], place[:, 1], place[:, 0]))] = np.arange(len(rows))
        at = place[:, 2]
        found = repeated_windows(
            rows["key"].to_numpy(), rank, at, rows["first"].to_numpy(), rows["last"].to_numpy(), list(rows["body"])
        )
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(place[i, 0]), pa.array(place[i, 1]), pa.array(at[i] - high + 1), pa.array(at[i] - low)],
            ["id", "th", "first", "last"],
        )

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        rows = batch.to_pandas()
        size += int(rows["body"].map(len).sum())
        held.append(rows)
        if size >= SORTED_BYTES:
            rows = pd.concat(held, ignore_index=True)
            rest = rows["key"] == rows["key"].iloc[-1]  # its other rows may still come
            if not rest.all():
                yield done(rows[~rest])
                rows = rows[rest]
            held, size = [rows], int(rows["body"].map(len).sum())
    if held and sum(map(len, held)):
        yield done(pd.concat(held, ignore_index=True))


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's windows in two halves of its offsets, keyed by the bytes all of a half have."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("key", "same", "id", "th", "at", "first", "last", "x", "y", "body")}
        for r in batch.to_pylist():
            middle = (r["x"] + r["y"]) // 2
            for x, y in ((r["x"], middle), (middle, r["y"])):
                low, high = max(r["first"], r["at"] - y + 1), min(r["last"], r["at"] - x)
                if low > high:
                    continue
                a = r["at"] - x - r["first"]
                core = r["body"][a : a + LENGTH + 1 - (y - x)]
                label = core + bytes((x, y))
                row = r | {
                    "key": int.from_bytes(hashlib.blake2b(label, digest_size=8).digest(), "little", signed=True),
                    "first": low,
                    "last": high,
                    "x": x,
                    "y": y,
                    "body": r["body"][low - r["first"] : high - r["first"] + LENGTH],
                }
                row["same"] = int(_extent_hash([row["body"]])[0]) ^ ((row["at"] - low) * 0x9E3779B1)
                for c in out:
                    out[c].append(row[c])
        kinds = {"x": pa.int32(), "y": pa.int32(), "body": pa.binary()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], list(out)
        )


def _removals(firsts: DataFrame) -> DataFrame:
    """Repeated windows among first members (``_EXTENT`` without same, plus ``x, y, body``)."""
    found = None
    while True:
        sizes = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        large = pin(sizes.where(F.col("m") > MOST).select(F.col("key").alias("lk")))
        small = firsts.join(large, F.col("key") == F.col("lk"), "left_anti")
        columns = ["key", "id", "th", "at", "first", "last", "body"]
        ordered = small.select(*columns).repartition("key").sortWithinPartitions("key")
        sorted_ = pin_python(ordered.mapInArrow(_sorted_rows, _RANGE))
        found = sorted_ if found is None else found.unionByName(sorted_)
        if large.isEmpty():
            return found
        crowded = firsts.join(large, F.col("key") == F.col("lk"), "left_semi")
        halves = pin_python(
            crowded.select(*columns, "x", "y").mapInArrow(_halved, _EXTENT + ", x int, y int, body binary")
        )
        repeats, heads = _classes(halves.drop("x", "y", "body"))
        found = found.unionByName(pin(repeats))
        where = [F.col(c) == F.col(f"h_{c}") for c in ("key", "id", "th", "at", "first", "last")]
        named = heads.select(*[F.col(c).alias(f"h_{c}") for c in ("key", "id", "th", "at", "first", "last")])
        firsts = pin(halves.join(named, where, "left_semi").drop("same"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the listed windows out of each text. Rows come ordered by (id, th)."""
    open_ = zstandard.ZstdDecompressor().decompress
    before = None
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            row = tuple(batch.column(c)[i].as_py() for c in range(3))
            text = np.frombuffer(open_(row[2]), np.uint8)
            gone = np.zeros(len(text) + 1, np.int64)
            places = batch.column(3)[i]
            if before == row and len(text) >= LENGTH:  # a further copy of the same row
                gone[0] += 1
                gone[len(text)] -= 1
            elif places.is_valid:
                names = [f.name for f in places.values.type]
                first, last = (places.values.field(names.index(c)).to_numpy() for c in ("first", "last"))
                np.add.at(gone, first, 1)
                np.add.at(gone, last + LENGTH, -1)
            cut = np.cumsum(gone)[:-1] > 0
            spans = int(np.count_nonzero(np.diff(np.concatenate([[0], cut.astype(np.int8)])) == 1))
            kept = hashlib.sha256(text[~cut].tobytes()).hexdigest()
            out.append((None if row[0] == _LAST else row[0], len(text), int(cut.sum()), spans, kept))
            before = row
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in out], kinds[c]) for c in range(5)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def find_repeats(texts: _Texts, given: DataFrame) -> DataFrame:
    """Windows (first to last start, in text (id, th)) that also start earlier."""
    kinds = "id bigint, th bigint, key bigint, at bigint, first bigint, last bigint"
    every = given.mapInArrow(_anchor_rows, kinds)
    twice = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    with arrow_batches(given.sparkSession):
        known = pin(twice.select(F.col("key").alias("k")))
        suspects = pin(every.join(known, F.col("key") == F.col("k"), "left_semi"))
    extents = pin_python(texts.with_places(suspects, "inner").mapInArrow(_extents(False), _EXTENT))
    repeats, firsts = _classes(extents)
    bodies = pin_python(
        texts.with_places(firsts, "inner").mapInArrow(_extents(True), _EXTENT + ", body binary")
    )
    rows = bodies.drop("same").withColumns({"x": F.lit(0), "y": F.lit(SPAN)})
    return pin(repeats).unionByName(_removals(rows))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    ship(docs.sparkSession)
    given = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    texts = _Texts(given)
    found = find_repeats(texts, given)
    listed = texts.with_places(found, "left").sortWithinPartitions("id", "th", "body")
    kinds = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return pin_python(listed.mapInArrow(_cut, kinds))
