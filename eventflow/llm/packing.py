"""Pack documents into sequences of bounded length, few sequences being the aim.

Documents longer than a sequence are cut into full pieces; the first piece takes
the remainder. What is packed is the count of pieces of each length, so the plan
depends on the capacity and not on the number of documents:

1. Pieces above a third of the capacity are large. At most two fit a sequence;
   from the longest down, each is matched with the longest large partner that fits.
2. Smaller pieces, longest first, go where the least room is left that holds them.

Then every piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import pin_python, preceding_sum, ship
from eventflow.llm.tokens import encoder


class _Bins:
    """Groups of equally filled sequences: (count, runs of (length, copies)) by room left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, room: int, count: int, runs: tuple) -> None:
        if count:
            if not self.groups[room]:
                insort(self.rooms, room)
            self.groups[room].append((count, runs))

    def take(self, length: int) -> tuple[int, int, tuple]:
        """A group with the least room for ``length``, taken out; new sequences if none has it."""
        i = bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return self.capacity, 0, ()
        room = self.rooms[i]
        count, runs = self.groups[room].pop()
        if not self.groups[room]:
            del self.rooms[i]
        return room, count, runs

    def put(self, length: int, count: int) -> None:
        """Best fit of ``count`` pieces of one length, as if one by one."""
        while count:
            room, bins, runs = self.take(length)
            each = room // length
            if not bins:
                bins = -(-count // each)
            full = min(bins, count // each)
            last = count - full * each if full < bins else 0
            self.add(room - each * length, full, (*runs, (length, each)) if full else ())
            if last:
                self.add(room - last * length, 1, (*runs, (length, last)))
            if runs:  # only groups that were there before have sequences left over
                self.add(room, bins - full - bool(last), runs)
            count -= full * each + last


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places of pieces of each length: (length, first rank, sequences, copies, first sequence, offset).

    Rank ``r`` of a length lies in the row with first rank <= r < first rank +
    sequences * copies; sequence and offset follow by division.
    """
    left = {n: c for n, c in counts.items() if c}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    bins = _Bins(capacity)
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1  # the longest partner that fits
        if i < 0:
            bins.add(capacity - a, left[a], ((a, 1),))
            large.pop()
            continue
        b = large[i]
        pairs = left[a] // 2 if a == b else min(left[a], left[b])
        if a == b:
            bins.add(capacity - 2 * a, pairs, ((a, 2),))
            bins.add(capacity - a, left[a] % 2, ((a, 1),))
            large.pop()
            continue
        bins.add(capacity - a - b, pairs, ((a, 1), (b, 1)))
        for n in (a, b):
            left[n] -= pairs
            if not left[n]:
                large.remove(n)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        bins.put(n, left[n])
    rows, ranks, sequence = [], defaultdict(int), 0
    for room in sorted(bins.groups):
        for count, runs in bins.groups[room]:
            offset = 0
            for length, copies in runs:
                rows.append((length, ranks[length], count, copies, sequence, offset))
                ranks[length] += count * copies
                offset += length * copies
            sequence += count
    return rows


def cut_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id",
    text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    Null texts are empty and give one piece with the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, encoded in enumerate(encoder(tokenizer).encode(batch.column(1))):
                full = np.append(encoded, np.uint32(end_id)).astype("<u4")
                first = len(full) % capacity or capacity
                edges = [0, *range(first, len(full) + 1, capacity)]
                for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    raw = full[a:b].tobytes()
                    whose.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw))
                    if keep_ids:
                        ids.append(raw)
            columns = [
                batch.column(0).take(pa.array(whose, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    ship(docs.sparkSession)
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string"))
    return given.mapInArrow(cut, kinds + (", ids binary" if keep_ids else ""))


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. ``pieces`` must give the same rows each time.

    Equal rows are interchangeable. The plan is made from at most ``capacity``
    counts; it has a few rows per length, a bound that no input changes.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        plan_packing(counts, capacity),
        "of_length long, first long, bins long, copies long, sequence long, at long",
    )
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in columns]
    ranked = preceding_sum(pieces, ["length"], order, F.lit(1), "rank")
    inside = F.col("rank") - F.col("first")
    found = (
        (F.col("length") == F.col("of_length"))
        & (inside >= 0)
        & (inside < F.col("bins") * F.col("copies"))
    )
    return ranked.join(F.broadcast(plan), found).select(
        *columns,
        (F.col("sequence") + F.floor(inside / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(inside, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048,
    key: str = "doc_id", text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Encode, cut and place all documents: one row per piece."""
    return place_pieces(
        pin_python(cut_pieces(docs, tokenizer, end_id, capacity, key, text, keep_ids)), capacity
    )


def sequences(placed: DataFrame) -> DataFrame:
    """The packed ids themselves: ``sequence_id, n, ids`` from pieces that carry ``ids``."""
    parts = placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n"),
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
    )  # a sequence has at most ``capacity`` pieces
    joined = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return parts.select("sequence_id", "n", joined.alias("ids"))
