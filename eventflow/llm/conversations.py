"""Rows of conversations in order, and digests of what belongs to a key, without holding a key whole."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import partitions, ship

# Rows of one conversation stand by turn (none first), ties by role and text.
ORDER = ("conv_id", "turn", "role", "text")


def in_order(rows: DataFrame) -> DataFrame:
    """All rows sorted by conversation and turn over many tasks; a long conversation spans several.

    Equal rows are told apart by where they were read, so that even they need not meet in one task.
    """
    read = rows.withColumn("_read", F.monotonically_increasing_id())
    order = [*ORDER, "_read"]
    parted = read.repartitionByRange(partitions(rows.sparkSession), *order)
    return parted.sortWithinPartitions(*order).drop("_read")


def fold_keys(
    rows: DataFrame,
    key: str,
    order: list[str],
    begin: Callable[[], object],
    schema: str,
) -> DataFrame:
    """One row per key from a pass over its rows in order, which holds one batch of rows at a time.

    ``begin()`` makes an object with ``add(batch)``, given a key's next rows as a record batch, and
    ``end()``, which returns the values of ``schema`` after the key. What has to be read in order
    (a digest) has one task per key; its memory does not grow with the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(",")]
        state, now, done = None, None, []

        def flush():
            table = pa.Table.from_pylist([dict(zip(names, row, strict=True)) for row in done], fields)
            done.clear()
            return table.to_batches()

        fields = None
        for batch in batches:
            if fields is None:
                kinds = {"bigint": pa.int64(), "string": pa.string()}
                fields = pa.schema(
                    [(p.split()[0], kinds[p.split()[1]]) for p in schema.split(",")]
                )
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            at = 0
            while at < len(keys):
                upto = at + 1
                while upto < len(keys) and keys[upto] == keys[at]:
                    upto += 1
                if state is None or now != keys[at]:
                    if state is not None:
                        done.append((now, *state.end()))
                    state, now = begin(), keys[at]
                state.add(batch.slice(at, upto - at))
                at = upto
            if len(done) > 2_000:
                yield from flush()
        if state is not None:
            done.append((now, *state.end()))
            yield from flush()

    ship(rows.sparkSession)
    parted = rows.repartition(partitions(rows.sparkSession), key)
    return parted.sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Sha256:
    """A digest that text is added to bit by bit."""

    def __init__(self):
        self._hash, self.chars = hashlib.sha256(), 0

    def add(self, text: str) -> None:
        self.chars += len(text)
        self._hash.update(text.encode("utf-8", "surrogatepass"))

    def hex(self) -> str:
        return self._hash.hexdigest()
