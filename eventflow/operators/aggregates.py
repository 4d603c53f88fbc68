"""Aggregates of one's own: create, accumulate, combine, deduct, finish; per key and over sliding windows.

Each task reduces its rows to one state per group before anything is shuffled. States, not rows, meet
after the shuffle, and are combined as they are read in order: a task holds one state, and for windows
the states of one window. So a group of any size is never held whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventflow.functions.timing import Duration, micros_of, time_type
from eventflow.operators.windows import slot_of, window_bounds

# Groups a task holds states of at once; with more it hands on what it has and starts anew.
MOST_GROUPS = 50_000
# Panes of one key handled together; a window reaches into two such chunks at most.
CHUNK_PANES = 4096

State = tuple


@dataclass(frozen=True)
class UserAggregate:
    """What to do with the rows of a group. States are tuples with the fields of ``state``.

    ``accumulate(state, *values)`` takes the columns ``inputs`` of one row, ``many(state, columns)``, if
    given, those of all rows of a group in a batch at once, as Arrow arrays. ``combine(a, b)`` joins two
    states; ``a`` is of earlier panes, but rows within a pane come in any order. ``deduct(a, b)`` takes ``b``, which was combined before,
    out of ``a``; where there is none, windows keep running combinations from both ends instead.
    ``finish(state)`` gives the values of ``result``.
    """

    inputs: tuple[str, ...]
    state: str
    result: str
    create: Callable[[], State]
    accumulate: Callable[..., State]
    combine: Callable[[State, State], State]
    finish: Callable[[State], tuple]
    deduct: Callable[[State, State], State] | None = None
    many: Callable[[State, dict[str, pa.Array]], State] | None = None


def aggregate(df: DataFrame, keys: Sequence[str], agg: UserAggregate) -> DataFrame:
    """One row per key: the keys and ``agg.result``. Null keys are a group."""
    keys = list(keys)
    states = _combined(_partial(df.select(*keys, *_needed(agg, keys)), keys, agg), keys, agg)
    return _finished(states, keys, agg)


def sliding_aggregate(
    df: DataFrame,
    ts: str,
    keys: Sequence[str],
    agg: UserAggregate,
    size: Duration,
    slide: Duration | None = None,
) -> DataFrame:
    """``window_start, window_end, <keys>, <agg.result>`` of every window that has rows.

    The slide must divide the size; left out, windows are tumbling. Rows without time are in no window.
    A window of ``k`` panes costs one combination and one deduction per pane it moves on, or without
    ``deduct`` three combinations on average.
    """
    keys = list(keys)
    width, step = micros_of(size), micros_of(size if slide is None else slide)
    if width % step:
        raise ValueError("the slide must divide the window size")
    ratio = width // step
    chunk = max(CHUNK_PANES, ratio)
    timed = df.where(F.col(ts).isNotNull()).withColumn("__pane", slot_of(df, ts, step))
    by = [*keys, "__pane"]
    panes = _combined(_partial(timed.select(*by, *_needed(agg, by)), by, agg), by, agg)
    # A pane is in the windows that end with it and the ratio - 1 panes after it.
    touched = [F.expr(f"__pane + {n} - pmod(__pane + {n}, {chunk})") for n in (0, ratio - 1)]
    lent = panes.withColumn("__chunk", F.explode(F.array_distinct(F.array(*touched))))
    windows = _in_windows(lent, keys, agg, ratio, chunk)
    bounds = window_bounds(F.col("__slot"), step, width, time_type(df, ts))
    return windows.select(*bounds, *keys, *_fields(agg.result).names)


def _needed(agg: UserAggregate, keys: Sequence[str]) -> list[str]:
    return [c for c in agg.inputs if c not in keys]


def _fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _keyed(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _states(df: DataFrame, keys: Sequence[str], agg: UserAggregate) -> T.StructType:
    return T.StructType([*_keyed(df, keys), T.StructField("__state", _fields(agg.state))])


def _rows(keys: list[str], names: list[str], groups: list[tuple[tuple, State]], shape: pa.Schema):
    """Groups and their states as a record batch."""
    columns = [pa.array([k[i] for k, _ in groups], shape.field(i).type) for i in range(len(keys))]
    kind = shape.field(len(keys)).type
    parts = [pa.array([s[i] for _, s in groups], kind.field(i).type) for i in range(len(names))]
    state = pa.StructArray.from_arrays(parts, fields=list(kind))
    return pa.RecordBatch.from_arrays([*columns, state], schema=shape)


def _partial(df: DataFrame, keys: list[str], agg: UserAggregate) -> DataFrame:
    """One state per task and group, several where a task has very many groups."""
    schema = _states(df, keys, agg)
    shape, names = to_arrow_schema(schema), _fields(agg.state).names
    most = MOST_GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, State] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            order, cuts = _groups([batch.column(k) for k in keys], batch.num_rows)
            sorted_ = batch.take(pa.array(order))
            firsts = sorted_.select(keys).take(pa.array(cuts[:-1])) if keys else None
            found = list(zip(*(firsts.column(k).to_pylist() for k in keys), strict=True)) if keys else [()]
            columns = {c: sorted_.column(c) for c in agg.inputs}
            values = None if agg.many else list(zip(*(columns[c].to_pylist() for c in agg.inputs), strict=True))
            for key, a, b in zip(found, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                state = held.get(key)
                state = agg.create() if state is None else state
                if agg.many:
                    state = agg.many(state, {c: x.slice(a, b - a) for c, x in columns.items()})
                else:
                    for row in values[a:b]:
                        state = agg.accumulate(state, *row)
                held[key] = state
            if len(held) > most:
                yield _rows(keys, names, list(held.items()), shape)
                held = {}
        if held:
            yield _rows(keys, names, list(held.items()), shape)

    return df.mapInArrow(run, schema)


def _groups(columns: list[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where each group of it starts, and the end."""
    codes = np.zeros(n, np.int64)
    for column in columns:
        coded = column.dictionary_encode(null_encoding="encode")
        codes = codes * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    return order, np.append(starts, n)


def _ordered(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]):
    """(key, state) pairs of rows that are sorted by key."""
    for batch in batches:
        state = batch.column("__state")
        parts = zip(*(state.field(n).to_pylist() for n in names), strict=True)
        found = zip(*(batch.column(k).to_pylist() for k in keys), strict=True) if keys else iter(lambda: (), None)
        yield from zip(found, parts, strict=False)


def _combined(states: DataFrame, keys: list[str], agg: UserAggregate) -> DataFrame:
    """One state per group."""
    schema = states.schema
    shape, names = to_arrow_schema(schema), _fields(agg.state).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[tuple, State]] = []
        key, state = None, None
        for found, part in _ordered(batches, keys, names):
            if state is not None and found == key:
                state = agg.combine(state, part)
                continue
            if state is not None:
                done.append((key, state))
            key, state = found, part
            if len(done) >= 10_000:
                yield _rows(keys, names, done, shape)
                done = []
        if state is not None:
            yield _rows(keys, names, [*done, (key, state)], shape)

    met = states.repartition(*keys).sortWithinPartitions(*keys) if keys else states.repartition(1)
    return met.mapInArrow(run, schema)


def _finished(states: DataFrame, keys: list[str], agg: UserAggregate) -> DataFrame:
    result = _fields(agg.result)
    schema = T.StructType([*_keyed(states, keys), *result.fields])
    shape, names = to_arrow_schema(schema), _fields(agg.state).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*key, *agg.finish(state)) for key, state in _ordered([batch], keys, names)]
            if rows:
                yield _table(rows, shape)

    return states.mapInArrow(run, schema)


def _table(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape
    )


class _Window:
    """The states of the panes in a window, combined; panes come and go in order."""

    def __init__(self, agg: UserAggregate):
        self.agg, self.panes, self.whole = agg, deque(), None

    def push(self, pane: int, state: State) -> None:
        self.panes.append((pane, state))
        self.whole = state if self.whole is None else self.agg.combine(self.whole, state)

    def drop(self, first: int) -> None:
        while self.panes and self.panes[0][0] < first:
            gone = self.panes.popleft()[1]
            self.whole = self.agg.deduct(self.whole, gone) if self.panes else None

    def state(self) -> State | None:
        return self.whole


class _Stacks:
    """The same without deducting: older panes combined from each to the last of them, newer ones all together."""

    def __init__(self, agg: UserAggregate):
        self.agg, self.older, self.newer, self.sum = agg, [], [], None

    def push(self, pane: int, state: State) -> None:
        self.newer.append((pane, state))
        self.sum = state if self.sum is None else self.agg.combine(self.sum, state)

    def drop(self, first: int) -> None:
        while self.older and self.older[-1][0] < first:
            self.older.pop()
        if not self.older and self.newer and self.newer[0][0] < first:
            tail = None
            for pane, state in reversed(self.newer):
                tail = state if tail is None else self.agg.combine(state, tail)
                self.older.append((pane, tail))
            self.newer, self.sum = [], None
            self.drop(first)

    def state(self) -> State | None:
        if not self.older:
            return self.sum
        return self.older[-1][1] if self.sum is None else self.agg.combine(self.older[-1][1], self.sum)


def _in_windows(
    lent: DataFrame, keys: list[str], agg: UserAggregate, ratio: int, chunk: int
) -> DataFrame:
    """``keys, __slot (first pane), <result>`` of the windows whose last pane lies in a chunk."""
    by = [*keys, "__chunk"]
    result = _fields(agg.result)
    schema = T.StructType([*_keyed(lent, keys), T.StructField("__slot", T.LongType()), *result.fields])
    shape, names = to_arrow_schema(schema), _fields(agg.state).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, window, at = None, None, 0

        def until(end: int) -> Iterator[pa.RecordBatch]:
            """Windows whose last pane is ``at`` or later and before ``end``."""
            nonlocal at, done
            while at < end:
                window.drop(at - ratio + 1)
                state = window.state()
                if state is None:
                    break
                if at >= key[-1]:
                    done.append((*key[:-1], at - ratio + 1, *agg.finish(state)))
                    if len(done) >= 10_000:
                        yield _table(done, shape)
                        done = []
                at += 1
            at = end

        for (*found, pane), state in _ordered(batches, [*by, "__pane"], names):
            if window is None or found != key:
                if window is not None:
                    yield from until(key[-1] + chunk)
                key, window, at = found, (_Window if agg.deduct else _Stacks)(agg), pane
            yield from until(pane)
            window.drop(pane - ratio + 1)
            window.push(pane, state)
        if window is not None:
            yield from until(key[-1] + chunk)
        if done:
            yield _table(done, shape)

    parted = lent.repartition(*by).sortWithinPartitions(*by, "__pane")
    return parted.select(*by, "__pane", "__state").mapInArrow(run, schema)


# Ready-made ones, which also show how to write one.


def _moments(state: State, columns: dict[str, pa.Array]) -> State:
    (values,) = columns.values()
    x = values.drop_null().to_numpy(zero_copy_only=False).astype(object)
    return state[0] + len(x), state[1] + int(x.sum()), state[2] + int((x * x).sum())


def _mean_and_variance(state: State) -> tuple:
    n, total, squares = map(int, state)
    return (n, total / n, (n * squares - total * total) / (n * n)) if n else (0, None, None)


def variance(column: str) -> UserAggregate:
    """Count, mean and population variance of a whole-number column; nulls do not count.

    Sums are whole numbers, so deducting a pane leaves no rounding behind.
    """
    return UserAggregate(
        inputs=(column,),
        state="n bigint, total decimal(38,0), squares decimal(38,0)",
        result="n bigint, mean double, variance double",
        create=lambda: (0, 0, 0),
        accumulate=lambda s, x: s if x is None else (s[0] + 1, s[1] + x, s[2] + x * x),
        combine=lambda a, b: tuple(int(x) + int(y) for x, y in zip(a, b, strict=True)),
        deduct=lambda a, b: tuple(int(x) - int(y) for x, y in zip(a, b, strict=True)),
        finish=_mean_and_variance,
        many=_moments,
    )


def pick_any(column: str, kind: str) -> UserAggregate:
    """Any value of a column that has one per group, and the group's rows; gone when its last row is."""

    def both(a: State, b: State) -> State:
        return a[0] + b[0], a[1] if a[1] is not None else b[1]

    return UserAggregate(
        inputs=(column,),
        state=f"n bigint, value {kind}",
        result=f"n bigint, value {kind}",
        create=lambda: (0, None),
        accumulate=lambda s, x: both(s, (1, x)),
        combine=both,
        deduct=lambda a, b: (a[0] - b[0], a[1] if a[0] > b[0] else None),
        finish=lambda s: s,
    )


def spread_of(column: str, kind: str) -> UserAggregate:
    """Lowest and highest value; nothing can be deducted from these."""

    def both(a: State, b: State) -> State:
        if a[0] is None or b[0] is None:
            return b if a[0] is None else a
        return min(a[0], b[0]), max(a[1], b[1])

    return UserAggregate(
        inputs=(column,),
        state=f"low {kind}, high {kind}",
        result=f"low {kind}, high {kind}",
        create=lambda: (None, None),
        accumulate=lambda s, x: s if x is None else both(s, (x, x)),
        combine=both,
        finish=lambda s: s,
    )


def _register() -> None:
    """Workers get this module by value, so the package need not be installed there."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_register()
