"""User aggregates against loops: hot groups, hot panes, gaps, nulls, several keys, both ways to slide."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventflow.operators import aggregates as U

T0 = datetime(2024, 1, 1)


def merge(name):
    """A text aggregate: order-free within a pane, in order over panes, with or without taking out."""
    return U.UserAggregate(
        inputs=("x",),
        state="parts string",
        result="parts string, n int",
        create=lambda: ("",),
        accumulate=lambda s, x: ("".join(sorted(s[0] + (x or "-"))),),
        combine=lambda a, b: (a[0] + "|" + b[0] if name == "ordered" else "".join(sorted(a[0] + b[0])),),
        finish=lambda s: (s[0], len(s[0])),
    )


@settings(max_examples=100)
@given(st.lists(st.integers(0, 40), unique=True, max_size=25), st.integers(1, 9))
def test_both_windows_hold_the_same(panes, ratio):
    add = U.UserAggregate((), "n bigint", "n bigint", lambda: (0,), None, lambda a, b: (a[0] + b[0],), lambda s: s, lambda a, b: (a[0] - b[0],))
    one, two = U._Window(add), U._Stacks(add)
    panes = sorted(panes)
    for at in range(60):
        for window in (one, two):
            window.drop(at - ratio + 1)
            if at in panes:
                window.push(at, (at + 1,))
        inside = [p + 1 for p in panes if at - ratio < p <= at]
        assert one.state() == two.state() == ((sum(inside),) if inside else None)


def rows(n=3000, seed=4):
    """A third of the rows in one group and pane; null keys, values and times; a gap of years."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = i % 3 == 0
        second = 5 if hot else rng.choice([rng.randint(0, 400), rng.randint(0, 400) + 10**8])
        ts = None if i % 97 == 0 else T0 + timedelta(seconds=second)
        out.append((1 if hot else rng.choice([None, 2, 3, 4]), rng.choice(["a", None]), ts, rng.choice([None, *range(-5, 90)])))
    return out


def windows(data, size, slide):
    found = defaultdict(list)
    for a, b, ts, x in data:
        if ts is not None:
            second = int((ts - T0).total_seconds())
            first = second - second % slide
            for start in range(first - size + slide, first + slide, slide):
                found[a, b, T0 + timedelta(seconds=start)].append(x)
    return found


SCHEMA = "a int, b string, ts timestamp_ntz, x int"


@pytest.mark.parametrize(("size", "slide", "chunk"), [(60, 10, 4096), (50, 10, 7), (30, 30, 1), (400, 1, 400)])
def test_sliding(spark, monkeypatch, size, slide, chunk):
    monkeypatch.setattr(U, "CHUNK_PANES", chunk)
    monkeypatch.setattr(U, "MOST_GROUPS", 40)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = windows(data, size, slide)
    spans = (f"{size} seconds", f"{slide} seconds")
    got = U.sliding_aggregate(df, "ts", ["a", "b"], U.variance("x"), *spans).collect()
    assert {(r.a, r.b, r.window_start): r.n for r in got} == {k: sum(x is not None for x in v) for k, v in want.items()}
    assert len(got) == len(want)
    for r in got:
        xs = [x for x in want[r.a, r.b, r.window_start] if x is not None]
        if xs:
            mean = sum(xs) / len(xs)
            assert r.mean == pytest.approx(mean)
            assert r.variance == pytest.approx(sum((x - mean) ** 2 for x in xs) / len(xs), abs=1e-9)
        assert (r.window_end - r.window_start).total_seconds() == size
    got = U.sliding_aggregate(df, "ts", ["a", "b"], U.spread_of("x", "int"), *spans).collect()
    assert {(r.a, r.b, r.window_start): (r.low, r.high) for r in got} == {
        k: (min((x for x in v if x is not None), default=None), max((x for x in v if x is not None), default=None))
        for k, v in want.items()
    }


def test_pick_any_is_gone_with_its_last_row(spark):
    data = [(1, "p", T0 + timedelta(seconds=s), 0) for s in (0, 1, 12, 50)]
    df = spark.createDataFrame(data, SCHEMA)
    got = U.sliding_aggregate(df, "ts", ["a"], U.pick_any("b", "string"), "20 seconds", "10 seconds")
    assert sorted((int((r.window_start - T0).total_seconds()), r.n, r.value) for r in got.collect()) == [
        (-10, 2, "p"), (0, 3, "p"), (10, 1, "p"), (40, 1, "p"), (50, 1, "p"),
    ]


def test_panes_are_combined_in_order(spark):
    data = [(s // 10 % 2, "x", T0 + timedelta(seconds=s), 0) for s in range(60)]
    df = spark.createDataFrame([(a, "abcdef"[int((t - T0).total_seconds()) // 10], t) for a, _, t, _ in data], "a int, x string, ts timestamp_ntz")
    got = U.sliding_aggregate(df, "ts", [], merge("ordered"), "30 seconds", "10 seconds").orderBy("window_start")
    assert [r.parts.replace("|", "") for r in got.collect()] == [
        "".join("abcdef"[p] * 10 for p in range(max(0, e - 2), min(5, e) + 1)) for e in range(8)
    ]


def test_by_key_and_without(spark):
    data = rows(500)
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    by = defaultdict(list)
    for a, _, _, x in data:
        by[a].append(x)
    got = {r.a: (r.low, r.high) for r in U.aggregate(df, ["a"], U.spread_of("x", "int")).collect()}
    assert got == {k: (min(x for x in v if x is not None), max(x for x in v if x is not None)) for k, v in by.items()}
    whole = U.aggregate(df, [], U.variance("x")).collect()
    assert [r.n for r in whole] == [sum(x is not None for *_, x in data)]
    assert U.aggregate(df.limit(0), ["a"], U.variance("x")).collect() == []


def test_the_slide_must_divide_the_size(spark):
    with pytest.raises(ValueError):
        U.sliding_aggregate(spark.createDataFrame([], SCHEMA), "ts", ["a"], U.variance("x"), "10 seconds", "3 seconds")
