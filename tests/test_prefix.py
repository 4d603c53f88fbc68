"""Spread running aggregates and trailing frames against plain loops, with hot keys."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventflow.plans import prefix, skew
from eventflow.plans.prefix import running, trailing, with_position
from eventflow.plans.sizes import input_bytes, slices_for, will_broadcast


def skewed_rows(n=600, seed=7):
    """A third of the rows have key 0, another third no key."""
    rng = random.Random(seed)
    keys = [0] * (n // 3) + [None] * (n // 3) + [rng.randrange(1, 40) for _ in range(n // 3)]
    rng.shuffle(keys)
    return [(k, rng.randrange(20), i, rng.randrange(-50, 50)) for i, k in enumerate(keys)]


def by_key(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[row[0]].append(row)
    return groups


@pytest.mark.parametrize("slices", [1, 3, 50])
@pytest.mark.parametrize("keyed", [True, False])
def test_running_matches_loop(spark, slices, keyed):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k int, o int, i int, v int")
    keys = ["k"] if keyed else []
    aggs = {
        "total": ("sum", F.col("v")),
        "n": ("count", F.lit(1)),
        "low": ("min", F.col("v")),
        "high": ("max", F.col("v")),
    }
    got = running(df, keys, ["o", "i"], aggs, spread=True, slices=slices)
    assert got.columns == ["k", "o", "i", "v", "total", "n", "low", "high"]
    expected = set()
    for group in by_key(rows if keyed else [(0, *r[1:]) for r in rows]).values():
        seen = []
        for row in group:
            seen.append(row[3])
            expected.add((row[2], sum(seen), len(seen), min(seen), max(seen)))
    assert {(r.i, r.total, r.n, r.low, r.high) for r in got.collect()} == expected
    assert got.count() == len(rows)


@pytest.mark.parametrize("spread", [True, None])
def test_counts_of_hot_keys_take_one_shuffle(spark, spread, monkeypatch):
    """A key of two thirds, the rest small or null; null places and values; nothing is written on the way."""

    def refused(_):
        raise AssertionError("rows written")

    monkeypatch.setattr(prefix, "pin", refused)
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    rng = random.Random(11)
    places = [None, *range(899)]
    rng.shuffle(places)
    rows = [(rng.choice([0, 0, 0, 0, None, rng.randrange(1, 90)]), i, None if i and i % 7 == 0 else 1) for i in places]
    df = spark.createDataFrame(rows, "k int, i long, v int").repartition(5)
    aggs = {"n": ("count", F.lit(1)), "given": ("count", F.col("v"))}
    plain = running(df, ["k"], ["i"], aggs, spread=False)
    got = running(df, ["k"], ["i"], aggs, spread=spread, slices=6)
    assert got.schema.simpleString() == plain.schema.simpleString()
    assert Counter(got.collect()) == Counter(plain.collect())
    # One value of the order on half of all rows cuts into no ranges: the rows are sliced as before.
    monkeypatch.undo()
    tied = df.withColumn("o", F.when(F.col("i") < 450, 5).otherwise(F.col("i")).cast("int"))
    got, plain = (with_position(tied, ["k"], ["o", "i"], "n", s, 6) for s in (True, False))
    assert Counter(got.collect()) == Counter(plain.collect())


def test_running_skips_null_values(spark):
    rows = [(i, None if i % 3 else i) for i in range(30)]
    df = spark.createDataFrame(rows, "o int, v int")
    aggs = {"total": ("sum", F.col("v")), "n": ("count", F.col("v")), "high": ("max", F.col("v"))}
    spread = running(df, [], ["o"], aggs, spread=True, slices=7)
    plain = running(df, [], ["o"], aggs, spread=False)
    assert sorted(spread.collect()) == sorted(plain.collect())


def test_descending_order(spark):
    df = spark.range(40).select(F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("v"))
    args = ([], [F.col("o").desc()], {"low": ("min", F.col("v"))})
    spread = running(df, *args, spread=True, slices=6)
    plain = running(df, *args, spread=False)
    assert sorted(spread.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("reach", [(-9, 0), (-1, -1), (-3, -2)])
def test_trailing_matches_plain_window(spark, reach):
    df = spark.createDataFrame(skewed_rows(), "k int, o int, i int, v int")

    def columns(frame):
        return {"a": F.sum("v").over(frame), "c": F.count("v").over(frame)}

    plain = trailing(df, ["k"], ["o", "i"], *reach, columns, spread=False)
    for block in (9, 10, 64):
        spread = trailing(
            df, ["k"], ["o", "i"], *reach, columns, spread=True, slices=5, block_rows=block
        )
        assert spread.columns == plain.columns
        assert spread.exceptAll(plain).count() == 0
        assert plain.exceptAll(spread).count() == 0


def test_trailing_rejects_bad_frames(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        trailing(df, [], ["id"], 0, 1, lambda w: {}, spread=True)
    with pytest.raises(ValueError):
        trailing(df, [], ["id"], -9, 0, lambda w: {}, spread=True, block_rows=4)


def test_position_of_one_hot_key(spark):
    df = spark.range(500).select(F.lit("x").alias("k"), "id")
    got = with_position(df, ["k"], ["id"], "p", spread=True, slices=9)
    assert got.where(F.col("p") != F.col("id") + 1).count() == 0


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int, o int")
    assert with_position(df, ["k"], ["o"], "p", spread=True).count() == 0


def test_carry_is_bounded_by_slices(spark):
    """The broadcast side has fewer rows than slices even if every row is a key of its own."""
    from eventflow.plans.prefix import _SLICE, _carried_in

    rows = spark.range(1000).select((F.col("id") % 400).alias("k"), "id")
    sliced = rows.repartitionByRange(8, "k", "id").withColumn(_SLICE, F.spark_partition_id())
    from eventflow.session import pin

    carry = _carried_in(pin(sliced), ["k"], {"n": ("count", F.lit(1))})
    assert carry.count() < 8


def test_input_size_comes_from_files(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = input_bytes(events)
    assert 0 < size < 10_000_000
    assert input_bytes(events.join(events.select("user_id"), "user_id")) < 3 * size
    assert slices_for(events) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert will_broadcast(events)


@pytest.fixture
def low_hot_floor(monkeypatch):
    monkeypatch.setattr("eventflow.plans.skew.HOT_ROWS", 100)


@pytest.mark.parametrize("keys", [["k"], ["k", "c"], []])
@pytest.mark.parametrize("derived", [True, False])
def test_only_hot_groups_are_sliced(spark, low_hot_floor, monkeypatch, keys, derived):
    """Keys 0 and null hold a third each and are sliced; the others are not."""
    from eventflow.plans import prefix

    given = []
    slicing = prefix._running_in_slices
    monkeypatch.setattr(
        prefix, "_running_in_slices", lambda df, *a: given.append(df) or slicing(df, *a)
    )
    df = spark.createDataFrame(skewed_rows(), "k int, o int, i int, v int")
    df = df.withColumn("c", F.lit("x"))
    args = (keys, ["o", "i"], {"total": ("sum", F.col("v")), "n": ("count", F.lit(1))})
    plain = running(df, *args, spread=False)
    mixed = running(df, *args, derived=derived)
    assert plain.exceptAll(mixed).count() == 0 and mixed.exceptAll(plain).count() == 0
    sliced_keys = {r.k for r in given[0].select("k").distinct().collect()}
    assert sliced_keys == {0, None} if keys else len(sliced_keys) > 2


def test_trailing_slices_only_hot_groups(spark, low_hot_floor):
    df = spark.createDataFrame(skewed_rows(), "k int, o int, i int, v int")
    args = (["k"], ["o", "i"], -4, 0, lambda w: {"a": F.sum("v").over(w)})
    plain = trailing(df, *args, spread=False)
    mixed = trailing(df, *args, block_rows=16)
    assert plain.exceptAll(mixed).count() == 0 and mixed.exceptAll(plain).count() == 0


def test_pinned_rows_are_fixed_and_can_be_dropped(spark):
    from eventflow.session import checkpoint_root, drop_pinned, pin

    rows = pin(spark.range(100).withColumn("r", F.rand()))
    assert rows.exceptAll(rows.select("id", "r")).count() == 0
    assert checkpoint_root(spark).removeprefix("file:") in rows.inputFiles()[0]
    drop_pinned(spark)
    with pytest.raises(Exception, match="(?i)not exist"):
        rows.count()
