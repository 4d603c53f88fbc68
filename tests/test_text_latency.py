"""Words, latency samples, profiles and log statistics."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from eventflow.functions.timing import clock_time, floor_to_grid, time_in_cycle
from eventflow.operators import latency as L
from eventflow.operators import reports as R
from eventflow.operators import shaping as S
from eventflow.operators import text as T


def lines_of(spark, *lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")


def test_words_are_split_at_blanks_of_all_kinds(spark):
    lines = lines_of(spark, "a b\tc\fd\re\nf", "   ", "", " A  a. ", "a b")
    assert [r.word for r in T.tokenize(lines).collect()] == [
        *"abcdef",
        "A",
        "a.",
        "a b",
    ]
    counts = {r.word: r.n for r in T.word_count(lines).collect()}
    assert counts["a"] == 1 and counts["A"] == 1 and sum(counts.values()) == 9


@pytest.mark.parametrize("spread", [True, False])
def test_running_word_count(spark, spread):
    rng = random.Random(3)
    words = [(i, rng.choice(["the"] * 5 + ["cat", "dog"])) for i in range(300)]
    df = spark.createDataFrame(words, "i int, word string")
    seen, expected = {}, set()
    for i, word in words:
        seen[word] = seen.get(word, 0) + 1
        expected.add((i, word, seen[word]))
    got = T.running_word_count(df, ["i"], spread)
    assert {(r.i, r.word, r.n) for r in got.collect()} == expected


def sample(spark, rows):
    return spark.createDataFrame(rows, "t long, a long").select(
        F.timestamp_millis("t").alias("ts"), F.timestamp_millis("a").alias("arrival")
    )


@pytest.mark.parametrize("spread", [True, False])
def test_latency_log_is_the_sequential_rule(spark, spread):
    rng = random.Random(11)
    rows = []
    for _ in range(800):
        t = rng.randrange(1, 200) * 10
        rows.append((t, t + rng.randrange(0, 400)))
    kept, last, start = [], 0, None
    for t, a in sorted(rows, key=lambda r: (r[1], r[0])):
        if t > last:
            start = t if start is None else start
            last = t
            kept.append((t - start, a - t))
    got = L.latency_log(sample(spark, rows), "ts", "arrival", spread).collect()
    assert sorted((r.elapsed_ms, r.latency_ms) for r in got) == sorted(kept)


def test_clock_skew(spark):
    log = L.latency_log(sample(spark, [(100, 99)]), "ts", "arrival")
    assert log.collect() == [(0, 0)]
    with pytest.raises(Exception, match="negative latency: -2"):
        L.latency_log(sample(spark, [(100, 98)]), "ts", "arrival").collect()


def expected_profile(samples, ticks=5):
    """Walk the sorted samples as a percentile iterator does."""
    total = len(samples)
    values = sorted(set(samples))
    cumulative, at = [], 0
    for v in values:
        at += samples.count(v)
        cumulative.append(at)
    rows, level = [], 0.0
    for v, c in zip(values, cumulative):
        while 100.0 * c / total >= level:
            rows.append((v, round(level / 100, 9), c))
            halvings = int(math.floor(math.log2(100.0 / (100.0 - level)))) + 1
            level += 100.0 / (ticks * 2**halvings)
            if c == total:
                break
    rows.append((values[-1], 1.0, total))
    return rows


@pytest.mark.parametrize("spread", [True, False])
@pytest.mark.parametrize("seed, n", [(1, 1), (2, 2), (3, 10), (4, 500)])
def test_profile_matches_a_percentile_walk(spark, seed, n, spread):
    rng = random.Random(seed)
    samples = [int(rng.expovariate(0.05)) for _ in range(n)]
    log = spark.createDataFrame(list(enumerate(samples)), "elapsed_ms long, latency_ms long")
    got = L.latency_profile(log, 0, 10_000, spread=spread).collect()
    rows = sorted((r.latency_ms, round(r.percentile, 9), r.total_count) for r in got)
    assert rows == sorted(expected_profile(samples))
    for r in got:
        if r.percentile == 1.0:
            assert r.inverse is None
        else:
            assert math.isclose(r.inverse, 1 / (1 - r.percentile), rel_tol=1e-9)


def test_profile_phases(spark):
    log = spark.createDataFrame(
        [(0, 900), (10, 1), (20, 2), (30, 3), (40, 800)], "elapsed_ms long, latency_ms long"
    )
    counted = L.measured_histogram(log, 10, 25)
    assert {(r.latency_ms, r.n) for r in counted.collect()} == {(1, 1), (2, 1), (3, 1)}
    phases = log.select(L.phase_of(F.col("elapsed_ms"), 10, 25).alias("p"))
    assert [r.p for r in phases.collect()] == [
        "warming up",
        "measuring",
        "measuring",
        "done",
        "done",
    ]


def test_profile_text_round_trip(spark):
    log = spark.createDataFrame([(i, i % 7) for i in range(50)], "elapsed_ms long, latency_ms long")
    profile = L.latency_profile(log, 0, 1000)
    text = L.profile_lines(profile).unionByName(lines_of(spark, "#[Mean = 3]", "Value Percentile"))
    back = L.parse_profile(text)
    closing = profile.where("inverse is null").count()
    assert closing == 1 and back.count() == profile.count() - closing


def test_log_lines_of_the_wrong_width_are_counted(spark):
    lines = lines_of(
        spark,
        "10:00:01,a,b,c,5",
        "10:00:01,a,b,c,8",
        "10:00:02.250,a,b,c,1",
        "10:00:02,a,b,4",
        "10:00:02,a,b,c,4,5",
        "10:00:02,a,b,,",
    )
    seen = Observation("fields")
    stats = L.latency_log_stats(lines, "2024-05-01", observation=seen)
    rows = L.newest_first(stats).collect()
    assert [tuple(r) for r in rows] == [
        (datetime(2024, 5, 1, 10, 0, 2, 250000), 1, 1, 1, 1.0),
        (datetime(2024, 5, 1, 10, 0, 1), 2, 5, 8, 6.5),
    ]
    assert seen.get == {"good_rows": 3, "bad_rows": 3}
    assert tuple(L.latency_log_summary(stats).first()) == (3, 1, 8)


def test_empty_log(spark):
    stats = L.latency_log_stats(lines_of(spark, "nothing here"), "2024-05-01")
    assert tuple(L.latency_log_summary(stats).first()) == (-1, -1, -1)


def test_batch_maximum_is_not_below_zero(spark):
    df = spark.createDataFrame([(1, -5), (1, -2), (2, 3), (2, 9)], "b int, latency_ms long")
    rows = {r.batch: r.max_latency_ms for r in R.batch_max_latency(df, "b").collect()}
    assert rows == {1: 0, 2: 9}


@pytest.mark.parametrize("spread", [True, False])
def test_watermark_delay_by_loop(spark, spread):
    rng = random.Random(5)
    rows = [(t * 10, t * 10 + rng.randrange(300)) for t in range(200)]
    high, expected = 0, []
    for t, a in sorted(rows, key=lambda r: (r[1], r[0])):
        high = max(high, t)
        expected.append((t, a, high - high % 50, a - (high - high % 50)))
    got = R.watermark_delay(sample(spark, rows), "ts", "arrival", 50, 100, spread)
    found = got.select(
        F.unix_millis("ts"), F.unix_millis("arrival"), "watermark_ms", "delay_ms", "behind"
    ).collect()
    assert sorted(tuple(r)[:4] for r in found) == sorted(expected)
    assert all(r.behind == (r.delay_ms > 100) for r in found)


def test_time_functions(spark):
    row = spark.range(1).select(
        floor_to_grid(F.lit(1234), 100, 7).alias("grid"),
        time_in_cycle(F.lit(3 * 3600 * 1000 + 5)).alias("cycle"),
        clock_time(F.lit(1500)).alias("clock"),
        S.comma_fields(F.lit("a,,b,,")).alias("fields"),
    ).first()
    assert (row.grid, row.cycle, row.clock) == (1207, 5, "00:00:01.500")
    assert row.fields == ["a", "", "b"]


def test_durations_are_read_whole():
    from datetime import timedelta

    from eventflow.functions.timing import micros_of

    assert micros_of("1.5 seconds") == 1_500_000
    assert micros_of("1 day 12 hours") == 36 * 3_600_000_000
    assert micros_of(timedelta(milliseconds=3)) == 3_000
    for text in ("-1 day", "10 ms", "1 second, 2", "0.1 microseconds", ""):
        with pytest.raises(ValueError):
            micros_of(text)


def test_levels_reach_as_far_for_any_ticks():
    assert max(L.profile_levels(8)) >= 100.0 * (1 - 2.0**-45)


def test_prices_beyond_32_bits_are_refused(spark):
    from eventflow.functions import codec

    trades = spark.sql("SELECT timestamp_millis(1) AS time, 'AAA' AS ticker, 1 AS quantity, 5000000000 AS price")
    with pytest.raises(Exception, match="does not fit"):
        codec.encode_trade(trades).collect()
