"""Window counts: pane form against direct form and against loops."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventflow.functions.timing import micros_of
from eventflow.operators import auctions as A
from eventflow.operators import reports as R
from eventflow.operators import windows as W

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows have key 0; two bursts with a long silence between; also before 1970."""
    times = spark.range(1500).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"),
        F.timestamp_millis(
            F.when(F.col("id") < 1000, F.col("id") * 137)
            .when(F.col("id") < 1400, 40_000_000 + F.col("id") * 11)
            .otherwise(-5000 - F.col("id"))
        ).alias("ts"),
    )
    return times.unionByName(times.limit(1).select("k", F.lit(None).cast("timestamp").alias("ts")))


@pytest.mark.parametrize(
    "size, slide",
    [
        ("10 seconds", "10 seconds"),
        ("10 seconds", "1 second"),
        ("20 seconds", "20 milliseconds"),
        ("2 hours", "1 second"),
    ],
)
@pytest.mark.parametrize("keys", [["k"], []])
def test_panes_equal_direct(rows, size, slide, keys, monkeypatch):
    monkeypatch.setattr(W, "CHUNK_SLOTS", 64)
    panes = W.sliding_count(rows, "ts", keys, size, slide, "panes")
    direct = W.sliding_count(rows, "ts", keys, size, slide, "direct")
    width = micros_of(size)
    assert panes.columns == direct.columns
    assert panes.groupBy().agg(F.sum("n")).first()[0] == 1500 * (width // micros_of(slide))
    assert panes.exceptAll(direct).count() == 0 and direct.exceptAll(panes).count() == 0


def test_counts_equal_loop(spark, rows):
    got = {
        (r.window_start, r.k): r.n
        for r in W.sliding_count(rows, "ts", "k", "10 seconds", "2 seconds").collect()
    }
    expected = {}
    for row in rows.where("ts is not null").collect():
        base = datetime(1970, 1, 1)
        pane = (row.ts - base) // timedelta(seconds=2)
        for start in range(pane - 4, pane + 1):
            key = (base + timedelta(seconds=2 * start), row.k)
            expected[key] = expected.get(key, 0) + 1
    assert got == expected


def test_same_size_and_slide_is_tumbling(rows):
    tumbling = W.tumbling_count(rows, "ts", "k", "10 seconds")
    sliding = W.sliding_count(rows, "ts", "k", "10 seconds", "10 seconds")
    assert tumbling.exceptAll(sliding).count() == 0
    assert tumbling.groupBy().agg(F.sum("n")).first()[0] == 1500


def test_uneven_slide_needs_the_direct_form(rows):
    with pytest.raises(ValueError):
        W.sliding_count(rows, "ts", "k", "10 seconds", "3 seconds", "panes")
    assert W.sliding_count(rows, "ts", "k", "10 seconds", "3 seconds").count() > 0


def test_large_ratio_takes_panes():
    assert W.pane_method("auto", 1000, 1) == "panes"
    assert W.pane_method("auto", 4, 1) == "direct"
    assert W.pane_method("auto", 1001, 10) == "direct"


def test_durations():
    assert micros_of("1 day 12 hours") == 36 * 3600 * 10**6
    assert micros_of("20 ms".replace("ms", "milliseconds")) == 20_000
    assert micros_of(timedelta(seconds=2)) == 2_000_000
    with pytest.raises(ValueError):
        micros_of("soon")


def test_zone_less_times_need_utc(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError):
            W.sliding_total(events, "ts", "1 day", "6 hours")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_top_n_ties_go_to_the_lowest_key(spark):
    counts = spark.createDataFrame(
        [(START, START, k, n) for k, n in [(3, 5), (1, 5), (2, 9), (4, 1)]],
        "window_start timestamp, window_end timestamp, auction_id long, n long",
    )
    top = W.top_n_per_window(counts, "auction_id", 3).orderBy("rank").collect()
    assert [(r.rank, r.auction_id, r.n) for r in top] == [(1, 2, 9), (2, 1, 5), (3, 3, 5)]


def test_top_n_is_limited_before_the_shuffle(spark, sf_dir):
    from eventflow.sources import star

    bids = star.bids(star.loader(spark, sf_dir))
    plan = A.q05_hot_items(bids, "1 day", "6 hours")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_highest_bid_ties_go_to_the_lowest_id(spark):
    bids = spark.createDataFrame(
        [(2, START, 1, 9), (1, START, 2, 9), (3, START, 3, 8)],
        "id long, ts timestamp, auction_id long, price long",
    )
    assert [r.id for r in A.q07_highest_bid(bids, "1 minute").collect()] == [1]


@pytest.mark.parametrize("size, slide", [("20 seconds", "10 seconds"), ("60 seconds", "2 seconds")])
def test_new_users_by_loop(spark, size, slide):
    seconds = lambda s: START + timedelta(seconds=s)
    persons = [(i % 5, seconds(i * 7), f"p{i}", None) for i in range(12)]
    sold = [(0, seconds(i * 3), i % 4) for i in range(25)]
    got = A.q08_monitor_new_users(
        spark.createDataFrame(persons, "id long, ts timestamp, name string, state string"),
        spark.createDataFrame(sold, "id long, ts timestamp, seller_id long"),
        size,
        slide,
    ).collect()
    width, step = micros_of(size) // 10**6, micros_of(slide) // 10**6
    expected = set()
    for start in range(-width, 120, step):
        low, high = seconds(start), seconds(start + width)
        for key in range(5):
            here = sorted((p[1], p[2]) for p in persons if p[0] == key and low <= p[1] < high)
            sales = sum(1 for s in sold if s[2] == key and low <= s[1] < high)
            if here and sales:
                expected.add((low, key, here[0][0], here[0][1], sales))
    assert {(r.window_start, r.id, r.person_ts, r.name, r.auctions) for r in got} == expected


def test_throughput_can_be_limited_to_busy_periods(rows):
    all_periods = R.throughput_report(rows, "ts", "k", "10 seconds")
    busy = R.throughput_report(rows, "ts", "k", "10 seconds", at_least=3.0)
    assert 0 < busy.count() < all_periods.count()
    assert busy.where("per_second < 3").count() == 0


def test_rows_before_a_gap_limit_are_left_out(spark):
    times = [(1, 0), (1, 10), (1, 21), (2, 0), (2, 500)]
    df = spark.createDataFrame(times, "k int, ms long").select(
        "k", F.timestamp_millis("ms").alias("ts")
    )
    found = {(r.k, r.gap_ms) for r in R.gaps(df, "ts", "k").collect()}
    assert found == {(1, 11), (2, 500)}
