"""Joins with a key that holds a third of the rows."""

import pytest
from pyspark.sql import functions as F

from eventflow.operators import auctions as A
from eventflow.plans.skew import hot_keys, skew_safe_join


@pytest.fixture(scope="module")
def big(spark):
    key = F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000)
    return spark.range(9000).select("id", key.cast("bigint").alias("k"))


@pytest.fixture(scope="module")
def side(spark):
    return spark.range(0, 900, 1).select(
        F.col("id").alias("sk"), F.concat(F.lit("v"), F.col("id")).alias("v")
    )


def test_hot_keys_finds_the_hot_one(big):
    assert hot_keys(big, "k", share=0.1, min_rows=100) == [5]
    assert hot_keys(big, "k") == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(big, side, how):
    plain = skew_safe_join(big, side, "k", "sk", how, hot=[])
    salted = skew_safe_join(big, side, "k", "sk", how, hot=[5, 77], salts=8)
    assert salted.columns == plain.columns
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_hot_keys_are_looked_for_unless_the_side_is_broadcast(spark, big, side, monkeypatch, broadcast):
    asked = []
    monkeypatch.setattr("eventflow.plans.skew.hot_keys", lambda df, key: asked.append(key) or [5])
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, before if broadcast else "-1")
    try:
        joined = skew_safe_join(big, side, "k", "sk")
        assert asked == ([] if broadcast else ["k"])
        assert joined.count() == skew_safe_join(big, side, "k", "sk", hot=[]).count()
    finally:
        spark.conf.set(setting, before)


def test_hot_rows_are_spread(spark, big, side):
    """Without broadcast the hot key's rows reach several tasks."""
    joined = skew_safe_join(big, side.hint("merge"), "k", "sk", hot=[5], salts=16)
    hot = joined.where("k = 5").select(F.spark_partition_id().alias("p")).distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert hot.count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_side_input_keeps_bids_without_item(spark):
    bids = spark.createDataFrame(
        [(1, 0, 10, 5), (2, 0, 99, 6), (3, 0, 10, 7)], "id long, ts long, auction_id long, price long"
    )
    items = spark.createDataFrame([(10, "ten")], "auction_id long, description string")
    for hot in (None, [], [10]):
        rows = A.q13_bounded_side_input(bids, items, hot=hot)
        assert rows.columns == ["id", "ts", "auction_id", "price", "description"]
        assert {(r.id, r.description) for r in rows.collect()} == {
            (1, "ten"),
            (2, None),
            (3, "ten"),
        }


def test_winning_bid_of_a_hot_auction(spark):
    auctions = spark.range(50).select(
        "id",
        F.timestamp_seconds(F.lit(0)).alias("ts"),
        F.col("id").alias("seller_id"),
        F.lit(0).alias("category"),
        F.timestamp_seconds(F.col("id") * 40 + 100).alias("expires"),
    )
    bids = spark.range(6000).select(
        "id",
        F.timestamp_seconds(F.col("id") % 700).alias("ts"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 60).cast("bigint").alias("auction_id"),
        F.pmod(F.xxhash64("id"), F.lit(90)).alias("price"),
    )
    plain = A.winning_bids(auctions, bids, hot=[])
    split = A.winning_bids(auctions, bids, hot=[7, 8])
    best = {}
    ends = {r.id: r.expires for r in auctions.collect()}
    for b in bids.collect():
        if b.auction_id in ends and b.ts <= ends[b.auction_id]:
            merit = (-b.price, b.ts, b.id)
            best[b.auction_id] = min(best.get(b.auction_id, merit), merit)
    assert {(r.auction_id, r.bid_id) for r in plain.collect()} == {
        (auction, merit[2]) for auction, merit in best.items()
    }
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0
