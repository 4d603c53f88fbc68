"""Hand-made cases of the auction queries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventflow import schemas
from eventflow.operators import auctions as A
from eventflow.operators import shaping as S

T0 = datetime(2024, 1, 1)


def at(seconds, micros=0):
    return T0 + timedelta(seconds=seconds, microseconds=micros)


def auctions_of(spark, rows):
    return spark.createDataFrame(rows, schemas.AUCTION)


def bids_of(spark, rows):
    return spark.createDataFrame(rows, schemas.BID)


def winners(spark, auctions, bids, **options):
    won = A.winning_bids(auctions_of(spark, auctions), bids_of(spark, bids), **options)
    return {r.auction_id: r.bid_id for r in won.collect()}


def test_currency_is_cut_towards_zero(spark):
    prices = [0, 1, 9, 10, 11, -7, -10]
    bids = bids_of(spark, [(i, T0, 0, p) for i, p in enumerate(prices)])
    got = [r.price for r in A.q01_currency_conversion(bids).orderBy("id").collect()]
    assert got == [int(p * 8 / 10) for p in prices] and got[5] == -5


def test_equal_prices_keep_the_earlier_bid(spark):
    auction = [(1, at(0), 5, 0, at(100))]
    bids = [(10, at(7), 1, 50), (11, at(3), 1, 50), (12, at(1), 1, 40), (9, at(3), 1, 50)]
    assert winners(spark, auction, bids) == {1: 9}


def test_bid_at_expiry_counts_and_later_does_not(spark):
    auctions = [(1, at(0), 5, 0, at(100)), (2, at(0), 5, 0, at(100))]
    bids = [
        (10, at(50), 1, 1),
        (11, at(100), 1, 9),
        (12, at(50), 2, 1),
        (13, at(100, 1000), 2, 9),
    ]
    assert winners(spark, auctions, bids) == {1: 11, 2: 12}


def test_auction_without_bid_and_bid_without_auction_give_nothing(spark):
    auctions = [(1, at(0), 5, 0, at(100)), (2, at(0), 5, 0, at(100))]
    assert winners(spark, auctions, [(10, at(1), 1, 1), (11, at(1), 3, 1)]) == {1: 10}


def test_bid_before_the_auction_counts_unless_refused(spark):
    auction = [(1, at(50), 5, 0, at(100))]
    bids = [(10, at(1), 1, 9), (11, at(60), 1, 1)]
    assert winners(spark, auction, bids) == {1: 10}
    assert winners(spark, auction, bids, require_started=True) == {1: 11}


def test_sellers_may_come_before_or_after_their_auctions(spark):
    persons = spark.createDataFrame(
        [(1, at(0), "a", "OR"), (2, at(90), "b", "CA"), (3, at(0), "c", "NY"), (4, at(0), "d", None)],
        schemas.PERSON,
    )
    auctions = auctions_of(
        spark,
        [
            (10, at(50), 1, 0, at(99)),
            (11, at(50), 2, 0, at(99)),
            (12, at(50), 3, 0, at(99)),
            (13, at(50), 1, 1, at(99)),
            (14, at(50), 4, 0, at(99)),
        ],
    )
    got = A.q03_local_item_suggestion(persons, auctions)
    assert got.columns == [
        "seller_name",
        "seller_state",
        "auction_start",
        "auction_id",
        "category",
    ]
    assert {(r.seller_name, r.auction_id) for r in got.collect()} == {("a", 10), ("b", 11)}
    near = A.q03_local_item_suggestion(persons, auctions, ttl="45 seconds")
    assert {r.auction_id for r in near.collect()} == {11}


def test_rolling_average_and_latest_expiry(spark):
    won = spark.createDataFrame(
        [(1, 0, at(30), 10), (2, 0, at(10), 20), (3, 1, at(20), 5), (4, 0, at(30), 60)],
        "auction_id long, category int, expires timestamp, price long",
    )
    for spread in (True, False):
        got = A.q04_average_price_for_category(won, spread)
        rows = {r.auction_id: (r.average_price, r.latest_auction_end) for r in got.collect()}
        assert rows == {
            2: (20.0, at(10)),
            1: (15.0, at(30)),
            4: (30.0, at(30)),
            3: (5.0, at(20)),
        }


def test_average_of_the_last_n(spark):
    won = spark.range(40).select(
        F.col("id").alias("auction_id"),
        (F.col("id") % 2).alias("seller_id"),
        F.timestamp_seconds("id").alias("expires"),
        (F.col("id") * F.col("id")).alias("price"),
    )
    expected = {}
    for seller in (0, 1):
        prices = []
        for i in range(seller, 40, 2):
            prices = (prices + [i * i])[-3:]
            expected[i] = sum(prices) / len(prices)
    for options in ({"spread": False}, {"spread": True, "block_rows": 4}):
        got = A.q06_avg_selling_price(won, 3, **options)
        assert {r.auction_id: r.average_price for r in got.collect()} == expected


def test_sieve_factor_below_one_keeps_everything(spark):
    assert S.sieve(spark.range(10), "id", 0).count() == 10
    assert S.sieve(spark.range(10), "id", 3).count() == 4


def test_short_tickers_have_no_suffix(spark):
    df = spark.createDataFrame([("A",), ("AA",), ("BAA",), ("AAB",)], "ticker string")
    assert {r.ticker for r in S.ticker_suffix(df).collect()} == {"AA", "BAA"}


def test_merge_keeps_all_rows_and_names_their_input(spark):
    merged = S.tagged_union(a=spark.range(3), b=spark.range(2).withColumn("x", F.lit(1)))
    assert merged.groupBy("kind").count().orderBy("kind").collect() == [("a", 3), ("b", 2)]
    with pytest.raises(ValueError):
        S.tagged_union()


def test_streams_are_sent_to_their_own_form(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        A.winning_bids(stream, stream)
    with pytest.raises(ValueError):
        A.q05_hot_items(stream, "1 day", "1 hour")
