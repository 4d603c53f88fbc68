"""Streaming winning bids and the queries that follow them, one row per closed auction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.functions.timing import Duration, micros_of
from eventflow.operators.shaping import tagged_union
from eventflow.operators.windows import (
    flat_window,
    pane_method,
    top_n_per_window,
    window_counts,
)
from eventflow.streaming import processors
from eventflow.streaming.processors import WON, LastPrices, RollingPrice, WinningBid

# Workers get the processors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(processors)

_ROLLING = (
    "auction_id bigint, category int, expires timestamp, average_price double, "
    "latest_auction_end timestamp"
)
_LAST = "auction_id bigint, seller_id bigint, expires timestamp, average_price double"


def winning_bids(
    auctions: DataFrame,
    bids: DataFrame,
    max_duration: Duration,
    hot: list | None = None,
    salts: int = 16,
) -> DataFrame:
    """The highest bid of each auction, reported once the watermark passes its expiry.

    Both inputs carry a watermark on ``ts`` (see ``with_event_time``). Rows older
    than the watermark are dropped. The result's event time is ``expires``.

    ``hot`` names auctions whose bids are too many for one task: these are
    handled in ``salts`` parts, whose winners meet in a second step.
    """
    micros = F.unix_micros("ts")
    lots = auctions.select(
        F.col("id").alias("key"),
        "ts",
        micros.alias("at"),
        F.unix_micros("expires").alias("ends"),
        "seller_id",
        "category",
    )
    offers = bids.select(
        F.col("auction_id").alias("key"),
        "ts",
        micros.alias("at"),
        F.col("id").alias("bid_id"),
        "price",
    )
    if hot:
        busy = F.col("key").isin(hot)
        parts = F.when(busy, F.expr(f"sequence(0L, {salts - 1}L)")).otherwise(F.expr("array(0L)"))
        lots = lots.withColumn("part", F.explode(parts))
        part = F.pmod(F.xxhash64("bid_id", "at", "price"), F.lit(salts))
        offers = offers.withColumn("part", F.when(busy, part).otherwise(F.expr("0L")))
    by = ["key", "part"] if hot else ["key"]
    merged = tagged_union(auction=lots, bid=offers)
    won = merged.groupBy(*by).transformWithState(
        statefulProcessor=WinningBid(micros_of(max_duration)),
        outputStructType=WON,
        outputMode="append",
        timeMode="EventTime",
        eventTimeColumnName="expires",
    )
    if not hot:
        return won
    merit = F.struct("price", (-F.unix_micros("bid_ts")).alias("a"), (-F.col("bid_id")).alias("b"))
    whole = won.groupBy("auction_id", "seller_id", "category", "expires").agg(
        F.max_by(F.struct("bid_id", "bid_ts", "price"), merit).alias("w")
    )
    return whole.select("auction_id", "seller_id", "category", "expires", "w.*")


def q05_hot_items(
    bids: DataFrame, size: Duration, slide: Duration, n: int = 10, method: str = "auto"
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Hot items as two parts: the stream of window counts, and what to do to each micro-batch.

    In append mode all counts of a window come out in one micro-batch, when the
    watermark passes its end. So the ranking inside the batch is whole, and is
    the limited ranking of tables, which never gathers a window in one task.
    """
    method = pane_method(method, micros_of(size), micros_of(slide))
    counts = flat_window(window_counts(bids, "ts", ["auction_id"], size, slide, method))
    return counts, lambda batch: top_n_per_window(batch, "auction_id", n)


def q04_average_price_for_category(won: DataFrame) -> DataFrame:
    """After each winning bid: average price and latest expiry of its category so far."""
    return won.groupBy("category").transformWithState(
        statefulProcessor=RollingPrice(),
        outputStructType=_ROLLING,
        outputMode="append",
        timeMode="None",
    )


def q04_final(won: DataFrame) -> DataFrame:
    """Current averages per category; run it in update or complete mode."""
    return won.groupBy("category").agg(
        F.avg("price").alias("average_price"), F.max("expires").alias("latest_auction_end")
    )


def q06_avg_selling_price(won: DataFrame, n: int = 10) -> DataFrame:
    """After each winning bid: average price of the seller's last ``n`` closed auctions."""
    return won.groupBy("seller_id").transformWithState(
        statefulProcessor=LastPrices(n),
        outputStructType=_LAST,
        outputMode="append",
        timeMode="None",
    )
