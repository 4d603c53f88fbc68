"""Auction queries over persons, auctions and bids (columns as in ``schemas``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.functions.timing import (
    Duration,
    as_interval,
    micros_of,
    time_type,
)
from eventflow.operators.shaping import tagged_union
from eventflow.operators.windows import (
    DIRECT_RATIO,
    flat_window,
    sliding_count,
    slot_of,
    top_n_per_window,
    window_bounds,
)
from eventflow.plans.prefix import running, trailing
from eventflow.plans.skew import skew_safe_join

# Fixed value: the states whose sellers are suggested.
SUGGESTED_STATES = ("OR", "CA", "ID")


def q01_currency_conversion(bids: DataFrame) -> DataFrame:
    """Prices times 8/10 in whole numbers, multiplied first and cut towards zero."""
    return bids.select("id", "ts", "auction_id", F.expr("(price * 8) div 10").alias("price"))


def q02_selection(bids: DataFrame, modulus: int = 128) -> DataFrame:
    """Bids on every ``modulus``-th auction."""
    return bids.where(F.col("auction_id") % modulus == 0).select("ts", "auction_id", "price")


def q03_local_item_suggestion(
    persons: DataFrame,
    auctions: DataFrame,
    states: Sequence[str] = SUGGESTED_STATES,
    category: int = 0,
    ttl: Duration | None = None,
    hot: list | None = None,
) -> DataFrame:
    """Auctions of one category with their sellers from the given states.

    Either side may come first. ``ttl`` bounds the event-time distance of a pair;
    streams need it, and both sides need a watermark. Person ids are taken to be
    unique: a second person with the same id pairs with all auctions again.
    """
    sellers = persons.where(F.col("state").isin(*states)).select(
        F.col("id").alias("person_id"),
        F.col("ts").alias("person_ts"),
        F.col("name").alias("seller_name"),
        F.col("state").alias("seller_state"),
    )
    offered = auctions.where(F.col("category") == category).select(
        F.col("seller_id"),
        F.col("ts").alias("auction_start"),
        F.col("id").alias("auction_id"),
        F.col("category"),
    )
    near = None
    if ttl is not None:
        bound = F.expr(f"INTERVAL {as_interval(ttl)}")
        near = F.col("auction_start").between(
            F.col("person_ts") - bound, F.col("person_ts") + bound
        )
    elif persons.isStreaming or auctions.isStreaming:
        raise ValueError("a stream needs ttl, or its state would grow for ever")
    joined = skew_safe_join(
        offered, sellers, "seller_id", "person_id", extra=near, salt_by=["auction_id"], hot=hot
    )
    return joined.select(
        "seller_name", "seller_state", "auction_start", "auction_id", "category"
    )


def winning_bids(
    auctions: DataFrame,
    bids: DataFrame,
    require_started: bool = False,
    hot: list | None = None,
) -> DataFrame:
    """The highest bid of each auction up to and including its expiry.

    Equal prices: the earlier bid, then the lower id. Auctions without bids are
    left out. The streaming form is ``streaming.auctions.winning_bids``.
    """
    if auctions.isStreaming or bids.isStreaming:
        raise ValueError("use eventflow.streaming.auctions.winning_bids for streams")
    offers = bids.select(
        F.col("auction_id").alias("bid_auction_id"),
        F.col("id").alias("bid_id"),
        F.col("ts").alias("bid_ts"),
        "price",
    )
    lots = auctions.select(
        F.col("id").alias("auction_id"),
        F.col("ts").alias("auction_ts"),
        "seller_id",
        "category",
        "expires",
    )
    in_time = F.col("bid_ts") <= F.col("expires")
    if require_started:
        in_time = in_time & (F.col("bid_ts") >= F.col("auction_ts"))
    pairs = skew_safe_join(
        offers,
        lots,
        "bid_auction_id",
        "auction_id",
        extra=in_time,
        salt_by=["bid_id", "bid_ts", "price"],
        hot=hot,
    )
    # Earlier and lower must win a maximum, hence the negated time and id.
    merit = F.struct(
        F.col("price"),
        (-F.unix_micros(F.col("bid_ts").cast("timestamp"))).alias("a"),
        (-F.col("bid_id")).alias("b"),
    )
    best = pairs.groupBy("auction_id").agg(
        F.max_by(F.struct("seller_id", "category", "expires", "bid_id", "bid_ts", "price"), merit)
        .alias("w")
    )
    return best.select("auction_id", "w.*")


def q04_average_price_for_category(
    won: DataFrame, spread: bool | None = None
) -> DataFrame:
    """Per winning bid: average price and latest expiry of its category so far.

    ``won`` comes from ``winning_bids``; order is (expires, auction_id).
    """
    so_far = running(
        won.select("auction_id", "category", "expires", "price"),
        ["category"],
        ["expires", "auction_id"],
        {
            "__sum": ("sum", F.col("price")),
            "__n": ("count", F.col("price")),
            "latest_auction_end": ("max", F.col("expires")),
        },
        spread,
        derived=True,
    )
    return so_far.select(
        "auction_id",
        "category",
        "expires",
        (F.col("__sum") / F.col("__n")).alias("average_price"),
        "latest_auction_end",
    )


def q04_final(won: DataFrame) -> DataFrame:
    """Average price and latest expiry per category over all winning bids."""
    return won.groupBy("category").agg(
        F.avg("price").alias("average_price"), F.max("expires").alias("latest_auction_end")
    )


def q05_hot_items(
    bids: DataFrame, size: Duration, slide: Duration, n: int = 10, method: str = "auto"
) -> DataFrame:
    """The ``n`` auctions with the most bids in each sliding window, one row per rank.

    The streaming form is ``streaming.auctions.q05_hot_items``.
    """
    if bids.isStreaming:
        raise ValueError("use eventflow.streaming.auctions.q05_hot_items for streams")
    counts = sliding_count(bids, "ts", "auction_id", size, slide, method)
    return top_n_per_window(counts, "auction_id", n)


def q06_avg_selling_price(
    won: DataFrame, n: int = 10, spread: bool | None = None, block_rows: int | None = None
) -> DataFrame:
    """Per winning bid: average price of the seller's last ``n`` closed auctions."""
    options = {} if block_rows is None else {"block_rows": block_rows}
    result = trailing(
        won.select("auction_id", "seller_id", "expires", "price"),
        ["seller_id"],
        ["expires", "auction_id"],
        -(n - 1),
        0,
        lambda frame: {"average_price": F.avg("price").over(frame)},
        spread,
        derived=True,
        **options,
    )
    return result.select("auction_id", "seller_id", "expires", "average_price")


def q07_highest_bid(bids: DataFrame, size: Duration) -> DataFrame:
    """The highest bid of each tumbling window, ties by lowest id."""
    merit = F.struct(F.col("price"), (-F.col("id")).alias("a"))
    bid = F.struct("id", "ts", "auction_id", "price")
    if bids.isStreaming:
        best = bids.groupBy(F.window("ts", as_interval(size))).agg(
            F.max_by(bid, merit).alias("b")
        )
        return flat_window(best).select("window_start", "window_end", "b.*")
    width = micros_of(size)
    best = (
        bids.where(F.col("ts").isNotNull())
        .withColumn("__slot", slot_of(bids, "ts", width))
        .groupBy("__slot")
        .agg(F.max_by(bid, merit).alias("b"))
    )
    bounds = window_bounds(F.col("__slot"), width, width, time_type(bids, "ts"))
    return best.select(*bounds, "b.*")


def q08_monitor_new_users(
    persons: DataFrame, auctions: DataFrame, size: Duration, slide: Duration
) -> DataFrame:
    """Persons who appear and sell in the same sliding window, with their sales.

    Several rows of one person in a window give the earliest. Streams keep one
    state for both sides; tables are aggregated apart, so that names do not
    travel with the sales, and then joined as they lie, on (window, id).
    """
    arrivals = persons.select("id", "ts", "name", "state")
    sales = auctions.select(F.col("seller_id").alias("id"), "ts")
    if persons.isStreaming or auctions.isStreaming:
        both = tagged_union(person=arrivals, sale=sales)
        is_person = F.col("kind") == "person"
        grouped = both.groupBy(
            F.window("ts", as_interval(size), as_interval(slide)), "id"
        ).agg(
            F.min_by(
                F.when(is_person, F.struct("ts", "name", "state")),
                F.when(is_person, F.struct("ts", "name", "state")),
            ).alias("p"),
            F.count_if(F.col("kind") == "sale").alias("auctions"),
        )
        met = flat_window(grouped.where(F.col("p").isNotNull() & (F.col("auctions") > 0)))
        return met.select(
            "window_start",
            "window_end",
            "id",
            F.col("p.ts").alias("person_ts"),
            F.col("p.name").alias("name"),
            F.col("p.state").alias("state"),
            "auctions",
        )
    width, step = micros_of(size), micros_of(slide)
    if width % step != 0:
        raise ValueError("the slide must divide the window size")
    ratio = width // step
    first = _pane_rows(arrivals, step).select("pane", "id", F.struct("ts", "name", "state").alias("p"))
    counted = _pane_rows(sales, step).select("pane", "id", F.lit(1).cast("bigint").alias("n"))
    if ratio > DIRECT_RATIO:  # one row per pane and id before rows are copied into windows
        first = first.groupBy("pane", "id").agg(F.min("p").alias("p"))
        counted = counted.groupBy("pane", "id").agg(F.sum("n").alias("n"))
    newcomers = _into_windows(first, ratio).groupBy("slot", "id").agg(F.min("p").alias("p"))
    sold = _into_windows(counted, ratio).groupBy("slot", "id").agg(F.sum("n").alias("auctions"))
    bounds = window_bounds(F.col("slot"), step, width, time_type(persons, "ts"))
    return newcomers.join(sold, ["slot", "id"]).select(
        *bounds,
        "id",
        F.col("p.ts").alias("person_ts"),
        F.col("p.name").alias("name"),
        F.col("p.state").alias("state"),
        "auctions",
    )


def q13_bounded_side_input(
    bids: DataFrame, items: DataFrame, hot: list | None = None
) -> DataFrame:
    """Bids with the description of their auction; a bid without one keeps null.

    Catalyst broadcasts ``items`` when its size allows; a list too large for
    that is joined by shuffle, with hot auctions split.
    """
    side = items.select(F.col("auction_id").alias("item_id"), "description")
    joined = skew_safe_join(
        bids, side, "auction_id", "item_id", how="left", salt_by=["id"], hot=hot
    )
    return joined.select(*[bids[c] if not hot else F.col(c) for c in bids.columns], "description")


def _pane_rows(df: DataFrame, step: int) -> DataFrame:
    return df.where(F.col("ts").isNotNull()).withColumn("pane", slot_of(df, "ts", step))


def _into_windows(panes: DataFrame, ratio: int) -> DataFrame:
    """Pane results once per window they belong to; ``slot`` is the window's first pane."""
    if ratio == 1:
        return panes.withColumnRenamed("pane", "slot")
    rest = [c for c in panes.columns if c != "pane"]
    return panes.select(
        F.explode(F.sequence(F.col("pane") - (ratio - 1), F.col("pane"))).alias("slot"), *rest
    )
