"""Winning bids, and the averages that follow them, on streams: open auctions are a carried table.

What a micro-batch costs grows with its rows and the open auctions. A hot auction's bids are reduced in
all tasks before they meet; rows that come late and bids whose auction never comes go to tables of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventflow.functions.timing import Duration, micros_of
from eventflow.operators.shaping import tagged_union
from eventflow.plans.prefix import running, trailing
from eventflow.streaming.carried import Batch, Carried, lag_of, split_late

WON = (
    "auction_id bigint, seller_id bigint, category int, expires timestamp, "
    "bid_id bigint, bid_ts timestamp, price bigint"
)
LATE = (
    "kind string, key bigint, ts timestamp, expires timestamp, seller_id bigint, category int, "
    "bid_id bigint, price bigint"
)
ORPHANS = "auction_id bigint, bid_id bigint, bid_ts timestamp, price bigint, removed_after timestamp"
ROLLING = (
    "auction_id bigint, category int, expires timestamp, average_price double, "
    "latest_auction_end timestamp"
)
LAST = "auction_id bigint, seller_id bigint, expires timestamp, average_price double"

_OFFER = ["bid_id", "bid_ts", "price"]
_LOT = ["seller_id", "category", "expires"]
_LOTS = "auction_id bigint, seller_id bigint, category int, expires timestamp, started timestamp"
_MET = f"of bigint, {WON}"
_SUMS = "category int, carried_sum bigint, carried_n bigint, carried_end timestamp"
_PRICES = "auction_id bigint, seller_id bigint, expires timestamp, price bigint"

Follow = Callable[[Batch, DataFrame], None]


def _best(offers: DataFrame) -> DataFrame:
    """The winner of each auction: highest price, then earliest, then lowest id."""
    # The auction's own columns are the same in all its rows and decide nothing.
    merit = F.struct("price", (-F.unix_micros("bid_ts")).alias("a"), (-F.col("bid_id")).alias("b"), *_LOT)
    won = offers.groupBy("auction_id").agg(F.max(merit).alias("w"))
    id_and_time = [(-F.col("w.b")).alias("bid_id"), F.timestamp_micros(-F.col("w.a")).alias("bid_ts")]
    return won.select("auction_id", *[f"w.{n}" for n in _LOT], *id_and_time, "w.price")


def winning_bids(
    auctions: DataFrame,
    bids: DataFrame,
    wait: Duration,
    follow: Follow | None = None,
    folder: str | None = None,
) -> Carried:
    """The highest bid of each auction, emitted as ``won`` once the watermark is past its expiry.

    Both streams carry a watermark on ``ts``, whose lags count. Rows behind the watermark are emitted as
    ``late`` and do not count. A bid belongs to an auction from ``wait`` before its start to ``wait`` after
    its expiry, and can win up to the expiry; so a bid waits that long for its auction, and a closed
    auction is remembered that long. Bids that belong to none are emitted as ``orphans``. Which rows
    share a micro-batch changes none of this. Of several rows of an auction the first by time counts.
    Rows without key are left out, as are bids without time. ``follow`` is given each micro-batch's
    winners. The notes ``state`` have the rows carried after each micro-batch.
    """
    keep = micros_of(wait)
    lags = {"auction": lag_of(auctions), "bid": lag_of(bids)}
    lots = auctions.select(
        F.col("id").alias("key"), "ts", F.col("expires").cast("timestamp").alias("expires"), "seller_id", "category"
    )
    offers = bids.select(F.col("auction_id").alias("key"), "ts", F.col("id").alias("bid_id"), "price")

    def step(batch: Batch) -> None:
        before, mark = batch.clock(lags)
        rows, late = split_late(batch.rows.where("key is not null"), before)
        if batch.late:
            batch.emit("late", late)
        at, ends = F.unix_micros("bid_ts"), F.unix_micros("expires")
        # What was carried is all that the micro-batch before had; what was over or given up then is left out.
        lots, leading = batch.carried("lots", _LOTS), batch.carried("leading", WON).where("bid_id is not null")
        waiting = batch.carried("met", _MET).where("auction_id is null")
        still, gone, over = F.lit(True), F.lit(False), F.lit(False)
        if before is not None:
            lots, leading = lots.where(ends >= before - keep), leading.where(ends >= before)
            waiting = waiting.where(at >= before - keep)
        if mark is not None:
            still, over = ends >= mark - keep, ends < mark
            gone = F.col("auction_id").isNull() & (at < mark - keep)
        known = batch.carry("lots", _known(lots, rows.where("kind = 'auction'")), {"lots": F.count_if(still)})
        new = rows.where("kind = 'bid' and ts is not null").select(
            F.col("key").alias("of"), "bid_id", F.col("ts").alias("bid_ts"), "price"
        )
        asked = waiting.select("of", *_OFFER).unionByName(new)
        belongs = (at >= F.unix_micros("started") - keep) & (at <= ends + keep)
        met = asked.join(known, (F.col("of") == F.col("auction_id")) & belongs, "left").drop("started")
        # Bids between the expiry and the end of the wait have met their auction, and that is all.
        met = met.where("auction_id is null or bid_ts <= expires")
        counted = {"waiting": F.count_if(F.col("auction_id").isNull() & ~gone), "orphans": F.count_if(gone)}
        met = batch.carry("met", met, counted)
        best = _best(met.where("auction_id is not null").drop("of").unionByName(leading))
        best = batch.carry("leading", best)
        won = batch.emit("won", best.where(over & F.col("bid_id").isNotNull()))
        if batch.counts["orphans"]:
            due = F.timestamp_micros(at + keep)
            given_up = met.where(gone).select(F.col("of").alias("auction_id"), *_OFFER)
            batch.emit("orphans", given_up.withColumn("removed_after", due))
        batch.note("state", {n: batch.counts[n] for n in ("lots", "waiting")})
        if follow is not None:
            follow(batch, won)

    return Carried(tagged_union(auction=lots, bid=offers), step, folder)


def _known(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Auctions carried over and new ones, one row each."""
    new = rows.groupBy("key").agg(F.min(F.struct(F.col("ts").alias("started"), "expires", "seller_id", "category")).alias("lot"))
    opened = new.select(F.col("key").alias("auction_id"), "lot.*").where("expires is not null")
    return old.unionByName(opened.join(old.select("auction_id"), "auction_id", "left_anti"))


def rolling_averages(batch: Batch, won: DataFrame) -> None:
    """Emit ``rolling``: after each winning bid, average price and latest expiry of its category so far.

    The micro-batch's rows are scanned as a table is; one carried row per category is added. Winners
    come out in order of expiry from one micro-batch to the next.
    """
    so_far = running(
        won.select("auction_id", "category", "expires", "price"),
        ["category"],
        ["expires", "auction_id"],
        {
            "s": ("sum", F.col("price")),
            "n": ("count", F.col("price")),
            "end": ("max", F.col("expires")),
        },
    )
    carried = batch.carried("sums", _SUMS)
    earlier = carried.withColumnRenamed("category", "of")
    joined = so_far.join(earlier, F.col("category").eqNullSafe(F.col("of")), "left")

    def plus(here: str, before: str) -> Column:
        return F.col(here) + F.coalesce(F.col(before), F.lit(0))

    batch.emit(
        "rolling",
        joined.select(
            "auction_id",
            "category",
            "expires",
            (plus("s", "carried_sum") / plus("n", "carried_n")).alias("average_price"),
            F.greatest("end", "carried_end").alias("latest_auction_end"),
        ),
    )
    here = won.select("category", F.col("price").alias("s"), F.lit(1).cast("bigint").alias("n"), F.col("expires").alias("end"))
    both = here.unionByName(carried.toDF("category", "s", "n", "end"))
    batch.carry(
        "sums",
        both.groupBy("category").agg(
            F.sum("s").alias("carried_sum"), F.sum("n").alias("carried_n"), F.max("end").alias("carried_end")
        ),
    )


def last_prices(n: int = 10) -> Follow:
    """Emit ``last``: after each winning bid, the average price of its seller's last ``n`` closed auctions.

    Carried are the last ``n - 1`` prices of each seller.
    """

    def follow(batch: Batch, won: DataFrame) -> None:
        columns = ["auction_id", "seller_id", "expires", "price"]
        old = batch.carried("prices", _PRICES).withColumn("new", F.lit(False))
        both = old.unionByName(won.select(*columns).withColumn("new", F.lit(True)))
        order = ["expires", "auction_id"]
        averaged = trailing(
            both,
            ["seller_id"],
            order,
            -(n - 1),
            0,
            lambda frame: {"average_price": F.avg("price").over(frame)},
        )
        batch.emit("last", averaged.where("new").select("auction_id", "seller_id", "expires", "average_price"))
        # With the limit on its number, a task passes on n - 1 rows of a seller at most.
        latest = Window.partitionBy("seller_id").orderBy(F.desc("expires"), F.desc("auction_id"))
        numbered = both.withColumn("number", F.row_number().over(latest))
        batch.carry("prices", numbered.where(F.col("number") < n).select(*columns))

    return follow
