"""Stateful processors for results that built-in streaming operators cannot express.

Spark partitions rows by key, keeps the state in its state store and fires the
timers; a processor only says what one key does with its rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OFFERS = T.ArrayType(
    T.StructType(
        [
            T.StructField("bid_id", T.LongType()),
            T.StructField("bid_ts", T.LongType()),
            T.StructField("price", T.LongType()),
        ]
    )
)

# All an auction needs is one value, so that a batch reads and writes it once.
AUCTION_STATE = T.StructType(
    [
        T.StructField("seller_id", T.LongType()),
        T.StructField("category", T.IntegerType()),
        T.StructField("expires", T.LongType()),
        T.StructField("offers", OFFERS),
    ]
)

SUMS = T.StructType(
    [
        T.StructField("total", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("latest", T.LongType()),
    ]
)

PRICE = T.StructType([T.StructField("price", T.LongType())])

Offer = tuple[int, int, int]

WON = T.StructType(
    [
        T.StructField("auction_id", T.LongType()),
        T.StructField("seller_id", T.LongType()),
        T.StructField("category", T.IntegerType()),
        T.StructField("expires", T.TimestampType()),
        T.StructField("bid_id", T.LongType()),
        T.StructField("bid_ts", T.TimestampType()),
        T.StructField("price", T.LongType()),
    ]
)


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def at(micros: int) -> datetime:
    return _EPOCH + timedelta(microseconds=micros)


def micros_of_time(time: datetime) -> int:
    if time.tzinfo is None:
        time = time.astimezone()
    return (time - _EPOCH) // timedelta(microseconds=1)


def leading_offers(offers: Iterable[Offer]) -> list[Offer]:
    """Offers (bid_id, bid_ts, price) that are higher than every offer before them.

    Only these can win: whatever the expiry, the highest offer until then is the
    last one in this row of records.
    """
    records: list[Offer] = []
    for offer in sorted(offers, key=lambda o: (o[1], -o[2], o[0])):
        if not records or offer[2] > records[-1][2]:
            records.append(offer)
    return records


class WinningBid(StatefulProcessor):
    """One auction: remembers it and its leading bids, and reports the winner at its expiry.

    Rows come with ``kind`` auction or bid and times in microseconds. Bids may
    come before their auction. Once the expiry is known only the best bid is
    kept. A key without an auction is dropped ``max_duration`` after its latest bid.
    """

    def __init__(self, max_duration_micros: int) -> None:
        self.keep_millis = _ceil_millis(max_duration_micros)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.auction = handle.getValueState("auction", AUCTION_STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        starts, new = [], []
        for row in rows:
            if row["kind"] == "auction":
                starts.append((row["at"], row["ends"], row["seller_id"], row["category"]))
            else:
                new.append((row["bid_id"], row["at"], row["price"]))
        seller, category, expires, kept = self._known()
        opened = expires is None and bool(starts)
        if opened:
            _, expires, seller, category = min(starts)
        if opened or (expires is None and new):
            if kept:  # waiting for the auction, so there is a clean-up timer
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(
                _ceil_millis(expires)
                if opened
                else _ceil_millis(max(o[1] for o in kept + new)) + self.keep_millis
            )
        if expires is None:
            leading = leading_offers(kept + new)
        else:
            leading = leading_offers(o for o in kept + new if o[1] <= expires)[-1:]
        if opened or leading != kept:
            self.auction.update((seller, category, expires, leading))
        return iter(())

    def _known(self) -> tuple[int | None, int | None, int | None, list[Offer]]:
        state = self.auction.get()
        if state is None:
            return None, None, None, []
        seller, category, expires, offers = state
        return seller, category, expires, [tuple(o) for o in offers]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seller, category, expires, offers = self._known()
        self.auction.clear()
        if expires is None or not offers:
            return
        bid_id, bid_ts, price = offers[0]
        yield Row(
            auction_id=key[0],
            seller_id=seller,
            category=category,
            expires=at(expires),
            bid_id=bid_id,
            bid_ts=at(bid_ts),
            price=price,
        )

    def close(self) -> None:
        pass


class RollingPrice(StatefulProcessor):
    """Average price and latest expiry of one category, after each winning bid."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", SUMS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.sums.get()
        total, n, latest = tuple(known) if known is not None else (0, 0, None)
        results = []
        for ends, auction, price in _by_expiry(rows):
            total, n = total + price, n + 1
            latest = ends if latest is None else max(latest, ends)
            results.append(
                Row(
                    auction_id=auction,
                    category=key[0],
                    expires=at(ends),
                    average_price=total / n,
                    latest_auction_end=at(latest),
                )
            )
        self.sums.update((total, n, latest))
        return iter(results)

    def close(self) -> None:
        pass


class LastPrices(StatefulProcessor):
    """Average price of one seller's last ``n`` closed auctions, after each of them."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prices = handle.getListState("prices", PRICE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = deque((row[0] for row in self.prices.get()), maxlen=self.n)
        results = []
        for ends, auction, price in _by_expiry(rows):
            last.append(price)
            results.append(
                Row(
                    auction_id=auction,
                    seller_id=key[0],
                    expires=at(ends),
                    average_price=sum(last) / len(last),
                )
            )
        self.prices.put([(price,) for price in last])
        return iter(results)

    def close(self) -> None:
        pass


def _by_expiry(rows: Iterator[Row]) -> list[tuple[int, int, int]]:
    return sorted((micros_of_time(r["expires"]), r["auction_id"], r["price"]) for r in rows)


def _ceil_millis(micros: int) -> int:
    return -(-micros // 1000)
