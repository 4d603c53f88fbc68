"""Generated inputs as column expressions over a numbered sequence ``seq, ts``.

The sequence may be a range, a rate stream or any table with a number and a
time, so every generator works on tables and on streams without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.functions.timing import Duration, as_interval
from eventflow.functions.values import (
    Mix,
    hash_mix,
    item_label,
    letters_for,
    seller_name,
    seq_random,
    ticker_of,
)

# Postal abbreviations of the states, in the order sellers cycle through them.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA "
    "ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK "
    "OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()

# Factors that make independent series out of one sequence number.
SELLER_FACTOR, DURATION_FACTOR, CATEGORY_FACTOR = 137, 271, 743

# Fixed values of every generated trade.
TRADE_QUANTITY, TRADE_PRICE = 100, 10000

# Fixed value: a line of generated text ends after every word whose number divides by this.
WORDS_PER_LINE = 20

Price = Callable[[Column], Column]


def sequence(
    spark: SparkSession,
    n: int,
    per_second: int = 1_000_000,
    start_micros: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """``n`` numbers with evenly spaced times."""
    numbers = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    micros = F.expr(f"{start_micros} + (id * 1000000) div {per_second}")
    return numbers.select(F.col("id").alias("seq"), F.timestamp_micros(micros).alias("ts"))


def sequence_stream(
    spark: SparkSession,
    per_batch: int,
    start_millis: int = 0,
    advance_millis: int = 1000,
    partitions: int = 1,
) -> DataFrame:
    """A repeatable stream: every micro-batch brings the next ``per_batch`` numbers."""
    return (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", per_batch)
        .option("startTimestamp", start_millis)
        .option("advanceMillisPerBatch", advance_millis)
        .option("numPartitions", partitions)
        .load()
        .select(F.col("value").alias("seq"), F.col("timestamp").alias("ts"))
    )


def generate(seq: DataFrame, **columns: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows from functions of (number, time), one per column."""
    number, time = F.col("seq"), F.col("ts")
    return seq.select(*[make(number, time).alias(name) for name, make in columns.items()])


def gen_bids(
    seq: DataFrame,
    keys: int,
    price: Price | int = 100,
    per_auction: int | None = None,
    mix: Mix = hash_mix,
) -> DataFrame:
    """Bids that visit ``keys`` auctions in turn, or ``per_auction`` bids one auction after the other.

    ``price`` is a limit for random prices, 0 for none, or a function of the number.
    """
    number = F.col("seq")
    if callable(price):
        amount = price(number)
    else:
        amount = F.lit(0) if price == 0 else seq_random(number, price, mix)
    auction = F.expr(f"seq div {per_auction}") if per_auction else number % keys
    return seq.select(
        number.alias("id"),
        "ts",
        auction.cast("bigint").alias("auction_id"),
        amount.cast("bigint").alias("price"),
    )


def rising_price(mix: Mix = hash_mix, slope: int = 100) -> Price:
    """Random prices below a limit that grows by one every ``slope`` bids."""

    def price(number: Column) -> Column:
        limit = F.greatest(F.lit(1), F.floor(number / slope))
        return seq_random(number, limit, mix)

    return price


def gen_auctions(
    seq: DataFrame,
    keys: int,
    min_duration: Duration,
    max_duration: Duration,
    categories: int = 128,
    mix: Mix = hash_mix,
) -> DataFrame:
    """Auctions of random sellers and categories that last ``[min, max)``."""
    low, high = _millis(min_duration), _millis(max_duration)
    number = F.col("seq")
    lasts = low + seq_random(number * DURATION_FACTOR, high - low, mix)
    expires = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + lasts * 1000)
    return seq.select(
        number.alias("id"),
        "ts",
        seq_random(number * SELLER_FACTOR, keys, mix).alias("seller_id"),
        seq_random(number * CATEGORY_FACTOR, categories, mix).cast("int").alias("category"),
        expires.cast(seq.schema["ts"].dataType).alias("expires"),
    )


def gen_auctions_of_moving_sellers(
    seq: DataFrame,
    keys: int,
    ttl: Duration,
    per_seller: int = 100,
    categories: int = 10,
    mix: Mix = hash_mix,
) -> DataFrame:
    """Auctions whose sellers are spread over the last ``keys`` of a growing row of sellers.

    Before the first seller exists, rows carry category 1, which the join drops.
    """
    number = F.col("seq")
    seller = F.expr(f"seq div {per_seller}") - seq_random(number, keys, mix)
    known = seller >= 0
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = seq.schema["ts"].dataType
    ends = F.timestamp_micros(micros + _millis(ttl) * 1000).cast(kind)
    return seq.select(
        number.alias("id"),
        "ts",
        F.when(known, seller).otherwise(0).cast("bigint").alias("seller_id"),
        F.when(known, seq_random(number, categories, mix)).otherwise(1).cast("int").alias("category"),
        F.when(known, ends).otherwise(F.timestamp_micros(F.lit(0)).cast(kind)).alias("expires"),
    )


def gen_sales(seq: DataFrame, keys: int, mix: Mix = hash_mix) -> DataFrame:
    """Auctions with a random seller and nothing else, for the new-user query."""
    kind = seq.schema["ts"].dataType
    return seq.select(
        F.lit(0).cast("bigint").alias("id"),
        "ts",
        seq_random(F.col("seq") * SELLER_FACTOR, keys, mix).alias("seller_id"),
        F.lit(0).alias("category"),
        F.timestamp_micros(F.lit(0)).cast(kind).alias("expires"),
    )


def gen_persons(
    seq: DataFrame, keys: int | None = None, with_state: bool = True, mix: Mix = hash_mix
) -> DataFrame:
    """Sellers numbered in order, or with random ids below ``keys``; states take turns."""
    number = F.col("seq")
    person = number if keys is None else seq_random(number, keys, mix)
    names = F.array(*[F.lit(s) for s in STATES])
    state = F.element_at(names, (number % len(STATES) + 1).cast("int"))
    return seq.select(
        person.alias("id"),
        "ts",
        seller_name(person).alias("name"),
        (state if with_state else F.lit(None).cast("string")).alias("state"),
    )


def gen_trades(seq: DataFrame, keys: int) -> DataFrame:
    """Trades whose tickers take turns, with fixed quantity and price (in cents)."""
    return seq.select(
        F.col("ts").alias("time"),
        ticker_of(F.col("seq") % keys, letters_for(keys)).alias("ticker"),
        F.lit(TRADE_QUANTITY).alias("quantity"),
        F.lit(TRADE_PRICE).alias("price"),
    )


def text_line_numbers(spark: SparkSession, total: int) -> DataFrame:
    """Numbers of the text lines that ``total`` words fill."""
    return spark.range((total - 1 + WORDS_PER_LINE - 1) // WORDS_PER_LINE + 1)


def gen_words(numbers: DataFrame, total: int | Column, distinct: int) -> DataFrame:
    """Text of ``total`` words ``i % distinct``, one line per row of ``numbers`` (column id).

    A line ends after each word whose number divides by 20, so line 0 is word 0
    alone. A line's words follow from its number: nothing is grouped or shuffled.
    """
    line = F.col("id")
    total = F.lit(total).cast("bigint") if isinstance(total, int) else total
    first = F.when(line == 0, F.lit(0).cast("bigint")).otherwise(
        (line - 1) * WORDS_PER_LINE + 1
    )
    last = F.least(line * WORDS_PER_LINE, total - 1)
    spans = numbers.select(line.alias("line"), first.alias("first"), last.alias("last"))
    words = F.transform(F.sequence("first", "last"), lambda i: (i % distinct).cast("string"))
    return spans.where(F.col("first") <= F.col("last")).select(
        "line", F.array_join(words, " ").alias("value")
    )


def item_descriptions(spark: SparkSession, n: int) -> DataFrame:
    """Labels of the auctions 0 to n-1."""
    return spark.range(n).select(
        F.col("id").alias("auction_id"), item_label(F.col("id")).alias("description")
    )


def _millis(duration: Duration) -> int:
    return int(as_interval(duration).split()[0]) // 1000
