"""Auction, trade, text and latency views over the star-schema tables and the event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.functions.values import item_label, ticker_of

Load = Callable[[str], DataFrame]

TICKER_LETTERS = 3


# How far behind the latest time of a table its rows may come, in whatever order its files
# are read: the time span of orders and line items, whose rows are in no order of time, and
# that of the events. Customers are all known from the start.
LAGS = {"events": "62 days", "orders": "3660 days", "lineitem": "3660 days", "customer": "0 seconds"}

# Rows that end a table read as a stream: later than all others by more than any lag.
END_ROW = {
    "ts": "2200-01-01",
    "event_id": -1,
    "user_id": 0,
    "value": 0,
    "o_orderdate": "2200-01-01",
    "l_shipdate": "2200-01-01",
    "o_orderkey": -1,
    "o_custkey": -1,
    "o_orderpriority": "1-URGENT",
    "l_orderkey": -2,
    "l_linenumber": 1,
    "l_extendedprice": 0,
}
END_ROWS: dict[str, tuple[dict[str, str], ...]] = {
    "events": ({"event_type": "signup"}, {"event_type": "purchase"}),
    "orders": ({},),
    "lineitem": ({},),
}


def loader(spark: SparkSession, folder: str) -> Load:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def end_rows(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The rows that end a table, in its columns."""
    given = [{**END_ROW, **row} for row in END_ROWS[name]]
    rows = [tuple(str(row[f.name]) if f.name in row else None for f in schema) for row in given]
    text = spark.createDataFrame(rows, ", ".join(f"`{f.name}` string" for f in schema))
    return text.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def bids(load: Load) -> DataFrame:
    """Events as bids: the user is the auction, the value the price."""
    return load("events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").alias("auction_id"),
        _cents("value").alias("price"),
    )


def auctions(load: Load) -> DataFrame:
    """Orders as auctions that last 30 to 90 days."""
    days = F.make_dt_interval((F.col("o_orderkey") % 61 + 30).cast("int"))
    return load("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_custkey").alias("seller_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("category"),
        (F.col("o_orderdate") + days).alias("expires"),
    )


MAX_DURATION = "91 days"


def auction_bids(load: Load) -> DataFrame:
    """Line items as bids on the orders. They have no unique number of their own."""
    return load("lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("auction_id"),
        _cents("l_extendedprice").alias("price"),
    )


def persons(load: Load) -> DataFrame:
    """Customers as sellers; the nation is the state. They are known from the start."""
    nations = load("nation").select("n_nationkey", "n_name")
    joined = load("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_custkey").alias("id"),
        F.lit("1995-01-01").cast("timestamp_ntz").alias("ts"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("state"),
    )


STATES = ("NATION_1", "NATION_5", "NATION_12")


def new_users(load: Load) -> DataFrame:
    events = load("events").where(F.col("event_type") == "signup")
    return events.select(
        F.col("user_id").alias("id"),
        "ts",
        F.concat(F.lit("Seller #"), F.col("user_id").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("state"),
    )


def sales(load: Load) -> DataFrame:
    events = load("events").where(F.col("event_type") == "purchase")
    return events.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("seller_id"))


def trades(load: Load) -> DataFrame:
    return load("events").select(
        F.col("ts").alias("time"),
        ticker_of(F.col("user_id"), TICKER_LETTERS).alias("ticker"),
        F.lit(100).alias("quantity"),
        _cents("value").cast("int").alias("price"),
    )


def arrivals(load: Load) -> DataFrame:
    """Events on a grid of ten minutes that come in late by their value in minutes."""
    late = F.make_dt_interval(secs=F.round(F.col("value") * 60).cast("decimal(18,6)"))
    return load("events").select(
        "event_id",
        "user_id",
        F.timestamp_seconds(
            F.expr("(unix_micros(cast(ts as timestamp)) div 600000000) * 600")
        )
        .cast("timestamp_ntz")
        .alias("ts"),
        late.alias("late"),
    ).select("event_id", "user_id", "ts", (F.col("ts") + F.col("late")).alias("arrival"))


def items(load: Load) -> DataFrame:
    return load("customer").select(
        F.col("c_custkey").alias("auction_id"), item_label(F.col("c_custkey")).alias("description")
    )


def lines(load: Load) -> DataFrame:
    return load("documents").select(F.col("text").alias("value"))


def log_lines(load: Load) -> DataFrame:
    """Events as log lines of five fields; those of errors lack one."""
    event = [
        F.date_format(F.date_trunc("minute", F.col("ts").cast("timestamp")), "HH:mm:ss"),
        F.col("event_id").cast("string"),
        F.col("user_id").cast("string"),
    ]
    whole = F.concat_ws(
        ",", *event, F.col("event_type"), F.round("value").cast("bigint").cast("string")
    )
    return load("events").select(
        F.when(F.col("event_type") == "error", F.concat_ws(",", *event, F.lit("error")))
        .otherwise(whole)
        .alias("value")
    )


def folder_lines(load: Load) -> DataFrame:
    """Events as lines ``(key,count,latency)`` of hourly batches."""
    return load("events").select(
        F.format_string(
            "(%d,%d,%d)", F.col("user_id"), F.col("event_id"), F.round("value").cast("bigint")
        ).alias("value"),
        F.expr("(unix_micros(cast(ts as timestamp)) div 3600000000) * 3600000").alias("batch_ms"),
    )


def numbered(load: Load) -> DataFrame:
    """The events' numbers and times, as input of the generators."""
    return load("events").select(F.col("event_id").alias("seq"), "ts")
