"""Record schemas. Event times are ``timestamp``; batch tables may hold ``timestamp_ntz``."""

from pyspark.sql import types as T

PERSON = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("name", T.StringType()),
        T.StructField("state", T.StringType()),
    ]
)

AUCTION = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seller_id", T.LongType()),
        T.StructField("category", T.IntegerType()),
        T.StructField("expires", T.TimestampType()),
    ]
)

BID = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("auction_id", T.LongType()),
        T.StructField("price", T.LongType()),
    ]
)

TRADE = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("price", T.IntegerType()),
    ]
)

LINE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)

WORD_COUNT = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]
)

ITEM = T.StructType(
    [
        T.StructField("auction_id", T.LongType()),
        T.StructField("description", T.StringType()),
    ]
)

LATENCY_SAMPLE = T.StructType(
    [
        T.StructField("elapsed_ms", T.LongType()),
        T.StructField("latency_ms", T.LongType()),
    ]
)

KEY_VALUE_TEXT = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("value", T.StringType())]
)

KEY_VALUE_BINARY = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("value", T.BinaryType())]
)
