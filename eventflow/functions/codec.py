"""Trades as 21-byte messages: ticker (5, blank-padded), time, price, quantity, big-endian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.functions.timing import epoch_millis

# Fixed values of the message layout.
TICKER_BYTES = 5
TIME_BYTES = 8
INT_BYTES = 4
PADDING = " "


def encode_trade(df: DataFrame) -> DataFrame:
    """Trade columns to ``key`` (time in ms) and ``value`` (the message)."""
    millis = epoch_millis(df, "time")
    ticker = F.when(
        F.length("ticker") > TICKER_BYTES,
        F.raise_error(
            F.concat(F.lit("ticker is longer than 5 letters: "), F.col("ticker"))
        ),
    ).otherwise(F.rpad("ticker", TICKER_BYTES, PADDING))
    value = F.concat(
        F.encode(ticker, "US-ASCII"),
        _bytes(millis, TIME_BYTES),
        _bytes(F.col("price"), INT_BYTES),
        _bytes(F.col("quantity"), INT_BYTES),
    )
    return df.select(millis.alias("key"), value.alias("value"))


def decode_trade(df: DataFrame, value: str = "value") -> DataFrame:
    """Messages to ``time``, ``ticker``, ``quantity``, ``price``; other columns are dropped."""
    blob = F.col(value)
    after_ticker = TICKER_BYTES + 1
    after_time = after_ticker + TIME_BYTES
    after_price = after_time + INT_BYTES
    text = F.decode(F.substring(blob, 1, TICKER_BYTES), "US-ASCII")
    return df.select(
        F.timestamp_millis(_long(blob, after_ticker)).alias("time"),
        F.substring_index(text, PADDING, 1).alias("ticker"),
        _int(blob, after_price).alias("quantity"),
        _int(blob, after_time).alias("price"),
    )


def _bytes(number: Column, width: int) -> Column:
    """Two's complement, big-endian. hex of a negative bigint shows all 16 digits."""
    whole, most = number.cast("bigint"), 1 << (8 * width - 1)
    if width < 8:
        whole = F.when(whole.isNull() | whole.between(-most, most - 1), whole).otherwise(
            F.raise_error(F.lit(f"a number does not fit {width} bytes"))
        )
    digits = F.hex(whole)
    return F.unhex(F.substring(F.lpad(digits, 16, "0"), 17 - 2 * width, 2 * width))


def _long(blob: Column, start: int) -> Column:
    return F.conv(F.hex(F.substring(blob, start, TIME_BYTES)), 16, -10).cast("bigint")


def _int(blob: Column, start: int) -> Column:
    unsigned = F.conv(F.hex(F.substring(blob, start, INT_BYTES)), 16, 10).cast("bigint")
    half = 1 << 31
    return (F.pmod(unsigned + half, F.lit(1 << 32)) - half).cast("int")
