"""Value functions: sequence randomness, tickers, labels, comma-separated fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Mix = Callable[[Column], Column]

# Multiplier and modulus of the "minimal standard" generator.
_LEHMER_MULTIPLIER = 48271
_LEHMER_MODULUS = 2147483647


def hash_mix(seq: Column) -> Column:
    """64-bit hash of a sequence number: the default, free of visible patterns."""
    return F.xxhash64(seq)


def lehmer_mix(seq: Column) -> Column:
    """A mixing function of plain integer arithmetic, the same in any SQL engine."""
    return (F.pmod(seq, F.lit(_LEHMER_MODULUS)) * _LEHMER_MULTIPLIER) % _LEHMER_MODULUS


def seq_random(seq: Column, limit: int | Column, mix: Mix = hash_mix) -> Column:
    """A number in ``[0, limit)`` that depends on the sequence number alone.

    Multiply ``seq`` by a factor to get an independent series from the same numbers.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.pmod(mix(seq), limit.cast("bigint"))


def ticker_of(number: Column, letters: int) -> Column:
    """Base-26 letters of a number, least significant first: 0 is AAA, 1 is BAA."""
    digits = [
        F.char(F.pmod(F.floor(number / F.lit(26**i)), F.lit(26)) + 65) for i in range(letters)
    ]
    return F.concat(*digits)


def letters_for(keys: int, most: int = 5) -> int:
    """Letters a ticker needs so that there are at least ``keys`` of them."""
    letters = 1
    while 26**letters < keys:
        letters += 1
    if letters > most:
        raise ValueError(f"at most {26**most} tickers of {most} letters")
    return letters


def has_suffix(value: Column, suffix: str) -> Column:
    return value.endswith(suffix)


def item_label(number: Column) -> Column:
    return F.format_string("Auctioned Item #%05d", number)


def seller_name(number: Column) -> Column:
    return F.concat(F.lit("Seller #"), number.cast("string"))


def grouped_digits(number: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(number, 0)


def comma_fields(line: Column) -> Column:
    """Fields between commas; empty fields at the end of the line do not count."""
    return F.split(F.regexp_replace(line, ",+$", ""), ",")


def whole_number(text: Column) -> Column:
    return text.try_cast("bigint")


def without_last_char(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - 1)
