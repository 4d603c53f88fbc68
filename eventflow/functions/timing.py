"""Event-time arithmetic on Spark columns."""

from __future__ import annotations

import re
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.session import is_utc

_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}

Duration = str | timedelta


# Number and unit, as often as wanted, and nothing else.
_PART = re.compile(r"(\d+(?:\.\d+)?)\s*([a-zA-Z]+)")
_DURATION = re.compile(rf"\s*{_PART.pattern}(?:\s+{_PART.pattern})*\s*")


def _unit_micros(name: str) -> int | None:
    return _UNIT_MICROS.get(name) or _UNIT_MICROS.get(name.removesuffix("s"))


def micros_of(duration: Duration) -> int:
    """Length of ``'10 seconds'``, ``'1 day 12 hours'`` or a timedelta in microseconds."""
    if isinstance(duration, timedelta):
        total = duration // timedelta(microseconds=1)
    else:
        if not _DURATION.fullmatch(duration):
            raise ValueError(f"not a duration: {duration!r}")
        total = 0
        for number, name in _PART.findall(duration):
            unit = _unit_micros(name.lower())
            exact = Decimal(number) * unit if unit else None
            if exact is None or exact != int(exact):
                raise ValueError(f"not a duration in whole microseconds: {duration!r}")
            total += int(exact)
    return total


def as_interval(duration: Duration) -> str:
    return f"{micros_of(duration)} microseconds"


def epoch_micros_text(df: DataFrame, name: str) -> str:
    """SQL for microseconds since 1970 of a timestamp column with or without zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType) and not is_utc(df.sparkSession):
        raise ValueError("set spark.sql.session.timeZone to UTC to read zone-less times")
    return f"unix_micros(cast(`{name}` as timestamp))"


def epoch_micros(df: DataFrame, name: str) -> Column:
    return F.expr(epoch_micros_text(df, name))


def epoch_millis(df: DataFrame, name: str) -> Column:
    return F.expr(f"{epoch_micros_text(df, name)} div 1000")


def time_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def from_epoch_micros(micros: Column, type_name: str) -> Column:
    return F.timestamp_micros(micros).cast(type_name)


def floor_to_grid(value: Column, grid: int, offset: int = 0) -> Column:
    """Largest multiple of ``grid`` not above a non-negative value, plus ``offset``."""
    return value - F.pmod(value, F.lit(grid)) + F.lit(offset)


# Fixed value: reports show the time of day within a cycle of three hours.
CYCLE_MILLIS = 3 * 60 * 60 * 1000


def time_in_cycle(millis: Column, cycle: int = CYCLE_MILLIS) -> Column:
    return F.pmod(millis, F.lit(cycle))


def time_on_day(day: str, time: Column) -> Column:
    """A local time such as ``10:15:30.123`` on a given day; null if unreadable."""
    return F.try_to_timestamp(F.concat_ws(" ", F.lit(day), time))


def clock_time(millis: Column, pattern: str = "HH:mm:ss.SSS") -> Column:
    """Epoch milliseconds as a local time in the session zone."""
    return F.date_format(F.timestamp_millis(millis), pattern)


def date_and_time(millis: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSS") -> Column:
    return clock_time(millis, pattern)
