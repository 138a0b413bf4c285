"""Event time as ``TIMESTAMP_NTZ`` in UTC, without using the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros_to_ntz(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def ntz_to_micros(ts: Column) -> Column:
    """Microseconds since 1970. A subtraction of wall-clock times: ``timestampdiff``
    would go through the session's zone and its daylight-saving gaps."""
    seconds = (ts - _epoch()).cast("decimal(18,6)")
    return (seconds * F.lit(1_000_000)).cast("bigint")


#: Seconds of the years 1 and 9999 that a timestamp can hold.
LEAST_SECONDS, MOST_SECONDS = -62_135_596_800, 253_402_300_799


def epoch_seconds_to_ntz(seconds: Column) -> Column:
    """Null where the seconds are no number or no time between the years 1 and 9999."""
    number = seconds.try_cast("double")
    usable = F.when(number.between(float(LEAST_SECONDS), float(MOST_SECONDS)), number)
    return micros_to_ntz(F.round(usable * F.lit(1e6)).cast("bigint"))


def as_utc_ntz(ts: Column, dtype: T.DataType) -> Column:
    """Bring a time column of any accepted type to the canonical type."""
    if isinstance(dtype, T.TimestampNTZType):
        return ts
    if isinstance(dtype, T.TimestampType):
        return micros_to_ntz(F.unix_micros(ts))
    if isinstance(dtype, T.DateType):
        return ts.cast("timestamp_ntz")
    if isinstance(dtype, T.NumericType):
        return epoch_seconds_to_ntz(ts)
    raise TypeError(f"cannot use a {dtype.simpleString()} column as event time")


def as_of_literal(as_of: object) -> Column:
    """Literal for an explicit 'now' (datetime, ISO text or a Column)."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def age_seconds(event_ts: Column, as_of: object) -> Column:
    """Seconds between a feature's event time and ``as_of``."""
    return (as_of_literal(as_of) - event_ts).cast("decimal(18,6)").cast("double")
