"""Column functions on event times.  "Now" is always a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP; text that is no time gives null.

    A full date is asked for: a cast alone would read "2026" or "10:00" too.
    """
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def as_timestamp(value: Column | datetime | str) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3600 * 1_000_000)


def slice_of(ts: Column, seconds: int) -> Column:
    """Start, in microseconds, of the fixed interval that holds ts."""
    micros = F.unix_micros(ts)
    return micros - F.pmod(micros, F.lit(seconds * 1_000_000))


def bucket_start(ts: Column, seconds: int) -> Column:
    return F.timestamp_micros(slice_of(ts, seconds))


def retained(ts: Column, now, days: int) -> Column:
    """Row is younger than the retention time of a log."""
    return ts >= as_timestamp(now) - F.make_dt_interval(days=F.lit(days))


def retained_day(day: Column, now, days: int) -> Column:
    """The same on a date partition: true for days that may hold younger rows."""
    return day >= F.to_date(as_timestamp(now) - F.make_dt_interval(days=F.lit(days)))
