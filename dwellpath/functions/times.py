"""Calendar helpers.  All of them read wall-clock epochs in a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(date: Column) -> Column:
    """Days since 1970-01-01, for range frames counted in calendar days."""
    return F.unix_date(F.to_date(date))


def full_hour(epoch: Column) -> Column:
    return F.hour(F.timestamp_seconds(epoch))


def sunday_weekday(epoch: Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(F.timestamp_seconds(epoch))


def monday_weekday(date: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(date)


def digest28(*parts: Column) -> Column:
    """A 28-bit number that depends only on the given values.

    Used where a random draw is wanted but task retries must repeat it.
    """
    text = F.concat_ws("|", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")
