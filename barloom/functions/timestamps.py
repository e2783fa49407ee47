"""Epoch units, precision and comparison of time stamps, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(epoch: Column) -> Column:
    return F.length(F.abs(epoch.cast("long")).cast("string"))


def epoch_unit(epoch: Column) -> Column:
    """``ms`` for 13 digits, ``us`` for 16, else null: told row by row, so files may mix units."""
    return F.when(digits(epoch) == 13, "ms").when(digits(epoch) == 16, "us")


def epoch_us(epoch: Column) -> Column:
    """Microseconds of an epoch in milliseconds or microseconds; null where the unit can't be told."""
    e = epoch.cast("long")
    return F.when(digits(e) == 13, e * 1000).when(digits(e) == 16, e)


def epoch_us_or(epoch: Column, fallback: Column) -> Column:
    return F.coalesce(epoch_us(epoch), fallback)


def to_millis(us: Column) -> Column:
    """Precision cut to milliseconds."""
    return us - F.pmod(us, F.lit(1000).cast("long"))


def parse_time(text: Column) -> Column:
    """ISO or ``YYYY-MM-DD[ HH:MM:SS]``; null for others."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def compare_times(a: Column, b: Column) -> Column:
    """-1, 0 or 1; numbers above 1e11 are milliseconds, others seconds."""
    seconds = lambda x: F.when(F.abs(x) > 1e11, x / 1000).otherwise(x.cast("double"))
    return F.signum(seconds(a) - seconds(b)).cast("int")
