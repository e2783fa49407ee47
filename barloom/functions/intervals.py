"""Intervals as integer microseconds, and time as integer microseconds since 1970, in UTC.

All arithmetic is on longs, so that it stays in generated code and agrees with any SQL engine; time
stamps appear at the edges only. The session's time zone must be UTC (:func:`ensure_utc`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND
#: Interval names and their lengths in seconds; a month is 30 days.
INTERVAL_SECONDS = {
    "1s": 1, "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1_800, "1h": 3_600, "2h": 7_200, "4h": 14_400,
    "6h": 21_600, "8h": 28_800, "12h": 43_200, "1d": 86_400, "3d": 259_200, "1w": 604_800, "1M": 2_592_000,
}


class IntervalError(ValueError):
    """An interval that isn't known."""


def ensure_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def parse_interval(name: str, default: str | None = None) -> str:
    """The interval of a value (``1h``) or of a long name (``HOUR_1``)."""
    if name in INTERVAL_SECONDS:
        return name
    units = {"SECOND": "s", "MINUTE": "m", "HOUR": "h", "DAY": "d", "WEEK": "w", "MONTH": "M"}
    unit, _, n = name.upper().partition("_")
    if unit in units and f"{n}{units[unit]}" in INTERVAL_SECONDS:
        return f"{n}{units[unit]}"
    if default is not None:
        return default
    raise IntervalError(f"unknown interval: {name}")


def interval_us(name: str) -> int:
    return INTERVAL_SECONDS[parse_interval(name)] * SECOND


def interval_us_of(name: Column) -> Column:
    """The length of an interval in a column; null for unknown names."""
    return F.create_map(*[F.lit(x) for k, v in INTERVAL_SECONDS.items() for x in (k, v * SECOND)])[name]


def parsed_interval(name: Column, default: str | None = None) -> Column:
    """The interval of values (``1h``) and long names (``HOUR_1``, in any case) in a column; the default, or null, for others."""
    units = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "M": "MONTH"}
    long = F.create_map(*[F.lit(x) for k in INTERVAL_SECONDS for x in (f"{units[k[-1]]}_{k[:-1]}", k)])
    return F.coalesce(F.when(name.isin(*INTERVAL_SECONDS), name), long[F.upper(name)], F.lit(default).cast("string"))


def smaller_of(name: Column) -> Column:
    """The intervals shorter than that of a column, shortest first; null for unknown names."""
    return F.create_map(*[x for k in INTERVAL_SECONDS for x in (F.lit(k), F.array(*map(F.lit, smaller_intervals(k))).cast("array<string>"))])[name]


def rows_per_day_of(name: Column) -> Column:
    """Rows of a complete day; 0 for unknown intervals and for those longer than a day."""
    return F.coalesce(F.create_map(*[F.lit(x) for k in INTERVAL_SECONDS for x in (k, expected_rows_per_day(k))])[name], F.lit(0))


def smaller_intervals(name: str) -> list[str]:
    return [k for k, v in INTERVAL_SECONDS.items() if v < INTERVAL_SECONDS[parse_interval(name)]]


def expected_rows_per_day(name: str) -> int:
    """Rows of a complete day; 0 for unknown intervals and for those longer than a day."""
    return 86_400 // INTERVAL_SECONDS[name] if name in INTERVAL_SECONDS else 0


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a time stamp with or without zone."""
    return F.unix_micros(t.cast("timestamp"))


def ntz(us: Column) -> Column:
    """The time stamp without zone of microseconds since 1970."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_us(us: Column, step: int | Column) -> Column:
    """The start of the interval that holds a time: modular since 1970, so weeks start on Thursday."""
    return us - F.pmod(us, F.lit(step).cast("long") if isinstance(step, int) else step)


def ceil_us(us: Column, step: int) -> Column:
    low = floor_us(us, step)
    return F.when(low == us, us).otherwise(low + step)


def align_us(start: Column, end: Column, step: int) -> tuple[Column, Column]:
    """Both bounds floored; the range keeps at least one interval."""
    low = floor_us(start, step)
    return low, F.greatest(floor_us(end, step), low + step)


def close_us(open_us: Column, step: int) -> Column:
    """The last microsecond of a bar."""
    return open_us + step - 1


def is_complete(open_us: Column, step: int, now_us: Column) -> Column:
    return now_us >= open_us + step


def estimated_records(start: Column, end: Column, step: int, now_us: Column) -> Column:
    """Bars of a range, both ends counted, its end no later than now; none for a future start."""
    last = F.least(end, now_us)
    return F.when(start > now_us, F.lit(0).cast("long")).otherwise(F.floor((last - start) / step).cast("long") + 1)


def chunks(ranges: DataFrame, step: int, per_chunk: int = 1_000) -> DataFrame:
    """``ranges`` with ``start_us, end_us`` cut into pieces ``chunk, chunk_start_us, chunk_end_us`` of at most ``per_chunk`` bars, however many."""
    size = step * per_chunk
    starts = F.sequence(F.col("start_us"), F.greatest(F.col("start_us"), F.col("end_us") - 1), F.lit(size))
    cut = ranges.filter("end_us > start_us").select("*", F.posexplode(starts).alias("chunk", "chunk_start_us"))
    return cut.withColumn("chunk_end_us", F.least(F.col("chunk_start_us") + size, F.col("end_us")))


def day_us(us: Column) -> Column:
    return floor_us(us, DAY)


def full_days(start: Column, end: Column) -> tuple[Column, Column]:
    """From midnight to the last microsecond of the end's day."""
    return day_us(start), day_us(end) + (DAY - 1)


@dataclass(frozen=True)
class TimeRange:
    """A half-open range in microseconds since 1970."""

    start_us: int
    end_us: int

    def __post_init__(self) -> None:
        if self.start_us >= self.end_us:
            raise ValueError("a range must start before it ends")


def resolve_range(start_us: int | None, end_us: int | None, days: int | None, now_us: int, step: int | None = None) -> TimeRange:
    """The range of any two of start, end and days (three by default), counted from the one that is given, else back from now.

    With ``step`` both bounds are floored, and one interval is kept at least.
    """
    span = (3 if days is None else days) * DAY
    if start_us is None:
        end_us = now_us if end_us is None else end_us
        start_us = end_us - span
    elif end_us is None:
        end_us = start_us + span
    r = TimeRange(start_us, end_us)
    if step is None:
        return r
    low = start_us - start_us % step
    return TimeRange(low, max(end_us - end_us % step, low + step))


def resolved(requests: DataFrame, now_us: int, step: int, days: int = 3) -> DataFrame:
    """The same for a table of requests ``start_us, end_us`` (either may be null), as columns ``from_us, to_us``; rows that end before they start have nulls."""
    s, e = F.col("start_us"), F.col("end_us")
    end = F.coalesce(e, s + days * DAY, F.lit(now_us))
    start = F.coalesce(s, end - days * DAY)
    low, high = align_us(start, end, step)
    return requests.withColumn("from_us", F.when(start < end, low)).withColumn("to_us", F.when(start < end, high))


def describe_range(r: TimeRange, start_given: bool, end_given: bool, days: int = 3) -> str:
    """How a range came about, for people."""
    import datetime as dt

    start, end = (dt.datetime.fromtimestamp(x // SECOND, dt.UTC).strftime("%Y-%m-%d") for x in (r.start_us, r.end_us))
    if start_given and end_given:
        return f"from {start} to {end}, as given"
    if end_given:
        return f"{days} days back from {end}"
    return f"{days} days on from {start}" if start_given else f"{days} days back from now"


#: Units of free intervals and their lengths in seconds.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3_600, "d": 86_400, "w": 604_800, "M": 2_592_000, "y": 31_536_000}


def free_interval_us(name: str) -> int:
    """The length of any interval of 1 to 1,000 units, not only of those that markets have."""
    n, unit = name[:-1], name[-1:]
    if not n.isdecimal() or unit not in UNIT_SECONDS or not 1 <= int(n) <= 1_000:
        raise IntervalError(f"not an interval: {name}")
    return int(n) * UNIT_SECONDS[unit] * SECOND


def free_us_of(name: Column) -> Column:
    """The length of any interval of 1 to 1,000 units in a column; null for other texts."""
    n = F.regexp_extract(name, "^([0-9]{1,4})([smhdwMy])$", 1).try_cast("int")
    unit = F.create_map(*[F.lit(x) for k, v in UNIT_SECONDS.items() for x in (k, v * SECOND)])[F.regexp_extract(name, "^([0-9]{1,4})([smhdwMy])$", 2)]
    return F.when(n.between(1, 1_000), n * unit)


def described(start_us: Column, end_us: Column, from_us: Column, to_us: Column, days: int = 3) -> Column:
    """How the ranges of :func:`resolved` came about, for people: from what was given and what it came to; null where there is no range."""
    day = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")
    ago = F.concat(F.lit(f"{days} days back from "), day(to_us))
    return (
        F.when(from_us.isNull(), F.lit(None).cast("string"))
        .when(start_us.isNotNull() & end_us.isNotNull(), F.concat(F.lit("from "), day(from_us), F.lit(" to "), day(to_us), F.lit(", as given")))
        .when(end_us.isNotNull(), ago)
        .when(start_us.isNotNull(), F.concat(F.lit(f"{days} days on from "), day(from_us)))
        .otherwise(F.lit(f"{days} days back from now"))
    )
