"""Checks of structure, prices, coverage and availability: counts and flags, computed where the data is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.intervals import SECOND
from barloom.operators.gaps import FEW_RANGES
from barloom.operators.runs import with_prev_of
from barloom.sources.scratch import cut

Keys = tuple[str, ...]


class ValidationError(ValueError):
    """Data or parameters that can't be used; ``details`` says which."""

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.details = details


def require_columns(df: DataFrame, columns: tuple[str, ...]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValidationError(f"columns are missing: {', '.join(missing)}", missing=missing)


def structure(df: DataFrame, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """Per key: rows, duplicate times, null times, and whether times are unique."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), (F.count(time) - F.count_distinct(time)).alias("duplicates"),
        F.count_if(F.col(time).isNull()).alias("null_times"), (F.count(time) == F.count_distinct(time)).alias("is_unique"),
    )


def monotonic(df: DataFrame, order: str, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """Per key whether time rises strictly in the order of a whole-numbered column; in buckets of the order, so that one key spreads over tasks."""
    rows = with_prev_of(df.select(*keys, order, time), keys, order, time)
    return rows.groupBy(*keys).agg(F.coalesce(F.bool_and(F.col(time) > F.col("__prev")), F.lit(True)).alias("is_monotonic"))


def reserved(columns: list[str], index: str = "open_time") -> list[str]:
    """The columns, none of which may be the one that holds the time."""
    if not all(isinstance(c, str) for c in columns):
        raise TypeError("names of columns are strings")
    if index in columns:
        raise ValidationError(f"{index} is the column of time", columns=columns)
    return columns


def kline_problems(df: DataFrame, keys: Keys = ("symbol",), required: Keys = ("open_us", "open", "high", "low", "close", "volume")) -> DataFrame:
    """Per key: rows, values of required columns that are null, NaN or no numbers, repeated times, and whether the bars are sound. Missing columns are an error."""
    require_columns(df, (*keys, *required))
    prices = [F.col(c).try_cast("double") for c in required[1:]]
    bad = sum((F.count_if(p.isNull() | F.isnan(p)) for p in prices[1:]), F.count_if(prices[0].isNull() | F.isnan(prices[0])))
    g = df.groupBy(*keys).agg(F.count("*").alias("rows"), bad.alias("bad_values"), (F.count(required[0]) - F.count_distinct(required[0])).alias("duplicates"))
    return g.withColumn("sound", (F.col("bad_values") == 0) & (F.col("duplicates") == 0))


def recent_coverage(df: DataFrame, ranges: DataFrame, now_us: int, keys: Keys = ("symbol",), time: str = "open_us", most_pct: float = 10.0, recent_us: int = 86_400 * SECOND) -> DataFrame:
    """Per key of ``ranges``: what is missing at head and tail in percent, and whether to warn: only of recent data, beyond ``most_pct``."""
    span = df.groupBy(*keys).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    zero = F.lit(0).cast("long")
    lost = F.greatest(F.col("__lo") - F.col("from_us"), zero) + F.greatest(F.col("to_us") - F.col("__hi"), zero)
    pct = F.round(lost / (F.col("to_us") - F.col("from_us")) * 100, 6)
    out = ranges.join(span, list(keys), "left").withColumn("missing_pct", F.coalesce(pct, F.lit(100.0)))
    recent = F.coalesce(F.lit(now_us) - F.col("__hi") <= recent_us, F.lit(False))
    return out.withColumn("warn", recent & (F.col("missing_pct") > most_pct)).drop("__lo", "__hi")


def cache_report(df: DataFrame, like: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """Per key of a cached table: structure, and whether it starts, ends and counts as another one does."""
    return structure(df, keys).join(boundaries_equal(df, like, keys), list(keys), "left").withColumn("equal", F.coalesce("equal", F.lit(False)))


def ohlc_violations(df: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """Per key how many bars break each rule of prices."""
    bad = lambda c: F.isnull(c) | F.isnan(c)
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("high") < F.greatest("open", "close", "low")).alias("bad_high"),
        F.count_if(F.col("low") > F.least("open", "close", "high")).alias("bad_low"),
        F.count_if(F.col("volume") < 0).alias("bad_volume"),
        F.count_if(F.col("open") <= 0).alias("bad_open"),
        F.count_if(bad(F.col("open")) | bad(F.col("high")) | bad(F.col("low")) | bad(F.col("close"))).alias("missing_prices"),
    )


def coverage(df: DataFrame, ranges: DataFrame, keys: Keys = ("symbol",), time: str = "open_us", tolerance_us: int = 1_000) -> DataFrame:
    """Per key of ``ranges`` (``from_us, to_us``): first, last, rows and whether they reach the range's ends."""
    span = df.groupBy(*keys).agg(F.min(time).alias("first_us"), F.max(time).alias("last_us"), F.count("*").alias("rows"))
    covered = (F.col("first_us") <= F.col("from_us") + tolerance_us) & (F.col("last_us") >= F.col("to_us") - tolerance_us)
    return ranges.join(span, list(keys), "left").withColumn("covered", F.coalesce(covered, F.lit(False))).withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def boundaries_equal(a: DataFrame, b: DataFrame, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """Per key whether two series start, end and count alike."""
    span = lambda d, p: d.groupBy(*keys).agg(F.min(time).alias(f"{p}_first"), F.max(time).alias(f"{p}_last"), F.count("*").alias(f"{p}_rows"))
    both = span(a, "a").join(span(b, "b"), list(keys), "full_outer")
    same = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in ("first", "last", "rows")]
    return both.select(*keys, (same[0] & same[1] & same[2]).alias("equal"))


def clamp(df: DataFrame, like: DataFrame, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """Rows of ``df`` between the first and last times of ``like``, per key; the spans, a row a key, are written and counted, and few of them go to all tasks, so that a long series stays where it is."""
    span = cut(like.groupBy(*keys).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi")))
    return df.join(F.broadcast(span) if span.count() <= FEW_RANGES else span, list(keys)).filter(F.col(time).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def funding_check(df: DataFrame, band: float = 0.1) -> DataFrame:
    """Per symbol: rows, rates beyond the band, and whether times are unique."""
    return df.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(F.abs("funding_rate") > band).alias("beyond_band"), (F.count("funding_time") == F.count_distinct("funding_time")).alias("is_unique"))


def close_time_off(open_us: Column, close: Column, step: int, tolerance_us: int = 100_000) -> Column:
    """Whether a close time isn't about one millisecond before the next bar."""
    return F.abs(close - open_us - (step - 1000)) > tolerance_us


def near_midnight(us: Column, step: int) -> Column:
    from barloom.functions.intervals import DAY

    r = F.pmod(us, F.lit(DAY))
    return (r < step) | (r > DAY - step)


def likely_available(end_us: Column, now_us: Column, step: int, delay_us: int | None = None) -> Column:
    """Whether bars until a time should be published: not the future, and past a delay, by default a fifth of an interval but 30 s at least."""
    wait = max(30 * SECOND, step // 5) if delay_us is None else delay_us
    return F.when(end_us > now_us, F.lit(False)).otherwise(end_us + wait <= now_us)


def is_fresh(day: Column, now_us: Column, hours: int = 48) -> Column:
    """Whether a day is too young for daily files."""
    return day > now_us - hours * 3600 * SECOND


def check_request(symbol: str, start_us: int, end_us: int, now_us: int, future: str = "error") -> tuple[int, int]:
    """The bounds of a request; a future end is an error, cut (``truncate``) or let be (``allow``)."""
    if not symbol:
        raise ValidationError("empty symbol")
    if start_us >= end_us:
        raise ValidationError("start isn't before end", start_us=start_us, end_us=end_us)
    if end_us > now_us and future == "error":
        raise ValidationError("the end is in the future", end_us=end_us)
    if start_us > now_us and future != "allow":
        raise ValidationError("the start is in the future", start_us=start_us)
    return start_us, min(end_us, now_us) if future == "truncate" else end_us


def request_problem(symbol: Column, start_us: Column, end_us: Column, now_us: int, future: str = "error") -> Column:
    """What is wrong with the requests of a table, by the rules of :func:`check_request`; null where nothing is."""
    now = F.lit(now_us)
    return (
        F.when(F.coalesce(symbol, F.lit("")) == "", "empty symbol")
        .when(start_us.isNull() | end_us.isNull() | (start_us >= end_us), "start isn't before end")
        .when((end_us > now) & F.lit(future == "error"), "the end is in the future")
        .when((start_us > now) & F.lit(future != "allow"), "the start is in the future")
    )
