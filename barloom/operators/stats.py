"""Aggregates over series, sources and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.schema import SOURCE


def source_counts(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows per source and their share in percent."""
    counts = df.groupBy(*keys, SOURCE).agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))  # a row per source
    return counts.withColumn("pct", F.round(F.col("rows") / total * 100, 6))


def source_by_day(df: DataFrame, sources: tuple[str, ...], day: str = "day") -> DataFrame:
    return df.groupBy(day).pivot(SOURCE, list(sources)).agg(F.count(F.lit(1))).fillna(0, subset=list(sources))


def features(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("bars"), F.round(F.avg("close"), 6).alias("mean_close"), F.round(F.stddev_samp("close"), 6).alias("std_close"), F.round(F.sum("volume"), 6).alias("sum_volume"),
    )


def correlation(a: DataFrame, b: DataFrame, time: str = "open_us", column: str = "close") -> DataFrame:
    """Pearson's correlation of two series at common times, and their difference in percent of the first."""
    j = a.select(time, F.col(column).alias("x")).join(b.select(time, F.col(column).alias("y")), time)
    pct = F.abs((F.col("y") - F.col("x")) / F.when(F.col("x") != 0, F.col("x")) * 100)
    return j.agg(F.count("*").alias("bars"), F.round(F.corr("x", "y"), 6).alias("corr"), F.round(F.avg(pct), 6).alias("avg_pct"), F.round(F.max(pct), 6).alias("max_pct"))


def call_metrics(log: DataFrame, endpoint: str = "endpoint", ok: str = "ok", latency: str = "latency", order: str = "id", last: int = 100) -> DataFrame:
    """Per endpoint: calls, share of successes, and the mean latency of the last calls, which are picked before the shuffle."""
    recent = last_rows(log, endpoint, order, last).groupBy(endpoint).agg(F.round(F.avg(latency), 6).alias("recent_latency"))
    calls = log.groupBy(endpoint).agg(F.count("*").alias("calls"), F.round(F.avg(F.col(ok).cast("int")) * 100, 6).alias("success_pct"))
    return calls.join(recent, endpoint)


def last_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key: each task keeps its own last ``n`` before the shuffle."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__r") <= n).drop("__r")


def missing_time(ranges: DataFrame, total_us: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per key the seconds that ranges add up to, and their share of a total."""
    lost = F.sum(F.col("end_us") - F.col("start_us"))
    return ranges.groupBy(*keys).agg((lost / 1_000_000).alias("missing_s"), F.round(lost / total_us * 100, 6).alias("missing_pct"))


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), key)


def duplicate_count(df: DataFrame, keys: tuple[str, ...], time: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.count(time) - F.count_distinct(time)).alias("duplicates"))


def spans(df: DataFrame, keys: tuple[str, ...] = ("symbol",), time: str = "open_us") -> DataFrame:
    """Per key the first and last times and the rows."""
    return df.groupBy(*keys).agg(F.min(time).alias("earliest_us"), F.max(time).alias("latest_us"), F.count("*").alias("rows"))
