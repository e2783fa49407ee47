"""Bars from ticks, and longer bars from shorter ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.intervals import floor_us, interval_us, micros


def moment(us: Column, order: Column) -> Column:
    """Time and a long as one number that sorts like the two: a fixed-width value, so that hashed aggregation can hold it.

    A struct would do the same, but its buffer can't be updated in place, and Spark would sort all ticks.
    """
    shifted = order.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    high = us.cast("decimal(17,0)") * F.lit(str(10**20)).cast("decimal(21,0)")
    return (high + F.coalesce(shifted, F.lit(0).cast("decimal(20,0)"))).cast("decimal(38,0)")


def from_ticks(ticks: DataFrame, interval: str, keys: tuple[str, ...] = ("symbol",), price: str = "price", size: str = "price", time: str = "ts", order: str = "id") -> DataFrame:
    """``keys, open_us`` and OHLCV bars of ticks; ties in time go by ``order``. One shuffle, pre-aggregated."""
    us = micros(F.col(time))
    return (
        ticks.withColumn("open_us", floor_us(us, interval_us(interval)))
        .withColumn("__at", moment(us, F.col(order)))
        .groupBy(*keys, "open_us")
        .agg(
            F.min_by(price, "__at").alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, "__at").alias("close"),
            F.sum(size).alias("volume"),
            F.count("*").alias("trades"),
        )
    )


def roll_up(bars: DataFrame, interval: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Longer bars of bars with ``open_us``."""
    return (
        bars.withColumn("__us", floor_us(F.col("open_us"), interval_us(interval)))
        .groupBy(*keys, F.col("__us").alias("open_us"))
        .agg(
            F.min_by("open", "open_us").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "open_us").alias("close"), F.sum("volume").alias("volume"), F.sum("trades").alias("trades"),
        )
    )
