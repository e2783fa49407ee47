"""Which symbols exist where, since when, and what markets have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def availability(requests: DataFrame, listings: DataFrame, symbol: str = "symbol", at: str = "at_us", since: str = "earliest_us") -> DataFrame:
    """``requests`` with ``earliest_us`` and ``available``; unknown symbols are allowed."""
    joined = requests.join(listings.select(symbol, since), symbol, "left")
    return joined.withColumn("available", F.coalesce(F.col(at) >= F.col(since), F.lit(True)))


def counterpart(requests: DataFrame, first: DataFrame, second: DataFrame, key: str = "symbol", at: str = "at_us", since: str = "earliest_us") -> DataFrame:
    """The listing of the first market, of the second only if the first has none, and whether to warn."""
    a = first.select(key, F.col(since).alias("__a"))
    b = second.select(key, F.col(since).alias("__b"))
    out = requests.join(a, key, "left").join(b, key, "left")
    since_ = F.coalesce("__a", "__b")
    market = F.when(F.col("__a").isNotNull(), "first").when(F.col("__b").isNotNull(), "second").otherwise("none")
    return out.select(*requests.columns, market.alias("market"), since_.alias(since), F.coalesce(F.col(at) < since_, F.lit(False)).alias("warn"))


def common(frames: list[DataFrame], key: str = "base", multiset: bool = False) -> DataFrame:
    """Keys that all frames have; as a multiset, each as often as the frame that has it least often."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.intersectAll(f.select(key)) if multiset else out.intersect(f.select(key))
    return out


def restrict(df: DataFrame, keys: DataFrame, key: str = "base") -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def consolidate(frames: dict[str, DataFrame], key: str = "base", value: str = "symbol") -> DataFrame:
    """One row per key with each frame's first symbol: full outer joins of sides that are unique by key."""
    out = None
    for name, f in frames.items():
        side = f.groupBy(key).agg(F.min(value).alias(f"{name}_{value}"))
        out = side if out is None else out.join(side, key, "full_outer")
    return out


def listing_status(days: DataFrame, cutoff: Column, key: str = "symbol", day: str = "day") -> DataFrame:
    """``earliest`` per symbol and ``ACTIVE``, or ``NO_RECENT_DATA`` where no day is after the cutoff."""
    g = days.groupBy(key).agg(F.min(day).alias("earliest"), F.max(day).alias("latest"))
    return g.withColumn("status", F.when(F.col("latest") > cutoff, "ACTIVE").otherwise("NO_RECENT_DATA"))


def interval_lists(df: DataFrame, key: str = "symbol", interval: str = "interval") -> DataFrame:
    return df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(interval)), ",").alias("intervals"))


def with_suffix(df: DataFrame, suffixes: tuple[str, ...], symbol: str = "symbol") -> DataFrame:
    return df.filter(F.col(symbol).rlike(f"({'|'.join(suffixes)})$"))


def first_rows(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def union_of_keys(frames: dict[str, DataFrame], key: str = "base") -> DataFrame:
    """Each key of any frame once, and the names of the frames that have it, sorted and comma-joined."""
    every = None
    for name, f in frames.items():
        one = f.select(key).distinct().withColumn("frame", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("frame")), ",").alias("frames"))  # a row a frame


def common_times(frames: list[DataFrame], keys: tuple[str, ...] = ("symbol",), time: str = "open_us") -> DataFrame:
    """Times at which all frames have a bar of the key."""
    out = frames[0].select(*keys, time)
    for f in frames[1:]:
        out = out.intersect(f.select(*keys, time))
    return out
