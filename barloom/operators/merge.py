"""Merging overlapping sources of the same series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.schema import SOURCE, with_source

#: Which source wins where several have a bar.
PRIORITY = {"UNKNOWN": 0, "VISION": 1, "CACHE": 2, "REST": 3, "STREAMING": 4}


def priority(source: Column) -> Column:
    """Sources that aren't known, and null, count as UNKNOWN."""
    out = F.lit(0)
    for name, p in PRIORITY.items():
        out = F.when(source == name, p).otherwise(out)
    return out


def diagonal_union(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def priority_merge(frames: list[DataFrame], keys: tuple[str, ...] = ("symbol",), time: str = "open_us", seq: str | None = None) -> DataFrame:
    """One row per key and time: of the source with the highest priority; among equals the later frame's, then the larger ``seq``.

    A single frame is merged alike. Rows without a source are UNKNOWN. One shuffle on key and time; no
    group is larger than the rows of one bar.
    """
    tagged = [(f if SOURCE in f.columns else with_source(f, "UNKNOWN")).withColumn("__frame", F.lit(i)) for i, f in enumerate(frames)]
    every = diagonal_union(tagged).withColumn(SOURCE, F.coalesce(SOURCE, F.lit("UNKNOWN")))
    order = [F.desc(priority(F.col(SOURCE))), F.desc("__frame"), *([F.desc(seq)] if seq else [])]
    best = every.withColumn("__rank", F.row_number().over(W.partitionBy(*keys, time).orderBy(*order)))
    return best.filter("__rank = 1").drop("__rank", "__frame")


def priority_merge_by_max(frames: list[DataFrame], keys: tuple[str, ...] = ("symbol",), time: str = "open_us") -> DataFrame:
    """The same by ``max_by``: pre-aggregated before the shuffle, so better where sources overlap much."""
    tagged = [(f if SOURCE in f.columns else with_source(f, "UNKNOWN")).withColumn("__frame", F.lit(i)) for i, f in enumerate(frames)]
    every = diagonal_union(tagged).withColumn(SOURCE, F.coalesce(SOURCE, F.lit("UNKNOWN")))
    rest = [c for c in every.columns if c not in (*keys, time, "__frame")]
    best = F.max_by(F.struct(*rest), F.struct(priority(F.col(SOURCE)), F.col("__frame"))).alias("__best")
    return every.groupBy(*keys, time).agg(best).select(*keys, time, "__best.*")


def keep_first(df: DataFrame, keys: tuple[str, ...], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated order (``dropDuplicates`` would keep any)."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def boundary_fill(bulk: DataFrame, extra: DataFrame, gaps: DataFrame, step: int, keys: tuple[str, ...] = ("symbol",), time: str = "open_us") -> DataFrame:
    """``bulk`` and those rows of ``extra`` within half an interval of a gap that touches midnight; where both have a bar, bulk wins.

    Gaps (``start_us, end_us``) are matched by key and day, not by an inequality alone.
    """
    from barloom.functions.intervals import DAY, day_us

    near = gaps.filter((F.pmod("start_us", F.lit(DAY)) == 0) | (F.pmod("end_us", F.lit(DAY)) == 0)).select(*keys, (F.col("start_us") - step // 2).alias("__from"), (F.col("end_us") + step // 2).alias("__to"))
    days = F.sequence(day_us(F.col("__from")), day_us(F.col("__to")), F.lit(DAY))
    near = near.withColumn("__day", F.explode(days))
    wanted = extra.withColumn("__day", day_us(F.col(time))).join(near, [*keys, "__day"]).filter((F.col(time) >= F.col("__from")) & (F.col(time) <= F.col("__to"))).select(*extra.columns)
    every = diagonal_union([bulk.withColumn("__first", F.lit(0)), wanted.withColumn("__first", F.lit(1))])
    return keep_first(every, (*keys, time), ["__first"]).drop("__first")
