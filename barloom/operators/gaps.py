"""Gaps in series, ranges of missing time and their coalescing.

Windows run in buckets of a series (:mod:`barloom.operators.runs`), so neither many symbols nor one long
series end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.intervals import DAY, day_us
from barloom.operators.runs import with_next, with_prev, with_running
from barloom.sources.scratch import cut

Keys = tuple[str, ...]
#: How many intervals beyond one a step may take within a day and across midnight.
REPORT = (0.3, 1.5)
PLAN = (0.3, 1.0)
STRICT = (0.1, 1.0)
#: Ranges that are sent to all tasks (one a key), or that a key's one window takes.
FEW_RANGES = 10_000


def _limit(a: Column, b: Column, step: int, thresholds: tuple[float, float]) -> Column:
    within, across = (int(step * (1 + t)) for t in thresholds)
    return F.when(day_us(a) == day_us(b), F.lit(within)).otherwise(F.lit(across))


def detect(df: DataFrame, step: int, thresholds: tuple[float, float] = REPORT, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """``keys, start_us, end_us, duration_us, missing_points, crosses_day``: steps longer than the threshold.

    A gap lasts from the bar before to the bar after it. With a threshold of 1 or more across midnight, a
    single bar missing there is no gap; :func:`missing_islands` tells it all the same.
    """
    steps = with_next(df.select(*keys, time), step, keys, time).select(*keys, F.col(time).alias("start_us"), F.col("__next").alias("end_us"))
    long = steps.filter(F.col("end_us") - F.col("start_us") > _limit(F.col("start_us"), F.col("end_us"), step, thresholds))
    diff = F.col("end_us") - F.col("start_us")
    return long.select(
        *keys, "start_us", "end_us", (diff - step).alias("duration_us"), (F.floor(diff / step) - 1).cast("long").alias("missing_points"),
        (day_us(F.col("start_us")) != day_us(F.col("end_us"))).alias("crosses_day"),
    )


def statistics(gaps: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    return gaps.groupBy(*keys).agg(
        F.count("*").alias("gaps"), F.count_if("crosses_day").alias("boundary_gaps"), F.count_if(~F.col("crosses_day")).alias("other_gaps"),
        F.max("duration_us").alias("max_duration_us"), F.sum("missing_points").alias("missing_points"),
    )


def largest(gaps: DataFrame, n: int, keys: Keys = ("symbol",)) -> DataFrame:
    """The ``n`` longest gaps; ties go by key and start."""
    return gaps.orderBy(F.desc("duration_us"), *keys, "start_us").limit(n)


def coalesce_ranges(ranges: DataFrame, step: int, keys: Keys = ("symbol",), few: int = FEW_RANGES) -> DataFrame:
    """``keys, start_us, end_us``: ranges merged where the next starts no later than two intervals after the ones before end.

    The ranges are written once and counted. Few of them are one plain window a key; of many, a key's ranges run in
    buckets of time, so that one key spreads over tasks.
    """
    order = ["start_us", "end_us"]
    held = cut(ranges.select(*keys, *order))
    if held.count() <= few:
        w = W.partitionBy(*keys).orderBy(*order)
        marked = held.withColumn("__reach", F.max("end_us").over(w.rowsBetween(W.unboundedPreceding, -1)))
        new = (F.col("__reach").isNull() | (F.col("start_us") > F.col("__reach") + 2 * step)).cast("int")
        islands = marked.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    else:
        marked = with_running(held, step, keys, "start_us", order, "__reach", F.col("end_us"), "max", inclusive=False)
        new = (F.col("__reach").isNull() | (F.col("start_us") > F.col("__reach") + 2 * step)).cast("int")
        marked = cut(marked.select(*keys, *order, new.alias("__new")))
        islands = with_running(marked, step, keys, "start_us", order, "__island", F.col("__new"), "sum")
    return islands.groupBy(*keys, "__island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("__island")


def within(df: DataFrame, ranges: DataFrame, keys: Keys = ("symbol",), at: str = "open_us", start: str = "from_us", end: str = "to_us") -> DataFrame:
    """Rows in any of the half-open ranges of their key, as often as they are in one; matched by key and day, so a series isn't compared with all of its ranges."""
    days = F.sequence(day_us(F.col(start)), day_us(F.greatest(start, F.col(end) - 1)), F.lit(DAY))
    by_day = ranges.filter(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("__from"), F.col(end).alias("__to"), F.explode(days).alias("__day"))
    near = df.withColumn("__day", day_us(F.col(at))).join(by_day, [*keys, "__day"])
    return near.filter((F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__to"))).select(*df.columns)


def missing_segments(df: DataFrame, wanted: DataFrame, step: int, thresholds: tuple[float, float] = PLAN, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """What is missing of the ranges ``wanted`` (one ``from_us, to_us`` a key): before, between and after the bars, coalesced.

    A key without bars misses its whole range. Bars and ranges are matched by key and day, so that a long
    series is not joined on its key alone.
    """
    bounds = wanted.select(*keys, "from_us", "to_us")
    bars = within(df.select(*keys, F.col(time).alias("__t")), bounds, keys, "__t")
    ends = bounds.select(*keys, F.explode(F.array(F.col("from_us") - step, F.col("to_us"))).alias("__t"))  # a bar before the range and one at its end
    every = bars.select(*keys, "__t", F.lit(False).alias("__end")).unionByName(ends.withColumn("__end", F.lit(True)))
    steps = with_next(every, step, keys, "__t", ("__end",)).select(*keys, F.col("__t").alias("__a"), F.col("__next").alias("__b"), (F.col("__end") | F.col("__next___end")).alias("__at_end"))
    limit = F.when(F.col("__at_end"), F.lit(step)).otherwise(_limit(F.col("__a"), F.col("__b"), step, thresholds))
    missing = steps.filter(F.col("__b") - F.col("__a") > limit).select(*keys, (F.col("__a") + step).alias("start_us"), F.col("__b").alias("end_us"))
    return coalesce_ranges(missing, step, keys)


def grid(ranges: DataFrame, step: int, time: str = "open_us") -> DataFrame:
    """Every bar's time of half-open ranges ``from_us, to_us``; a day at a time, so that no array is long."""
    chunk = max(DAY, step)
    starts = F.sequence(F.col("from_us"), F.greatest(F.col("from_us"), F.col("to_us") - 1), F.lit(chunk - chunk % step))
    days = ranges.filter("to_us > from_us").withColumn("__s", F.explode(starts))
    end = F.least(F.col("__s") + (chunk - chunk % step), F.col("to_us")) - 1
    return days.withColumn(time, F.explode(F.sequence(F.col("__s"), F.greatest(F.col("__s"), end), F.lit(step)))).drop("__s", "from_us", "to_us")


def missing_times(df: DataFrame, ranges: DataFrame, step: int, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    return grid(ranges, step, time).join(df.select(*keys, time).distinct(), [*keys, time], "left_anti")


def missing_islands(df: DataFrame, ranges: DataFrame, step: int, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """``keys, start_us, end_us, missing``: runs of missing bars of half-open ranges (one a key), from the first to the end of the last.

    Told by arithmetic from each bar to the next one and to the range's ends, so time without bars costs nothing:
    no row is made for a bar that might be. Bars off the range's steps don't count.
    """
    bounds = ranges.filter("to_us > from_us").select(*keys, F.col("from_us").alias("__from"), (F.col("from_us") + F.ceil((F.col("to_us") - F.col("from_us")) / step) * step).alias("__to"))
    bars = df.select(*keys, F.col(time).alias("__t"))
    if bounds.count() <= FEW_RANGES:
        near = bars.join(F.broadcast(bounds), list(keys))
    else:
        day = F.sequence(day_us(F.col("__from")), day_us(F.col("__to") - 1), F.lit(DAY))
        near = bars.withColumn("__day", day_us(F.col("__t"))).join(bounds.withColumn("__day", F.explode(day)), [*keys, "__day"])
    on_step = (F.col("__t") >= F.col("__from")) & (F.col("__t") < F.col("__to")) & (F.pmod(F.col("__t") - F.col("__from"), F.lit(step)) == 0)
    ends = bounds.select(*keys, (F.col("__from") - step).alias("__t")).unionByName(bounds.select(*keys, F.col("__to").alias("__t")))
    steps = with_next(near.filter(on_step).select(*keys, "__t").unionByName(ends), step, keys, "__t")
    missing = steps.filter(F.col("__next") - F.col("__t") > step)
    return missing.select(*keys, (F.col("__t") + step).alias("start_us"), F.col("__next").alias("end_us"), ((F.col("__next") - F.col("__t")) / step - 1).cast("long").alias("missing"))


def stream_gaps(df: DataFrame, step: int, most: int = 1_440, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """``keys, after_us, start_us, end_us``: what to fetch before a bar that skips time, at most ``most`` intervals."""
    at = with_prev(df.select(*keys, time), step, keys, time).select(*keys, F.col(time).alias("end_us"), F.col("__prev").alias("after_us")).filter(F.col("end_us") - F.col("after_us") > step)
    return at.select(*keys, "after_us", (F.col("after_us") + step).alias("start_us"), F.least(F.col("end_us"), F.col("after_us") + step * most).alias("end_us"))


def discontinuities(df: DataFrame, step: int, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """Bars whose distance to the one before isn't one interval: gaps and duplicates."""
    return with_prev(df, step, keys, time).withColumn("diff_us", F.col(time) - F.col("__prev")).drop("__prev").filter(F.col("diff_us") != step)


def integrity(df: DataFrame, step: int, keys: Keys = ("symbol",), time: str = "open_us", factor: float = 1.5) -> DataFrame:
    """Per key: expected and actual bars between the first and the last, gaps by factor, what they miss and the largest."""
    d = with_next(df.select(*keys, time), step, keys, time).select(*keys, time, (F.col("__next") - F.col(time)).alias("__d"))
    gap = F.col("__d") > int(step * factor)
    lost = F.when(gap, F.floor(F.col("__d") / step) - 1).otherwise(0).cast("long")
    return d.groupBy(*keys).agg(
        ((F.max(time) - F.min(time)) / step + 1).cast("long").alias("expected"), F.count("*").alias("actual"),
        F.count_if(gap).alias("gaps"), F.sum(lost).alias("missing"), F.max(lost).alias("largest"),
    )
