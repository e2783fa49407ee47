"""Windows over long series, in two levels.

A window keyed by the series alone would bring a whole series into one task, however long. Here a series
is cut into buckets of ``BUCKET`` steps of time: the window runs within (series, bucket), and what crosses
buckets comes from a table with one row a bucket, over which a second window runs. That table is
``BUCKET`` times smaller than the series, and joined back on (series, bucket). Both levels read the same
exchange on (series, bucket), so the series is read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = tuple[str, ...]
BUCKET = 4_096


def bucketed(df: DataFrame, time: str, step: int, size: int = BUCKET) -> DataFrame:
    """``df`` with ``__bucket``, the number of its bucket; times may be negative."""
    return df.withColumn("__bucket", F.floor(F.col(time) / (step * size)).cast("long"))


def dealt(df: DataFrame, time: str, step: int, keys: Keys, size: int = BUCKET) -> DataFrame:
    """The same, shuffled once on (series, bucket): the two levels then share that exchange."""
    return bucketed(df, time, step, size).repartition(*keys, "__bucket")


def with_next(df: DataFrame, step: int, keys: Keys, time: str, carry: Keys = (), size: int = BUCKET) -> DataFrame:
    """``df`` with ``__next``, the time of the row after each, null for the last; ``__next_<c>`` for each carried column.

    Of rows that share a time, the others come first in no stated order: a step of 0.
    """
    d = dealt(df, time, step, keys, size)
    w = W.partitionBy(*keys, "__bucket").orderBy(time)
    rows = d.withColumn("__in", F.lead(F.struct(time, *carry)).over(w))
    heads = d.groupBy(*keys, "__bucket").agg(F.min(F.struct(time, *carry)).alias("__head"))
    after = heads.select(*keys, "__bucket", F.lead("__head").over(W.partitionBy(*keys).orderBy("__bucket")).alias("__out"))
    nxt = F.coalesce("__in", "__out")
    return rows.join(after, [*keys, "__bucket"]).withColumns({"__next": nxt[time]} | {f"__next_{c}": nxt[c] for c in carry}).drop("__bucket", "__in", "__out")


def with_prev(df: DataFrame, step: int, keys: Keys, time: str, size: int = BUCKET) -> DataFrame:
    """``df`` with ``__prev``, the time of the row before each, null for the first."""
    d = dealt(df, time, step, keys, size)
    rows = d.withColumn("__in", F.lag(time).over(W.partitionBy(*keys, "__bucket").orderBy(time)))
    tails = d.groupBy(*keys, "__bucket").agg(F.max(time).alias("__tail"))
    before = tails.select(*keys, "__bucket", F.lag("__tail").over(W.partitionBy(*keys).orderBy("__bucket")).alias("__out"))
    return rows.join(before, [*keys, "__bucket"]).withColumn("__prev", F.coalesce("__in", "__out")).drop("__bucket", "__in", "__out")


def with_prev_of(df: DataFrame, keys: Keys, order: str, value: str, size: int = BUCKET) -> DataFrame:
    """``df`` with ``__prev``, the value of the row before each in the order of a whole-numbered column, null for the first."""
    d = dealt(df, order, 1, keys, size)
    rows = d.withColumn("__in", F.lag(F.struct(value)).over(W.partitionBy(*keys, "__bucket").orderBy(order)))
    tails = d.groupBy(*keys, "__bucket").agg(F.max_by(F.struct(value), order).alias("__tail"))
    before = tails.select(*keys, "__bucket", F.lag("__tail").over(W.partitionBy(*keys).orderBy("__bucket")).alias("__out"))
    return rows.join(before, [*keys, "__bucket"]).withColumn("__prev", F.coalesce("__in", "__out")[value]).drop("__bucket", "__in", "__out")


def with_running(df: DataFrame, step: int, keys: Keys, time: str, order: list[str], name: str, of: Column, how: str, inclusive: bool = True, size: int = BUCKET) -> DataFrame:
    """``df`` with ``name``, the running ``max`` or ``sum`` of a column over the rows until each (or before it)."""
    agg = {"max": F.max, "sum": F.sum}[how]
    d = dealt(df.withColumn("__of", of), time, step, keys, size)
    w = W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    rows = d.withColumn("__in", agg("__of").over(w))
    totals = d.groupBy(*keys, "__bucket").agg(agg("__of").alias("__t"))
    before = totals.select(*keys, "__bucket", agg("__t").over(W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)).alias("__out"))
    both = F.greatest("__in", "__out") if how == "max" else F.coalesce(F.col("__in") + F.col("__out"), "__in", "__out")  # greatest skips nulls
    return rows.join(before, [*keys, "__bucket"]).withColumn(name, both).drop("__bucket", "__of", "__in", "__out")


def filled(df: DataFrame, step: int, keys: Keys, time: str, columns: list[str], forward: bool = True, size: int = BUCKET) -> DataFrame:
    """``df`` with the nulls of the columns filled by the last value before (or the next one after)."""
    d = dealt(df.select(*keys, time, *columns), time, step, keys, size)
    pick, best = (F.last, F.max_by) if forward else (F.first, F.min_by)
    span = (W.unboundedPreceding, 0) if forward else (0, W.unboundedFollowing)
    others = (W.unboundedPreceding, -1) if forward else (1, W.unboundedFollowing)
    w = W.partitionBy(*keys, "__bucket").orderBy(time).rowsBetween(*span)
    ends = d.groupBy(*keys, "__bucket").agg(*[best(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns])
    over = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(*others)
    beyond = ends.select(*keys, "__bucket", *[pick(c, ignorenulls=True).over(over).alias(f"__{c}") for c in columns])
    rows = d.select(*keys, time, "__bucket", *[pick(c, ignorenulls=True).over(w).alias(c) for c in columns])
    return rows.join(beyond, [*keys, "__bucket"]).select(*keys, time, *[F.coalesce(c, f"__{c}").alias(c) for c in columns])


def with_context(df: DataFrame, step: int, keys: Keys, time: str, back: int, size: int = BUCKET) -> DataFrame:
    """Rows of a regular series with ``__bucket``, and again (``__copy``) in the next bucket if they are within ``back`` steps of it."""
    if back >= size:
        raise ValueError("the frame must be shorter than a bucket; with_frame takes longer ones")
    d = bucketed(df, time, step, size)
    ahead = F.floor((F.col(time) + back * step) / (step * size)).cast("long")
    both = F.when(ahead > F.col("__bucket"), F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("c")), F.struct(ahead.alias("b"), F.lit(True).alias("c")))).otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("c"))))
    return d.withColumn("__x", F.explode(both)).withColumns({"__bucket": F.col("__x.b"), "__copy": F.col("__x.c")}).drop("__x")


def with_frame(df: DataFrame, step: int, keys: Keys, time: str, column: str, n: int, size: int = BUCKET) -> DataFrame:
    """Rows of a regular series with ``__sum, __held``: the sum of a column over the last ``n`` rows and how many of them have a value; a frame of any length.

    Sums run from a bucket's start, and those of whole buckets over the table of buckets; a frame's sum is what
    both come to at its last row less what they came to at the row before its first, which is joined by its time.
    """
    d = dealt(df, time, step, keys, size)
    w = W.partitionBy(*keys, "__bucket").orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    rows = d.withColumns({"__s": F.coalesce(F.sum(column).over(w), F.lit(0.0)), "__n": F.count(column).over(w)})
    totals = d.groupBy(*keys, "__bucket").agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("__t"), F.count(column).alias("__c"))
    over = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*keys, "__bucket", F.coalesce(F.sum("__t").over(over), F.lit(0.0)).alias("__bs"), F.coalesce(F.sum("__c").over(over), F.lit(0)).alias("__bn"))
    at = rows.join(before, [*keys, "__bucket"])
    reached = ("__s", "__n", "__bs", "__bn")
    left = at.select(*keys, (F.col(time) + n * step).alias(time), *[F.col(c).alias(f"{c}0") for c in reached])
    less = lambda a, b: F.col(a) - F.coalesce(f"{a}0", F.lit(0)) + F.col(b) - F.coalesce(f"{b}0", F.lit(0))
    both = at.join(left, [*keys, time], "left").withColumns({"__sum": less("__s", "__bs"), "__held": less("__n", "__bn")})
    return both.drop("__bucket", *reached, *[f"{c}0" for c in reached])
