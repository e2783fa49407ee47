"""Regular series: every bar of a range, filled or not, and measures of completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.gaps import grid
from barloom.operators.runs import BUCKET, filled, with_context, with_frame

Keys = tuple[str, ...]


def reindex(df: DataFrame, ranges: DataFrame, step: int, fill: str | None = None, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """A row for every bar of the half-open ranges; bars that ``df`` lacks are null, or filled ``forward`` or ``backward``."""
    full = grid(ranges, step, time).join(df, [*keys, time], "left")
    if fill is None:
        return full
    values = [c for c in df.columns if c not in (*keys, time)]
    if fill not in ("forward", "backward"):
        raise ValueError(f"fill is forward or backward, not {fill}")
    return filled(full, step, keys, time, values, forward=fill == "forward")


def moving_average(full: DataFrame, column: str, n: int, step: int, name: str, keys: Keys = ("symbol",), time: str = "open_us", long: int = BUCKET) -> DataFrame:
    """A regular series with the mean of the last ``n`` rows, null until all of them have a value.

    A frame shorter than ``long`` is read from the rows of its bucket and a copy of those before it; longer ones,
    however long, come from differences of running sums, which agree to the last few bits of the sums.
    """
    if n >= long:
        held = with_frame(full, step, keys, time, column, n)
        return held.withColumn(name, F.when(F.col("__held") == n, F.col("__sum") / n)).drop("__sum", "__held")
    w = W.partitionBy(*keys, "__bucket").orderBy(time).rowsBetween(-(n - 1), 0)
    mean = F.when(F.count(column).over(w) == n, F.avg(column).over(w))
    return with_context(full, step, keys, time, n - 1).withColumn(name, mean).filter(~F.col("__copy")).drop("__bucket", "__copy")


def completeness(full: DataFrame, columns: tuple[str, ...], keys: Keys = ("symbol",)) -> DataFrame:
    """Per key of a regular series: rows, mean share of values in percent, rows with any null and their share."""
    anynull = F.lit(False)
    for c in columns:
        anynull = anynull | F.col(c).isNull()
    held = sum((F.count(c) for c in columns[1:]), F.count(columns[0])) / len(columns)
    return full.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.round(held / F.count("*") * 100, 6).alias("pct_values"),
        F.count_if(anynull).alias("rows_with_null"), F.round(F.count_if(anynull) / F.count("*") * 100, 6).alias("pct_rows_with_null"),
    )


def window_complete(df: DataFrame, window: int, columns: tuple[str, ...], keys: Keys = ("symbol",), least_pct: float = 90.0) -> DataFrame:
    """Per key whether the columns hold on average at least that share of ``window`` values."""
    held = sum((F.count(c) for c in columns[1:]), F.count(columns[0])) / len(columns)
    return df.groupBy(*keys).agg(F.round(held, 6).alias("avg_values"), (held >= window * least_pct / 100).alias("complete"))
