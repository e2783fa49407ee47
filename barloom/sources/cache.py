"""The cache of bars: Parquet, partitioned by series and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.intervals import DAY, day_us
from barloom.operators.gaps import STRICT, missing_segments
from barloom.operators.merge import priority_merge
from barloom.operators.schema import SOURCE
from barloom.sources.scratch import cut

PARTITION = ("market", "symbol", "interval", "date")
SCHEMA = "open_us bigint, open double, high double, low double, close double, volume double, trades bigint, _data_source string, market string, symbol string, interval string, date date"


def write(bars: DataFrame, path: str, merge: bool = True) -> None:
    """Writes bars (with market, symbol, interval and ``open_us``) by day; days that are there are merged, then replaced.

    Only partitions that get rows are touched. A partial day is merged with what the cache holds, so it
    never overwrites a fuller one. Rows are clustered by partition first: one file a day and series.
    """
    new = bars.withColumn("date", F.timestamp_micros(day_us(F.col("open_us"))).cast("date"))
    if merge and exists(bars.sparkSession, path):
        old = bars.sparkSession.read.schema(SCHEMA).parquet(path)
        days = new.select(*PARTITION).distinct()
        kept = old.join(days, list(PARTITION), "left_semi")
        new = priority_merge([kept, new], keys=PARTITION)
        new = cut(new)  # merged days are written elsewhere before they replace what they were read from
    new.repartition(*PARTITION).sortWithinPartitions(*PARTITION, "open_us").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, path: str, market: str, interval: str, start_us: int, end_us: int, symbols: list[str] | None = None, closed: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Bars of a range, tagged CACHE: partitions are pruned by series and day, times pushed to the files."""
    df = spark.read.schema(SCHEMA).parquet(path).filter((F.col("market") == market) & (F.col("interval") == interval))
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(symbols))
    day = lambda us: F.timestamp_micros(F.lit(us - us % DAY)).cast("date")
    df = df.filter(F.col("date").between(day(start_us), day(end_us)))
    df = df.filter((F.col("open_us") >= start_us) & ((F.col("open_us") <= end_us) if closed else (F.col("open_us") < end_us)))
    df = df.withColumn(SOURCE, F.lit("CACHE"))
    return df.select(*dict.fromkeys(["symbol", "open_us", *columns, SOURCE])) if columns else df


def scan_valid(spark: SparkSession, path: str, catalog: DataFrame, **range_: object) -> DataFrame:
    """A scan without the days that the catalogue calls invalid."""
    bad = catalog.filter("is_invalid").select("symbol", F.timestamp_micros("day_us").cast("date").alias("date"))
    return scan(spark, path, **range_).join(bad, ["symbol", "date"], "left_anti")


def scan_missing(spark: SparkSession, path: str, ranges: DataFrame, step: int, thresholds: tuple[float, float] = STRICT, **range_: object) -> tuple[DataFrame, DataFrame]:
    """A closed scan and what is missing of the ranges ``symbol, from_us, to_us``."""
    found = scan(spark, path, closed=True, **range_)
    return found, missing_segments(found, ranges, step, thresholds)


def scan_catalogued(spark: SparkSession, path: str, catalog: DataFrame, **range_: object) -> DataFrame:
    """A scan of the days that the catalogue has and doesn't call invalid: days are told by the catalogue, not by listing."""
    good = catalog.filter(~F.coalesce("is_invalid", F.lit(False))) if "is_invalid" in catalog.columns else catalog
    days = good.select("symbol", F.timestamp_micros("day_us").cast("date").alias("date")).distinct()
    return scan(spark, path, **range_).join(days, ["symbol", "date"], "left_semi")


def export_csv(bars: DataFrame, path: str, order: tuple[str, ...] = ("symbol", "open_us")) -> None:
    """Rows as CSV files in order: within each file, and from file to file by name. Ranges of the order are dealt to tasks, so a long series spreads over files."""
    bars.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", "true").csv(path)
