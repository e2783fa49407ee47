"""The cache's catalogue: one row per series and day, with statistics, gaps and upserts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.intervals import DAY, day_us, expected_rows_per_day
from barloom.operators.gaps import grid
from barloom.operators.merge import keep_first
from barloom.sources.scratch import cut
from barloom.sources.versions import Versioned

Keys = tuple[str, ...]


def of_table(df: DataFrame, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """The catalogue of bars: records and span of each day."""
    return df.groupBy(*keys, day_us(F.col(time)).alias("day_us")).agg(F.count("*").alias("num_records"), F.min(time).alias("first_us"), F.max(time).alias("last_us"))


def of_files(spark: SparkSession, path: str, least_bytes: int = 1_024, max_age_days: int = 30, now: Column | None = None) -> DataFrame:
    """``path, folder, day, file_size, modified, corrupt, stale`` of the files below a folder, told by listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    day = F.try_to_timestamp(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1), F.lit("yyyy-MM-dd")).cast("date")
    now = F.current_timestamp() if now is None else now
    return files.select(
        "path", F.regexp_extract("path", "^(.*)/", 1).alias("folder"), day.alias("day"), "file_size", "modified", (F.col("file_size") < least_bytes).alias("corrupt"),
        (F.unix_micros(now) - F.unix_micros("modified") > max_age_days * DAY).alias("stale"),
    )


def health(files: DataFrame) -> DataFrame:
    """Per folder: files, bytes, the oldest and the newest, the earliest day, and how many are corrupt or stale."""
    return files.groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.min("modified").alias("oldest"), F.max("modified").alias("newest"),
        F.min("day").alias("earliest_day"), F.count_if("corrupt").alias("corrupt"), F.count_if("stale").alias("stale"),
    )


def sound_entries(catalog: DataFrame, required: tuple[str, ...] = ("symbol", "day_us", "num_records")) -> DataFrame:
    """Entries with all that is required and at least one record."""
    ok = F.col("num_records") > 0
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return catalog.filter(ok)


def failures(registry: DataFrame, symbol: str | None = None, interval: str | None = None) -> DataFrame:
    """Entries whose actual checksum isn't the expected one, of a symbol or interval if asked for."""
    bad = registry.filter(~F.col("expected_checksum").eqNullSafe(F.col("actual_checksum")))
    bad = bad if symbol is None else bad.filter(F.col("symbol") == symbol)
    return bad if interval is None else bad.filter(F.col("interval") == interval)


def latest_within(catalog: DataFrame, before_us: int, days: int = 10, keys: Keys = ("symbol",)) -> DataFrame:
    """Per key the latest day of the last ``days`` before a time, null (``terminated``) where there is none."""
    near = (F.col("day_us") <= before_us) & (F.col("day_us") > before_us - days * DAY)
    out = catalog.groupBy(*keys).agg(F.max(F.when(near, F.col("day_us"))).alias("latest_us"))
    return out.withColumn("terminated", F.col("latest_us").isNull())


def build(catalog: DataFrame, ranges: DataFrame, load: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], force: bool = False) -> DataFrame:
    """Loads the days that the catalogue lacks (all with ``force``) once, writes their bars, and returns the catalogue's new rows: of what was written."""
    days = _days(ranges).select("symbol", "day_us") if force else missing_days(catalog, ranges)
    bars = cut(load(days))
    write(bars)
    return of_table(bars)


#: The catalogue as it is kept on disk.
KEPT = "symbol string, day_us long, num_records long, first_us long, last_us long, version long"


def kept(spark: SparkSession, path: str) -> Versioned:
    """The catalogue beside the data: a row a symbol and day, in parts of a month."""
    return Versioned(spark, path, KEPT)


def ingest(catalog: Versioned, ranges: DataFrame, fetch: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], version: int) -> tuple[DataFrame, DataFrame]:
    """One step from a source to the cache: fetches the days that the catalogue lacks, keeps what fits its checksum, writes it and enters it in the catalogue.

    ``fetch`` gets ranges ``symbol, start_us, end_us`` and gives bars with ``day`` and ``checksum_ok``
    (:func:`barloom.sources.remote.fetch_days`). Returns the new entries and the failures ``symbol, day_us, reason``: days
    whose file doesn't fit, which are neither written nor entered, and those that the source doesn't have. The source is read once.
    """
    days = cut(missing_days(catalog.read(), ranges))
    got = cut(fetch(days.select("symbol", F.col("day_us").alias("start_us"), (F.col("day_us") + DAY).alias("end_us"))))
    bars = got.filter("checksum_ok")
    write(bars.drop("checksum_ok", "day"))
    new = cut(of_table(bars).withColumn("version", F.lit(version).cast("long")))
    catalog.upsert(new)
    spoiled = got.filter("not checksum_ok").select("symbol", day_us(F.col("open_us")).alias("day_us")).distinct().withColumn("reason", F.lit("checksum"))
    lost = days.join(got.select("symbol", day_us(F.col("open_us")).alias("day_us")).distinct(), ["symbol", "day_us"], "left_anti").withColumn("reason", F.lit("no data"))
    return new, spoiled.unionByName(lost)


#: Bytes that a digest takes at a time.
CHUNK = 8 << 20


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, actual``: SHA-256 of the files below a folder, each read by a task in chunks, so a file of any size takes one chunk of memory. Empty files aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for url in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", url))
                digest = hashlib.sha256()
                with store.open_input_stream(name) as f:
                    while chunk := f.read(CHUNK):
                        digest.update(chunk)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.string())], ["path", "bytes", "actual"])

    return files.mapInArrow(run, "path string, bytes long, actual string")


def verified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files below a folder with their SHA-256 and whether it is the one expected (``path, checksum``)."""
    files = digests(spark, path).drop("bytes")
    return files.join(expected, "path", "left").withColumn("matches", F.coalesce(F.col("actual") == F.lower("checksum"), F.lit(False)))


def statistics(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count("*").alias("entries"), F.count_distinct("symbol").alias("symbols"), F.sum("num_records").alias("records"), F.sum("file_size").alias("bytes"),
        F.min("day_us").alias("first_day_us"), F.max("day_us").alias("last_day_us"),
    )


def _days(ranges: DataFrame) -> DataFrame:
    return grid(ranges, DAY, "day_us")


def missing_days(catalog: DataFrame, ranges: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    return _days(ranges).join(catalog.select(*keys, "day_us").distinct(), [*keys, "day_us"], "left_anti").select(*keys, "day_us")


def coverage(catalog: DataFrame, ranges: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """Per key: days of the range, days in the catalogue, and their share in percent."""
    there = catalog.select(*keys, "day_us").distinct().withColumn("__there", F.lit(1))
    j = _days(ranges).join(there, [*keys, "day_us"], "left")
    return j.groupBy(*keys).agg(F.count("*").alias("days"), F.count("__there").alias("cached"), F.round(F.count("__there") / F.count("*") * 100, 6).alias("pct"))


def upsert(catalog: DataFrame, new: DataFrame, keys: Keys = ("symbol", "day_us"), version: str = "version") -> DataFrame:
    """The latest row per key of both tables."""
    return keep_first(catalog.unionByName(new, allowMissingColumns=True), keys, [F.desc(version)])


def invalidate(catalog: DataFrame, entries: DataFrame, reason: str, keys: Keys = ("symbol", "day_us")) -> DataFrame:
    """The catalogue with the entries flagged and the reason given."""
    flag = entries.select(*keys).distinct().withColumn("__bad", F.lit(True))
    out = catalog.join(flag, list(keys), "left").withColumn("is_invalid", F.coalesce("__bad", F.lit(False)))
    return out.withColumn("reason", F.when(F.col("__bad"), reason)).drop("__bad")


def daily_quality(df: DataFrame, interval: str, keys: Keys = ("symbol",), time: str = "open_us") -> DataFrame:
    """Per key and day: rows, distinct times, and their share of a complete day's."""
    n = expected_rows_per_day(interval)
    return df.groupBy(*keys, day_us(F.col(time)).alias("day_us")).agg(F.count("*").alias("rows"), F.count_distinct(time).alias("distinct_times"), F.least(F.lit(1.0), F.round(F.count_distinct(time) / n, 6)).alias("share"))


def flatten_metadata(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """A nested catalogue ``{symbol: {interval: {date: {...}}}}`` as rows ``symbol, interval, day, num_records, file_size, path``."""
    entry = "struct<num_records:bigint,file_size:bigint,path:string>"
    m = docs.select(F.explode(F.from_json(json_col, f"map<string,map<string,map<string,{entry}>>>")).alias("symbol", "x"))
    m = m.select("symbol", F.explode("x").alias("interval", "y")).select("symbol", "interval", F.explode("y").alias("day", "e"))
    return m.select("symbol", "interval", F.to_date("day").alias("day"), "e.*")


def availability(catalog: DataFrame, ranges: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """Per key and day of the ranges whether the catalogue has it."""
    there = catalog.select(*keys, "day_us").distinct().withColumn("available", F.lit(True))
    return _days(ranges).join(there, [*keys, "day_us"], "left").withColumn("available", F.coalesce("available", F.lit(False)))


def by_market(catalog: DataFrame, path: str = "path") -> DataFrame:
    """Entries and records by the market that a path names."""
    market = F.when(F.col(path).like("%/um/%"), "um").when(F.col(path).like("%/cm/%"), "cm").when(F.col(path).like("%/spot/%"), "spot").otherwise("unknown")
    return catalog.groupBy(market.alias("market")).agg(F.count("*").alias("entries"), F.sum("num_records").alias("records"))


def by_interval(catalog: DataFrame, elapsed_s: float | None = None) -> DataFrame:
    """Per interval: days, records and, given how long a build took, records a second."""
    g = catalog.groupBy("interval").agg(F.count("*").alias("days"), F.sum("num_records").alias("records"))
    return g if elapsed_s is None else g.withColumn("per_second", F.col("records") / elapsed_s)


def with_metadata(catalog: DataFrame, path: str, version: int = 0) -> Versioned:
    """Enters a table's catalogue in the one that is kept beside the data: a day that is entered again replaces its row."""
    table = kept(catalog.sparkSession, path)
    table.upsert(catalog.withColumn("version", F.lit(version).cast("long")))
    return table
