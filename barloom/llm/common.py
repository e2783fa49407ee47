"""What the operators share: tables, the shared folder, words and id ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Hot keys that are broadcast at most, and keys of any kind.
HOT_KEYS, FEW_KEYS = 1_000, 100_000
#: Bits of a bitmap for each value, and at most.
VALUE_BITS, MOST_BITS = 12, 1 << 29
#: Ranges of ids that a job is cut into at most, those that percentiles are computed for, and keys sampled for each of more.
MAX_RANGES, FEW_RANGES, SAMPLED = 100_000, 2_000, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``. Where that is unset, a temporary one with a local master, else an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barloom-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/barloom/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: cuts the lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner", few: int | None = None) -> DataFrame:
    """A join (inner, left, left_semi or left_anti) with a written table that is unique by its key.

    At most ``few`` rows (``FEW_KEYS``) are broadcast; the count is taken first. Where there are more and ``right`` tells in
    ``n`` how many rows of ``left`` have a key, the keys of over a ``HOT_KEYS``-th of these rows, of which there are
    at most ``HOT_KEYS``, are joined by broadcast, so that the rows of a hot key stay where they are, and the others
    by shuffle.
    """
    if right.count() <= (FEW_KEYS if few is None else few):
        return left.join(F.broadcast(right), key, how)
    if "n" not in right.columns:
        return left.join(right, key, how)
    limit = max(1_000, right.agg(F.sum("n")).first()[0] // HOT_KEYS)
    hot, rest = F.broadcast(right.filter(F.col("n") > limit)), right.filter(F.col("n") <= limit)
    cool = left.join(hot.select(key), key, "left_anti").join(rest, key, how)
    return cool if how == "left_anti" else left.join(hot, key, "inner" if how == "left" else how).unionByName(cool)


class Bitmap:
    """Tells values that may be among some; misses none. Two bits a value."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.n, self.known = bits, 8 * len(bits), {}

    @staticmethod
    def places(value: str, n: int) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(value)
        return (h & 0xFFFFFFFF) % n, (h >> 32) % n

    @classmethod
    def of(cls, values: DataFrame, column: str) -> Bitmap:
        """Made where the values are; ``VALUE_BITS`` bits for each, at most ``MOST_BITS``, come to the driver."""
        n = 64 * max(1, min(MOST_BITS, VALUE_BITS * values.count()) // 64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.array([p for t in b.column(0).to_pylist() for p in cls.places(t, n)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(at), pa.int64())], ["at"])

        at = values.select(F.col(column).cast("string")).mapInArrow(run, "at long")
        bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
        got = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bits = np.zeros(n // 64, dtype="<i8")
        bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
        return cls(bits.view(np.uint8))

    def __contains__(self, value: str) -> bool:
        held = self.known.get(value)
        if held is None:
            if len(self.known) > 500_000:
                self.known.clear()
            held = self.known[value] = all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(value, self.n))
        return held


class Remembered:
    """What was made of keys, in two generations of at most ``limit`` each (or one call's): a full one is kept until the next is full, and keys that come again move on."""

    def __init__(self, limit: int) -> None:
        self.limit, self.now, self.before = limit, {}, {}

    def missing(self, keys: set) -> set:
        """The keys that have to be made and put into ``now``; all others are in it."""
        lack = keys.difference(self.now)
        if lack and len(self.now) + len(lack) > self.limit:
            self.before, self.now, lack = self.now, {}, keys
        known = self.before.keys() & lack
        self.now.update((k, self.before[k]) for k in known)
        return lack - known


def without(rows: DataFrame, gone: DataFrame, key: str, few: int | None = None) -> DataFrame:
    """The rows whose key isn't in a written table of keys: by broadcast where these are few, else only rows that a bitmap lets pass are shuffled for the join."""
    if gone.count() <= (FEW_KEYS if few is None else few):
        return rows.join(F.broadcast(gone), key, "left_anti")
    shared = rows.sparkSession.sparkContext.broadcast(Bitmap.of(gone, key))

    @F.pandas_udf("boolean")
    def may(keys):  # noqa: ANN001, ANN202
        held = shared.value
        return keys.map(lambda k: str(k) in held).astype(bool)

    name = f"__{uuid.uuid4().hex}"
    split = rows.withColumn(name, may(F.col(key)))
    sure, rest = split.filter(~F.col(name)).drop(name), split.filter(F.col(name)).drop(name)
    return sure.unionByName(rest.join(gone, key, "left_anti").select(*rows.columns))


def text_key(text: Column) -> Column:
    """A digest of 16 bytes that equal texts share; null is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN, -1)),
    )


def range_bounds(df: DataFrame, key: str, rows_per_part: int) -> list[int]:
    """Ascending keys that cut ``df`` into ranges of about ``rows_per_part`` rows, at most ``MAX_RANGES``.

    Few ranges are cut at approximate percentiles, many at those of a sample of about ``SAMPLED`` keys a
    range: one pass over one column either way, and at most ``SAMPLED * MAX_RANGES`` longs on the driver.
    """
    n = df.agg(F.count(key)).first()[0]
    parts = min(MAX_RANGES, -(-n // rows_per_part))
    if parts < 2:
        return []
    if parts <= FEW_RANGES:
        at = [i / parts for i in range(1, parts)]
        got = df.agg(F.percentile_approx(key, at, max(10_000, 20 * parts)).alias("q")).first()["q"]
        return sorted(set(got))
    every = max(1, n // (SAMPLED * parts))
    picked = df.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).select(F.col(key).cast("long")).toArrow().column(0).to_numpy()
    picked.sort()
    return sorted({int(picked[i * len(picked) // parts]) for i in range(1, parts)})


def range_of(bounds: list[int], keys: np.ndarray) -> np.ndarray:
    """The number of the range of each key: how many bounds are below or at it."""
    return np.searchsorted(np.asarray(bounds, dtype=np.int64), keys, side="right").astype(np.int32)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what a task makes of the rows of one is small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def groups_of(texts: Iterable[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``size`` characters or one longer text: the bound of working memory."""
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group
