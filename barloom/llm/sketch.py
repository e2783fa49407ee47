"""Operator 12, near-duplicates by fast similarity sketching, banding and exact verification.

A sketch of a set of shingles has ``PLACES`` coordinates. In round i each shingle goes to a bin that a hash of the
round deals it to, with the value i + u, where u in [0, 1) is hashed too; a coordinate keeps its least value. Rounds go
on until every coordinate is filled, and after ``PLACES`` of them each further round fills one given coordinate, so
``2 * PLACES`` rounds suffice for any set with a shingle. A later round's values are larger, so it never
changes a filled coordinate, and large sets need one or two rounds: the time is the set's size plus
``PLACES * log(PLACES)``, where as many permutations take their product. The share of equal coordinates estimates the
Jaccard similarity without bias and is concentrated as if coordinates were independent.

Texts that share a band of their sketches (25 of 5 coordinates) are candidates, and each link is verified on the whole
sets (:mod:`barloom.llm.bands`): a pair of similarity 0.85 shares none with a chance of 4e-7.

Words are lower-cased (A-Z) and cut at ASCII white space; texts of fewer words than a shingle are one shingle. Null and
empty texts and those without words have no shingles and are linked with nothing, not with each other. Repeated
rows and equal texts have the same class; a class is named by its smallest id, null if no row of it has one. A text of
any length is one row of a task; its shingles are hashed in blocks. An empty table gives no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bands
from barloom.llm.common import joined, sliced, table, text_key, written
from barloom.llm.minhash import shingle_hashes

PLACES = 128
SHINGLE, SIMILARITY = 3, 0.85
#: Hashes that are made at once.
BLOCK = 1 << 15
_rng = np.random.default_rng(12)
#: One random number for each round.
ROUNDS = _rng.integers(0, 1 << 64, 2 * PLACES, dtype=np.uint64, endpoint=False)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The multipliers of a well-known 64-bit finalizer.
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SHIFT, LOW, LOWER = np.uint64(33), np.uint64(32), np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, in place."""
    for m in (M1, M2):
        x ^= x >> SHIFT
        x *= m
    x ^= x >> SHIFT
    return x


def _hashes(shingles: np.ndarray, rounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of the shingles in some rounds, a block at a time: a row for each round, and the rounds as a column."""
    wide = min(len(shingles), BLOCK)
    for i in range(0, len(rounds), many := max(1, BLOCK // wide)):
        of = rounds[i : i + many, None]
        for k in range(0, len(shingles), wide):
            yield mixed(shingles[None, k : k + wide] ^ ROUNDS[of]), of


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``PLACES`` values of a set of 64-bit shingles: the round in the upper half, u in the lower; ``EMPTY`` for an empty set."""
    least = np.full(PLACES, EMPTY)
    n = len(shingles)
    if not n:
        return least
    done = 0
    while done < PLACES and (least == EMPTY).any():
        rounds = np.arange(done, done := min(PLACES, done + max(1, 2 * PLACES // n)))
        for h, i in _hashes(shingles, rounds):
            value = h & LOWER | i.astype(np.uint64) << LOW
            np.minimum.at(least, ((h >> LOW) % np.uint64(PLACES)).astype(np.int64), value)
    for h, i in _hashes(shingles, PLACES + np.flatnonzero(least == EMPTY)):
        value = h & LOWER | i.astype(np.uint64) << LOW
        np.minimum.at(least, np.broadcast_to(i - PLACES, value.shape), value)
    return least


def fingerprint(shingles: np.ndarray) -> str:
    """The sketch in hexadecimal digits, 16 bits a coordinate."""
    return (mixed(sketch(shingles)) & np.uint64(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal coordinates of two sketches."""
    return float((a == b).mean())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row: the size of its set, its class, and whether it names the class."""

    def shingle_set(text: str) -> np.ndarray:
        return np.unique(shingle_hashes(text, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            every = [shingle_hashes(t.as_py() or "", shingle) for t in b.column(2)]
            sets = [np.unique(x) for x in every]
            columns = [pa.array([len(x) for x in s], pa.int64()) for s in (every, sets)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array([fingerprint(s) for s in sets], pa.string())], ["doc_id", "key", "size", "n_shingles", "fingerprint"])

    keyed = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    kind = keyed.dtypes[0][1]
    rows = keyed.mapInArrow(run, f"doc_id {kind}, key binary, size long, n_shingles long, fingerprint string")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    some = rows.filter("size > 0").withColumn("rank", F.col("doc_id"))
    found = bands.similar_classes(some, keyed.select("key", "text"), lambda held: bands.set_links([shingle_set(t) for t in held], similarity), shingle_set, similarity)
    out = joined(rows.select("doc_id", "key", "n_shingles"), found, "key", "left")
    component = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op12_fast_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
