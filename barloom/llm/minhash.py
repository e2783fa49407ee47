"""Operator 7, MinHash document fingerprints, and near-duplicates by banding with Jaccard verified.

Words are lower-cased and hashed to 64 bits; a shingle of five words is hashed from its words' hashes,
all in numpy. ``PERMS`` universal hash permutations of 32-bit numbers (multiply, add) are drawn once
from a fixed seed; a signature holds the low 16 bits of the least value of each. The likeness of two
signatures is the share of equal places, an unbiased estimate of the Jaccard similarity up to 2**-16.

Near-duplicates share a band of their signatures and are verified (:mod:`barloom.llm.bands`); the query tells
the class of each row. Texts travel compressed, and only those of candidates travel for verification.

Texts of fewer than five words are one shingle; texts without words (null, empty) share a signature
of their own, so their likeness is 1 to each other and about 0 to others. Equal texts have equal
signatures; repeated rows and rows without an id are kept, the latter last in the order. A text of any
length is one row of a task; its shingles are permuted in blocks. An empty table gives no rows. Columns
that are not asked for, whatever their names, are not read. Ids must be numbers for the comparison of
neighbours; :func:`near_duplicates` takes any kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bands
from barloom.llm.common import joined, range_bounds, range_of, sliced, table, text_key, written

PERMS = 128
SHINGLE = 5
#: Shingles that are hashed at once: a block of PERMS rows stays in a core's cache.
BLOCK = 512
KNOWN = 200_000
ROWS_PER_RANGE = 2_048
_rng = np.random.default_rng(7)
#: x -> A x + B modulo 2**32 with odd A: permutations of the 32-bit numbers.
A = _rng.integers(0, 1 << 31, (PERMS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
B = _rng.integers(0, 1 << 32, (PERMS, 1), dtype=np.uint32)
FACTORS = [np.uint64(_rng.integers(1, 1 << 63)) * np.uint64(2) + np.uint64(1) for _ in range(SHINGLE)]
_WORDS: dict[bytes, int] = {}


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash for each k-word shingle, repeats included; the whole sequence if it is shorter."""
    global _WORDS
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(_WORDS) > KNOWN:
        _WORDS = {}
    for x in set(w).difference(_WORDS):
        _WORDS[x] = xxhash.xxh64_intdigest(x)
    h = np.fromiter(map(_WORDS.__getitem__, w), dtype=np.uint64, count=len(w))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i, f in enumerate(FACTORS[: min(k, len(h))]):
        out = (out ^ (h[i : i + n] >> np.uint64(29))) * f + h[i : i + n]
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """``PERMS`` 16-bit places."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMS, 0xFFFFFFFF, dtype=np.uint32)
    v = np.empty((PERMS, min(BLOCK, len(x))), dtype=np.uint32)
    for i in range(0, len(x), BLOCK):
        part = v[:, : len(x) - i]
        np.multiply(A, x[i : i + BLOCK], out=part)
        part += B
        np.minimum(least, part.min(axis=1), out=least)
    return (least & np.uint32(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def text_signature(text: str) -> np.ndarray:
    return signature(shingle_hashes(text))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` per row: the signature in hexadecimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_signature(t.as_py() or "").tobytes().hex() for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def judged(texts: list[str], similarity: float = 0.8) -> list[int]:
    """For each text the first one of its class of similar texts."""
    return bands.set_links([np.unique(shingle_hashes(t)) for t in texts], similarity)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text))


def classes(rows: DataFrame, texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``(key, n, best)`` of similar texts; see :func:`barloom.llm.bands.similar_classes`."""
    return bands.similar_classes(rows, texts, lambda held: judged(held, similarity), shingle_set, similarity)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``(doc_id, class_id)`` per row: classes of documents linked by the Jaccard similarity of their shingle sets.

    Candidates share a band of the signature (:mod:`barloom.llm.bands`: a pair of similarity 0.8 is missed with
    a chance of 5e-5), and each link is verified on the whole texts. The class is named by its smallest id, null
    if no row of it has one.
    """
    keyed = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            hashes = [shingle_hashes(t.as_py() or "") for t in b.column(2)]
            size, fp = pa.array([len(h) for h in hashes], pa.int64()), pa.array([signature(h).tobytes().hex() for h in hashes], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size, fp], ["doc_id", "key", "size", "fingerprint"])

    rows = keyed.mapInArrow(run, f"doc_id {keyed.dtypes[0][1]}, key binary, size long, fingerprint string")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    found = classes(rows.withColumn("rank", F.col("doc_id")), keyed.select("key", "text"), similarity)
    return joined(rows.select("doc_id", "key"), found, "key", "left").select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best")).alias("class_id"))


LOWEST = -(1 << 63)


def next_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` dealt by ranges of the id, each range also with the row that follows it, ids descending, rows without an id last.

    Columns ``part, extra, doc_id, key, packed`` (the text, compressed) in that order: the row after a row is the
    next document, and ``extra`` rows stand for the first of the next range; after the last document comes the
    first. Only one row a range is copied. The driver holds two numbers for each range.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    at = F.coalesce("doc_id", F.lit(LOWEST)).alias("at")
    bounds = range_bounds(d.select(at), "at", ROWS_PER_RANGE)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            of = range_of(bounds, ids)
            parts = np.unique(of)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([ids[of == p].max() for p in parts], pa.int64())], ["part", "h"])

    heads = {r["part"]: r["h"] for r in d.select(at).mapInArrow(numbers, "part int, h long").groupBy("part").agg(F.max("h").alias("h")).collect()}
    order = sorted(heads, reverse=True)
    # the first row of each range also goes to the range before it, descending; that of the first to the last
    also = {heads[p]: order[i - 1] for i, p in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in sliced(batches):
            ids = b.column(0).fill_null(LOWEST).to_numpy()
            own = range_of(bounds, ids)
            packed = pa.array([press.compress(t.as_py().encode()) for t in b.column(1)], pa.binary())
            twice = np.flatnonzero([i in also for i in ids.tolist()])
            take = pa.array(np.append(np.arange(len(ids)), twice), pa.int64())
            part = np.append(own, [also[i] for i in ids[twice].tolist()]).astype(np.int32)
            extra = np.append(np.zeros(len(ids), dtype=bool), np.ones(len(twice), dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(extra), b.column(0).take(take), b.column(2).take(take), packed.take(take)], ["part", "extra", "doc_id", "key", "packed"])

    keyed = d.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    dealt = keyed.mapInArrow(deal, "part int, extra boolean, doc_id long, key binary, packed binary")
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.desc("part"), "extra", F.desc_nulls_last("doc_id"), "key")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of its edited text and their likeness, and that to the next document's; also ``key, size``.

    The edit replaces the last floor(n/2) code points by the first as many of the next document in
    descending order of ids, rows without an id last. Of rows that share an id a digest of the text decides the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        held, rows = None, []
        for b in batches:
            for part, extra, doc_id, key, packed in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4), strict=True):
                text = unpress.decompress(packed.as_py()).decode()
                hashes = shingle_hashes(text)
                sig = signature(hashes)
                if held is not None and held[0] == part:
                    rows.append(_compared(held, text, sig))
                held = None if extra else (part, doc_id, text, sig, key, len(hashes))
                if len(rows) == 500:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    return next_in_order(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} {k}" for n, k, _ in COMPARED))


COMPARED = (
    ("doc_id", "long", pa.int64()), ("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()), ("fingerprint", "string", pa.string()),
    ("edited_fingerprint", "string", pa.string()), ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64()),
    ("key", "binary", pa.binary()), ("size", "long", pa.int64()),
)


def _compared(held: tuple, next_text: str, next_sig: np.ndarray) -> tuple:
    _, doc_id, text, sig, key, size = held
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    e = text_signature(edited)
    digests = (hashlib.sha256(edited.encode()).hexdigest(), sig.tobytes().hex(), e.tobytes().hex())
    return (doc_id, len(text), *digests, likeness(sig, e), likeness(sig, next_sig), key, size)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(COMPARED)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, _, k) in zip(columns, COMPARED, strict=True)], [n for n, _, _ in COMPARED])


def compare_and_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of :func:`compare_with_edits` with ``class_id``, the smallest id of the class of verified near-duplicates."""
    rows = written(compare_with_edits(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    found = classes(rows.withColumn("rank", F.col("doc_id")), _keyed(docs, id_col, text_col).select("key", "text"), similarity)
    out = joined(rows.drop("size", "row"), found, "key", "left")
    return out.withColumn("class_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best"))).drop("key", "n", "best")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_and_class(table(spark, sf_dir, "documents"))
