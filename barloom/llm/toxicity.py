"""Operator 6, toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its hashed features (lower-cased
words, and prefixes of four and five letters), and the document's score is their noisy-or,
``1 - prod(1 - p)``: one toxic sentence is enough. Training needs labels of documents only; the
gradient of the noisy-or sends each document's label to the sentences that explain it, which then
locates offending sentences.

The model is fit on at most ``MAX_FIT`` labelled documents of each class (those first by a hash of
their id: a bounded sample, the same on every run) outside the held-out fold, and then scores every
row in tasks. Only features that go with the label have a weight: those whose number of toxic documents
in the sample has a chance of at most ``ALPHA`` (hypergeometric tail). The others would only learn the
sample by heart. Labels, language, source and id are no inputs of a score; rows are scored by text alone.
Of the sample, the counts of features that may pass and the places of those that do come to the driver.

Null, empty and wordless texts get the score of a text without sentences: zero. Without labels of both
classes the weights stay at their start and every score is low. Equal texts have equal scores; repeated
rows are scored each. Ties: a score of exactly 0.5 is predicted toxic; of documents whose ids share a hash the smaller id is first in the sample. Sentences longer than ``LONG`` words are cut, so that texts without punctuation still
have instances; a text of any length is one row of a task. An empty table gives no rows. Ids may be of any
type; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table, written

DIM = 1 << 18
MAX_FIT = 2_500
LONG = 40
#: Steps over the sample: at least EPOCHS, and for small samples up to MAX_EPOCHS or about STEPS mini-batches.
EPOCHS, MAX_EPOCHS, STEPS, BATCH = 12, 60, 1_200, 32
#: The score of a sentence without evidence is about 2e-4, so that long documents don't add up to toxic ones.
BIAS = -8.5
ALPHA = 1e-4
KNOWN = 500_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
PREFIXES = (4, 5)


def features(word: str) -> tuple[int, ...]:
    """Places of a lower-cased word's features."""
    names = ["w" + word, *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]
    return tuple(xxhash.xxh32_intdigest(x) % DIM for x in names)


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """``(start, end, words)`` of each sentence with a word."""
    for m in SENTENCE.finditer(text):
        found = [(w.start() + m.start(), w.end() + m.start(), w[0].lower()) for w in WORD.finditer(m[0])]
        for i in range(0, len(found), LONG):
            part = found[i : i + LONG]
            yield part[0][0], part[-1][1], [w for _, _, w in part]


def _tail(a: int, n: int, k: int, total: int) -> float:
    """The chance of ``a`` or more marked ones among ``n`` drawn of ``total``, ``k`` of which are marked."""
    log = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    return sum(exp(log(k, i) + log(total - k, n - i) - log(total, n)) for i in range(a, min(n, k) + 1) if n - i <= total - k)


def least_toxic(k: int, total: int, alpha: float = ALPHA) -> int:
    """In how many toxic documents of ``k`` a feature must be at least, were it in no other."""
    return next((a for a in range(1, k + 1) if _tail(a, a, k, total) <= alpha), k + 1)


def goes_with_label(toxic: int, docs: int, k: int, total: int, alpha: float = ALPHA) -> bool:
    return toxic * total > docs * k and _tail(toxic, docs, k, total) <= alpha


def _features_of(text: str) -> set[int]:
    return {f for w in {w for _, _, words in sentences(text) for w in words} for f in features(w)}


def bag(text: str, kept: frozenset[int]) -> tuple[list[int], list[int], int]:
    """Places of the kept features of each sentence's distinct words, where each sentence with any starts in them, and how many have none."""
    places: list[int] = []
    starts: list[int] = []
    plain = 0
    for _, _, words in sentences(text):
        own = [f for w in dict.fromkeys(words) for f in features(w) if f in kept]
        if own:
            starts.append(len(places))
            places += own
        else:
            plain += 1
    return places, starts, plain


def fit(bags: list[tuple[list[int], list[int], int]], labels: np.ndarray, share: float | None = None, rate: float = 0.4, seed: int = 5) -> np.ndarray:
    """Weights (the last is the bias, fixed) by stochastic gradients of the noisy-or likelihood.

    Step sizes shrink for each weight with its gradients. Classes weigh as the geometric mean of being equal
    and of ``share``, that of class 1.
    """
    w = np.zeros(DIM + 1)
    w[-1] = BIAS
    ones = int(labels.sum()) if len(labels) else 0
    if ones in (0, len(labels)):
        return w
    share = ones / len(labels) if share is None else share
    weight = np.where(labels == 1, np.sqrt(share * 0.5) / ones, np.sqrt((1 - share) * 0.5) / (len(labels) - ones))
    weight *= len(labels) / weight.sum()
    held = [(np.array(p, dtype=np.int64), np.array(s, dtype=np.int64), n) for p, s, n in bags]
    alone = np.log1p(-1 / (1 + np.exp(-BIAS)))  # of a sentence without evidence
    squares = np.full(DIM + 1, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(min(MAX_EPOCHS, max(EPOCHS, STEPS * BATCH // len(held)))):
        order = rng.permutation(len(held))
        for lo in range(0, len(order), BATCH):
            at_places, values = [], []
            for i in order[lo : lo + BATCH]:
                places, at, plain = held[i]
                if not len(at):
                    continue
                z = np.add.reduceat(w[places], at) + w[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                none = np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum() + plain * alone)  # the chance that no sentence is toxic
                d = weight[i] * (p if labels[i] == 0 else -p * none / max(1 - none, 1e-9))
                at_places.append(places)
                values.append(np.repeat(d, np.diff(np.append(at, len(places)))))
            if not at_places:
                continue
            used, back = np.unique(np.concatenate(at_places), return_inverse=True)
            g = np.bincount(back, weights=np.concatenate(values)) / BATCH
            squares[used] += g * g
            w[used] -= rate * g / np.sqrt(squares[used])
    return w


class Scorer:
    def __init__(self, w: np.ndarray) -> None:
        self.w, self.known = w, {}

    def _of(self, word: str) -> float:
        v = self.known.get(word)
        if v is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            v = self.known[word] = float(sum(self.w[i] for i in features(word)))
        return v

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and ``(start, end, score)`` of each sentence."""
        bias, out, none = float(self.w[-1]), [], 1.0
        of = self._of
        for s, e, words in sentences(text):
            z = bias + sum(map(of, set(words)))
            p = 1 / (1 + np.exp(-z)) if z > -30 else 0.0
            out.append((s, e, p))
            none *= 1 - p
        return float(1 - none), out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT, learn: Column | None = None) -> np.ndarray:
    """Weights from at most ``max_fit`` labelled documents of each class; ``learn`` restricts the rows of ``labels``."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.lit(True) if learn is None else learn))
    known = known.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in (0, 1)}
    pick = None
    for c in (0, 1):
        of_class = known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
        pick = of_class if pick is None else pick.unionByName(of_class)
    # at most 2 * max_fit rows of ids and labels
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id")
    chosen = written(chosen.select("label", "text"))
    size = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    k, total = size.get(1, 0), sum(size.values())
    if k in (0, total):
        return fit([], np.zeros(0))
    counts = chosen.mapInArrow(_counted, "place int, docs long, toxic long").groupBy("place").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    may = counts.filter(F.col("toxic") >= least_toxic(k, total)).collect()  # at most DIM rows
    kept = frozenset(r["place"] for r in may if goes_with_label(r["toxic"], r["docs"], k, total))

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [bag(t.as_py(), kept) for t in b.column("text")]
            lists = [pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("label"), *lists, pa.array([g[2] for g in got], pa.int32())], ["label", "places", "starts", "plain"])

    rows = sorted((r["label"], r["places"], r["starts"], r["plain"]) for r in chosen.mapInArrow(bagged, "label int, places array<int>, starts array<int>, plain int").collect())
    return fit([r[1:] for r in rows], np.array([r[0] for r in rows]), n.get(1, 0) / sum(n.values()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents, and toxic ones, of a task each feature is."""
    of = np.zeros((2, DIM), dtype=np.int64)
    for b in batches:
        for label, t in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
            of[label, list(_features_of(t.as_py()))] += 1
    at = np.flatnonzero(of.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(of.sum(axis=0)[at]), pa.array(of[1, at])], ["place", "docs", "toxic"])


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """Per row: the id, the score, ``predicted`` and the places ``start:end`` of offending sentences, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # DIM + 1 floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer.score(t.as_py() or "") for t in b.column(1)]
            values = np.array([v for v, _ in got])
            where = [",".join(f"{s}:{e}" for s, e, p in out if p >= offending) for _, out in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32)), pa.array(where, pa.string())], ["doc_id", "score", "predicted", "offending"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, predicted int, offending string")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", "predicted", "offending")
