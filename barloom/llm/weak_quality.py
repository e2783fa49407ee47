"""Operator 2, quality classifier by weak labels.

Heuristic labellers vote good, bad or abstain on each document (one projection of built-in functions).
Expectation-maximisation over the votes estimates, without any given labels, how often each labeller
votes what on good documents and on each kind of bad ones. It needs only how often each *pattern* of votes occurs in the
whole corpus: at most ``3 ** len(LABELLERS)`` rows, whatever the data. The posteriors of the patterns
are the soft labels of a hashed linear scorer, fit on at most ``MAX_FIT`` documents of each side (those
first by a hash of their id), which scores every whole text and generalises over the labellers: it sees
shapes of words, stop words, and grades of stutter, variety and length.

Null texts are empty, and empty texts score as such: low. Equal texts have equal scores; of repeated rows
(same id and text) the fit takes one, and all are scored. A text of any length is one row of a task. Ties of
the hash that picks the sample are taken or left together by the hash. An empty table gives an empty result;
without both sides in the sample the scorer keeps its start, which passes all. Ids may be of any type; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import let, table, words, written
from barloom.llm.quality_rules import STOP_WORDS, measures

DIM = 1 << 16
MAX_FIT = 3_000
#: The fit's documents are chosen among about so many times as many, by a hash.
FIT_FROM = 20
KNOWN = 400_000
EPOCHS = 30
KEEP_FROM = 0.5
ABSTAIN = 2


@dataclass(frozen=True)
class Labeller:
    """Votes bad where ``bad`` holds, else good where ``good`` does, else abstains; both are functions of the measures, columns or numbers."""

    name: str
    bad: Callable
    good: Callable


LABELLERS = (
    Labeller("length", lambda m: m.n_words < 3, lambda m: m.n_words >= 20),
    Labeller("symbols", lambda m: 100 * m.n_symbols > 5 * m.word_chars, lambda m: 200 * m.n_symbols < m.word_chars),
    Labeller("stop_words", lambda m: (m.n_words >= 20) & (100 * m.n_stop_words < m.n_words), lambda m: 100 * m.n_stop_words > 5 * m.n_words),
    Labeller("stutter", lambda m: (m.n_words >= 10) & (100 * m.n_stutter > 30 * m.n_words), lambda m: 100 * m.n_stutter < 10 * m.n_words),
    Labeller("lines", lambda m: (m.n_lines >= 4) & (10 * m.n_dup_lines > 5 * m.n_lines), lambda m: (m.n_lines >= 4) & (m.n_dup_lines == 0)),
    Labeller("capitals", lambda m: (m.n_words >= 10) & (100 * m.n_capitals > 50 * m.n_words), lambda m: 100 * m.n_capitals < 10 * m.n_words),
    Labeller("variety", lambda m: (m.n_words >= 50) & (m.n_words > 12 * m.n_distinct), lambda m: (m.n_words >= 50) & (m.n_words < 4 * m.n_distinct)),
    Labeller("word_length", lambda m: (m.word_chars > 15 * m.n_words) | (m.word_chars < 2 * m.n_words), lambda m: (m.word_chars >= 3 * m.n_words) & (m.word_chars <= 10 * m.n_words)),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines")


def votes(text: Column) -> Column:
    """The pattern of the labellers' votes as one integer, base 3: 0 bad, 1 good, 2 abstains."""
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    shorter = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    more = let(
        words(text),
        lambda w: F.struct(
            count(w, lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x))).alias("n_capitals"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            count(F.zip_with(F.slice(w, 1, shorter(w)), F.slice(w, 2, shorter(w)), lambda x, y: x == y), lambda x: x).alias("n_stutter"),
        ),
    )

    def pattern(v: Column) -> Column:
        m = SimpleNamespace(**{n: v["m"][n] for n in MEASURES}, **{n: v["x"][n] for n in ("n_capitals", "n_distinct", "n_stutter")})
        total = F.lit(0)
        for i, labeller in enumerate(LABELLERS):
            total = total + 3**i * F.when(labeller.bad(m), 0).when(labeller.good(m), 1).otherwise(ABSTAIN)
        return total

    return let(F.struct(measures(text, repeats=False).alias("m"), more.alias("x")), pattern)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of good for each pattern, ``rates[class, labeller, vote]`` and the share of good.

    Bad documents are bad in ways that exclude one another, so there is a class of good ones (the first)
    and one of bad ones for each labeller, which starts from the documents that it votes down and is kept
    to it by pseudo-counts. An abstention says nothing about the class: labellers abstain for want of text.
    """
    k = len(LABELLERS)
    v = (patterns[:, None] // 3 ** np.arange(k)) % 3
    down = v == 0
    n_down = down.sum(1, keepdims=True)
    post = np.hstack([np.where(n_down, 0.1, 0.95), np.where(n_down, 0.9 * down / np.maximum(1, n_down), 0.05 / k)])
    one_hot = np.eye(3)[v][:, :, :2]
    prior = np.ones((k + 1, k, 2))
    prior[0] = [1.0, 20.0]
    prior[1 + np.arange(k), np.arange(k)] = [20.0, 1.0]
    start = np.append(8.0, np.full(k, 0.2))
    share, rates = np.zeros(k + 1), prior
    for _ in range(rounds):
        weight = post * counts[:, None]
        got = np.einsum("pc,plv->clv", weight, one_hot) + prior
        rates = got / got.sum(2, keepdims=True)
        share = (weight.sum(0) + start) / (counts.sum() + start.sum())
        log = np.einsum("plv,clv->pc", one_hot, np.log(rates)) + np.log(share)
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post[:, 0], rates, float(share[0])


_AGAIN = re.compile(r"(.)\1+", re.S)
_SHAPE = (re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+"))
_STOP = frozenset(STOP_WORDS)


#: Words of more letters also count by the grade of their length.
LONG_WORD = 24


def shape(word: str) -> str:
    """``Abc,`` is ``Aa,``; digits are 0; other characters count once in a row. The whole word is read."""
    s = _SHAPE[0].sub(lambda m: "Aa" if m[0][0].isupper() and not m[0].isupper() else "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    s = _SHAPE[1].sub("0", s)
    return _AGAIN.sub(r"\1", s)


def _place(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % DIM


class Features:
    """Hashed features of a whole text; remembers words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _of(self, w: str) -> int:
        p = self.known.get(w)
        if p is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            low = w.lower()
            p = self.known[w] = _place("s:" + low if low in _STOP else "w:" + shape(w))
        return p

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        w = text.split()
        n = len(w)
        grade = lambda x, k: int(min(k, max(0, np.floor(x))))
        size = grade(np.log2(n + 1), 12)
        if not n:
            return np.array([_place("empty")]), np.ones(1)
        of: Counter = Counter()
        counts = Counter(w)
        for x, c in counts.items():
            of[self._of(x)] += c
            if len(x) > LONG_WORD:
                of[_place(f"long:{min(16, len(x).bit_length())}")] += c
        stutter = sum(map(eq, w, w[1:])) / n
        extra = [_place(f"stutter:{grade(10 * stutter, 10)}"), _place(f"var:{min(size, 9)}:{grade(10 * len(counts) / n, 10)}"), _place(f"size:{size}")]
        places = np.fromiter(of, dtype=np.int64, count=len(of))
        values = np.sqrt(np.fromiter(of.values(), dtype=float, count=len(of)) / n)
        return np.append(places, extra), np.append(values, [1.0] * len(extra))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, share: float, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer of soft labels, by stochastic gradients over the features of texts."""
    w = np.zeros(DIM + 1)
    w[-1] = 2.0
    side = soft >= 0.5
    if not len(soft) or side.all() or not side.any():
        return w
    weight = np.where(side, np.sqrt(share / 2) / side.sum(), np.sqrt((1 - share) / 2) / (~side).sum())
    weight *= len(soft) / weight.sum()
    squares = np.full(DIM + 1, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            pick = order[lo : lo + 32]
            places = np.concatenate([np.append(rows[i][0], DIM) for i in pick])
            d = [weight[i] * (1 / (1 + np.exp(-np.clip(w[rows[i][0]] @ rows[i][1] + w[-1], -30, 30))) - soft[i]) for i in pick]
            values = np.concatenate([e * np.append(rows[i][1], 1.0) for e, i in zip(d, pick, strict=True)])
            used, back = np.unique(places, return_inverse=True)
            g = np.bincount(back, weights=values) / len(pick) + 1e-5 * w[used]
            squares[used] += g * g
            w[used] -= 0.2 * g / np.sqrt(squares[used])
    return w


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit: int = MAX_FIT) -> np.ndarray:
    """Weights of the scorer: votes over all of ``docs``, EM over their patterns, a fit on a bounded sample."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = FIT_FROM * max_fit  # rows whose text is kept for the fit, so that the texts are read once
    n = d.count()
    h = F.xxhash64("doc_id", F.xxhash64("text"))
    kept = F.when(F.pmod(h, F.lit(max(1, n))) < sample, F.coalesce("text", F.lit("")))
    voted = written(d.select(h.alias("h"), votes(F.col("text")).alias("pattern"), kept.alias("text")))
    got = voted.groupBy("pattern").agg(F.count("*").alias("n")).toPandas()  # at most 3 ** len(LABELLERS) rows
    if not len(got):
        return fit([], np.zeros(0), 0.5)
    post, _, share = expectation_maximisation(got["pattern"].to_numpy(), got["n"].to_numpy(dtype=float))
    of = dict(zip(got["pattern"].tolist(), post.tolist(), strict=True))
    good = [p for p, v in of.items() if v >= 0.5]
    rows = []
    for side in (F.col("pattern").isin(good), ~F.col("pattern").isin(good)):
        of_side = voted.filter(side & F.col("text").isNotNull())
        last = of_side.select("h").distinct().orderBy("h").limit(max_fit).agg(F.max("h")).first()[0]
        if last is None:
            continue
        chosen = of_side.filter(F.col("h") <= last).dropDuplicates(["h"])  # at most max_fit rows
        for r in chosen.select("pattern", "text").mapInArrow(_features, "pattern int, places array<int>, values array<double>").toLocalIterator():
            rows.append((np.array(r["places"], dtype=np.int64), np.array(r["values"]), of[r["pattern"]]))
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tolist(), r[1].tolist()))
    return fit([r[:2] for r in rows], np.array([r[2] for r in rows]), share)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only features of the sample's texts go to the driver."""
    f = Features()
    for b in batches:
        got = [f(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("pattern"), pa.array([p.astype(np.int32) for p, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float64()))], ["pattern", "places", "values"])


class Scorer:
    def __init__(self, w: np.ndarray) -> None:
        self.w, self.f = w, Features()

    def __call__(self, text: str) -> float:
        places, values = self.f(text)
        return float(1 / (1 + np.exp(-np.clip(self.w[places] @ values + self.w[-1], -30, 30))))


def scores(spark: SparkSession, weights: np.ndarray):  # noqa: ANN201
    """A function of a text column: the scorer's probability that the text is good."""
    shared = spark.sparkContext.broadcast(weights)  # DIM + 1 floats, whatever the data

    @F.pandas_udf("double")
    def of(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        scorer = Scorer(shared.value)
        return pd.Series([scorer(t or "") for t in texts], dtype=float)

    return of


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the score and whether it is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            s = np.array([scorer(t.as_py() or "") for t in b.column(1)], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= KEEP_FROM)], ["doc_id", "score", "kept"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, kept boolean")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with their columns as they are."""
    of = scores(docs.sparkSession, train(docs, id_col, text_col))
    return docs.filter(of(F.coalesce(F.col(text_col), F.lit(""))) >= KEEP_FROM)


def op2_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))
