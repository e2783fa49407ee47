"""Operator 10, personal data: patterns, and terms that disclose a protected entity by co-occurrence.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern. What they name are
the protected entities. A term discloses an entity if knowing the term leaves little doubt about it:
over all documents, among the ``n`` distinct contexts of a term (``WINDOW`` words on either side), ``n_e`` hold
the entity it is seen with most (of several, the first by name). ``(n_e + 1) / (n + 2)`` estimates p(entity | term),
and ``-log2 p`` is the doubt that is left, in bits. Terms that leave at most ``DOUBT`` bits are generalised to what kind
of word they are; those leaving at most ``CERTAIN`` bits are removed. Distinct contexts are counted, so copies of a
passage count once.

A rare word or a slip of the pen that stands near an entity is no disclosure. So a term needs ``SUPPORT`` distinct
contexts with the entity, and these must be beyond chance: if its places had nothing to do with the entity, each context
would be near it with a chance of ``N_e / N`` (the contexts near the entity over all words of the corpus), and
``ln C(n, n_e) + n_e ln(N_e / N)`` bounds the logarithm of the chance of so many. As any word may stand near any
entity, ``N`` times the number of entities pairs are tested, and Benjamini and Hochberg's rule on the bounds keeps the expected share
of false terms below ``Q``; the cut is found from counts by hundredths, so the terms aren't gathered for it.

Counts cover all documents. A term that is seen near entities in too many contexts without one is ruled
out by the mentions alone; the contexts of the others are counted over the whole corpus, and a task gives a term
up when it alone has seen too many of its contexts. Up to ``MAX_TERMS`` terms go to the tasks as a table. Beyond
it they go as a bitmap of bounded size, and the words that it lets pass are joined with the table of terms, with
the same result.

Null texts are empty. Equal texts give equal spans. Rows are never dropped, repeated ones neither. A text of any
length is one row of a task, and patterns take linear time. An empty table gives no rows. Ids may be of any
type; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import Bitmap, joined, table, written

KINDS = ("email", "ip", "card", "phone")
WINDOW = 6
DOUBT = 0.6
CERTAIN = 0.2
#: Distinct contexts that a term has with its entity at least, and the share of false terms.
SUPPORT, Q = 3, 0.01
MAX_TERMS = 100_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive and from the first digit only: equal to the plain pattern, but in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W_]{3,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start; each kind leftmost and non-overlapping, failing matches dropped."""
    out = []
    if "@" in text:
        free = 0  # an address starts after the one before
        for m in DOMAIN.finditer(text):
            s = m.start()
            while s > free and text[s - 1] in LOCAL:
                s -= 1
            if s < m.start():
                out.append((0, s, m.end()))
                free = m.end()
    if DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def entity(kind: int, value: str) -> str:
    """One name for all ways to write a value."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _digits(value)}"


def _terms(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Words outside the base spans, lower-cased, with their places."""
    taken = sorted((s, e) for _, s, e in base)
    out, i = [], 0
    reach = 0
    for m in WORD.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reach = max(reach, taken[i][1])
            i += 1
        if m.start() >= reach:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def _context(terms: list[tuple[str, int, int]], i: int) -> int:
    """A hash of the terms around the i-th, itself included."""
    return xxhash.xxh64_intdigest(" ".join([t for t, _, _ in terms[max(0, i - WINDOW) : i + WINDOW + 1]])) - (1 << 63)


def _mentions(text: str) -> Iterator[tuple[str, str, int]]:
    """``(entity, term, context)`` for each term within the window of a base span."""
    base = base_spans(text)
    if not base:
        return
    terms = _terms(text, base)
    starts = [s for _, s, _ in terms]
    for kind, s, e in base:
        at = bisect_left(starts, s)
        name = entity(kind, text[s:e])
        for i in range(max(0, at - WINDOW), min(len(terms), at + WINDOW)):
            yield name, terms[i][0], _context(terms, i)


class _Contexts:
    """Distinct contexts of terms; a term with more than its limit is given up, told by a row without a context.

    ``limits`` is a table of terms, or a bitmap and one limit for all. One task that sees more than the limit
    is enough: the corpus has at least as many.
    """

    HELD = 300_000

    def __init__(self, limits: dict[str, float] | Bitmap, most: float) -> None:
        self.live = dict(limits) if isinstance(limits, dict) else limits
        self.most, self.of, self.n, self.done, self.words = most, {}, 0, set(), 0

    def add(self, text: str) -> None:
        every = WORD.findall(text)
        self.words += len(every)
        words = {w.lower() for w in every}
        wanted = words & self.live.keys() if isinstance(self.live, dict) else {w for w in words if w in self.live and w not in self.done}
        if not wanted:
            return
        terms = _terms(text, base_spans(text))
        for i, (t, _, _) in enumerate(terms):
            if t not in wanted:
                continue
            seen = self.of.setdefault(t, set())
            before = len(seen)
            seen.add(_context(terms, i))
            self.n += len(seen) - before
            if len(seen) > (self.live[t] if isinstance(self.live, dict) else self.most):
                self.n -= len(seen)
                self.of[t] = {None}
                self.done.add(t)
                wanted.discard(t)
                if isinstance(self.live, dict):
                    del self.live[t]

    def rows(self) -> list[tuple[str, int | None]]:
        """All that is held, and the number of words since the last call without a term; terms given up stay so."""
        out = [(None, self.words), *((t, c) for t, seen in self.of.items() for c in seen)]
        self.of, self.n, self.words = {}, 0, 0
        return out


def _flat(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct mentions of each batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple] = set()
            for t in b.column(0):
                found.update(_mentions(t.as_py() or ""))
                if len(found) > 100_000:
                    yield _made(list(found), _MENTION)
                    found = set()
            yield _made(list(found), _MENTION)

    return docs.select(F.col(text_col)).mapInArrow(run, "entity string, term string, context long")


_MENTION = pa.schema([("entity", pa.string()), ("term", pa.string()), ("context", pa.int64())])
_CONTEXT = pa.schema([("term", pa.string()), ("context", pa.int64())])


def _made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _contexts(docs: DataFrame, text_col: str, limits: dict[str, float] | Bitmap, most: float) -> DataFrame:
    """``(term, context)`` of the terms, see :class:`_Contexts`; rows without a term tell numbers of words, all of which make the corpus's."""
    shared = docs.sparkSession.sparkContext.broadcast(limits)  # at most MAX_TERMS terms or MOST_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Contexts(shared.value, most)
        for b in batches:
            for t in b.column(0):
                held.add(t.as_py() or "")
                if held.n > held.HELD:
                    yield _made(held.rows(), _CONTEXT)
        yield _made(held.rows(), _CONTEXT)

    return docs.select(F.col(text_col)).mapInArrow(run, "term string, context long")


def disclosing_terms(docs: DataFrame, text_col: str = "text", doubt: float = DOUBT, max_terms: int = MAX_TERMS, support: int = SUPPORT, q: float = Q) -> DataFrame:
    """``(term, bits)``: the doubt that the term leaves about the entity it discloses most."""
    bits = lambda n_e, n: F.log2(n + 2) - F.log2(n_e + 1)
    limit = lambda n_e: 2.0**doubt * (n_e + 1) - 2
    mentions = written(_flat(docs, text_col).distinct())
    pairs = mentions.groupBy("entity", "term").agg(F.count("*").alias("n_e"))
    # of the entities that a term is seen with most, the first by name: the least of (-count, name)
    first = pairs.groupBy("term").agg(F.min(F.struct((-F.col("n_e")).alias("less"), "entity")).alias("b")).select("term", (-F.col("b.less")).alias("n_e"), F.col("b.entity").alias("entity"))
    near_any = mentions.select("term", "context").distinct().groupBy("term").agg(F.count("*").alias("n"))
    candidates = first.filter(F.col("n_e") >= support).join(near_any, "term").filter(F.col("n") <= limit(F.col("n_e"))).select("term", "n_e", "entity")
    of_entity = written(mentions.groupBy("entity").agg(F.count("*").alias("near")))
    candidates = written(candidates.join(of_entity, "entity").select("term", "n_e", "near"))
    got = candidates.limit(max_terms + 1).collect()
    if not got:
        return candidates.select("term", F.lit(0.0).alias("bits"))
    if len(got) <= max_terms:
        limits: dict[str, float] | Bitmap = {r["term"]: limit(r["n_e"]) for r in got}
        most = 0.0
    else:
        limits, most = Bitmap.of(candidates, "term"), limit(candidates.agg(F.max("n_e")).first()[0])
    seen = written(_contexts(docs, text_col, limits, most))
    words = seen.filter("term is null").agg(F.sum("context")).first()[0]
    seen = seen.filter("term is not null")
    if len(got) > max_terms:
        seen = seen.join(candidates.select("term"), "term", "left_semi")
    of_term = seen.distinct().groupBy("term").agg(F.count("context").alias("n"), F.bool_or(F.col("context").isNull()).alias("many")).filter(~F.col("many"))
    found = candidates.join(of_term, "term").withColumns({"bits": bits(F.col("n_e"), F.col("n")), "chance": log_chance(F.col("n_e"), F.col("n"), F.col("near") / words)})
    found = written(found.filter(F.col("bits") <= doubt).select("term", "bits", "chance"))
    return found.filter(F.col("chance") <= _cut(found, math.log(q) - math.log(words) - math.log(of_entity.count()))).select("term", "bits")


def log_chance(n_e: Column, n: Column, rate: Column) -> Column:
    """A bound of the logarithm of the chance that ``n_e`` or more of ``n`` contexts are near an entity that a share ``rate`` of all is near."""
    part = n_e / n
    choices = F.when(n_e < n, -n * (part * F.log(part) + (1 - part) * F.log(1 - part))).otherwise(F.lit(0.0))
    return F.least(F.lit(0.0), choices + n_e * F.log(rate))


def _cut(found: DataFrame, level: float) -> float:
    """The greatest chance (by hundredths of its logarithm) that Benjamini and Hochberg's rule keeps, where ``level`` is the logarithm of what the least one may be."""
    step = F.ceil(F.col("chance") * 100)
    counts = sorted((r["step"], r["n"]) for r in found.groupBy(F.greatest(step, F.lit(-100_000)).alias("step")).agg(F.count("*").alias("n")).collect())
    kept, n = -math.inf, 0
    for at, of_step in counts:  # 100,000 steps at most
        n += of_step
        if at / 100 <= level + math.log(n):
            kept = at / 100
    return kept


class Terms:
    """The disclosing terms as the tasks get them: a table of ``bits`` of at most ``most`` terms, else a bitmap and, by text, those found."""

    def __init__(self, docs: DataFrame, terms: DataFrame, text_col: str, most: int) -> None:
        got = terms.limit(most + 1).collect()
        self.few = {r["term"]: r["bits"] for r in got} if len(got) <= most else None
        self.shared = docs.sparkSession.sparkContext.broadcast(self.few)
        self.found = None
        self.key, self.column = f"__{uuid.uuid4().hex}", f"__{uuid.uuid4().hex}"
        if self.few is None:
            self.found = written(self._found(docs, terms, text_col))

    def _found(self, docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
        bitmap = docs.sparkSession.sparkContext.broadcast(Bitmap.of(terms, "term"))
        names = (self.key, "term")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            may = bitmap.value
            for b in batches:
                rows = [(k, w) for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for w in {w.lower() for w in WORD.findall(t.as_py() or "")} if w in may]
                columns = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.string()), strict=True)], list(names))

        words = docs.select(self._key(text_col), F.col(text_col)).mapInArrow(run, f"`{self.key}` long, term string")
        words = words.groupBy(*names).agg(F.count("*").alias("n")).join(terms, "term")
        return words.groupBy(self.key).agg(F.max("n").alias("n"), F.collect_list(F.struct("term", "bits")).alias(self.column))

    def _key(self, text_col: str) -> Column:
        return F.xxhash64(F.coalesce(text_col, F.lit(""))).alias(self.key)

    def beside(self, docs: DataFrame, text_col: str) -> DataFrame:
        """``docs`` with a column of the structs ``term, bits`` of those in each text, null where the tasks have the table."""
        if self.found is None:
            return docs.withColumn(self.column, F.lit(None).cast("array<struct<term:string,bits:double>>"))
        packed = docs.select(F.struct("*").alias("row"), self._key(text_col))  # so that no name of ``docs`` clashes
        return joined(packed, self.found, self.key, "left").select("row.*", self.column)

    @staticmethod
    def of(shared, found: list[dict] | None) -> dict[str, float]:  # noqa: ANN001
        """The bits of the terms for one text."""
        return shared.value if shared.value is not None else {x["term"]: x["bits"] for x in (found if found is not None else ())}


def spans_of(text: str, terms: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and the spans of disclosing terms (kind 4) of a text."""
    base = base_spans(text)
    if not terms or terms.keys().isdisjoint([w.lower() for w in WORD.findall(text)]):
        return base, []
    return base, [(len(KINDS), s, e) for t, s, e in _terms(text, base) if t in terms]


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'term')[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_terms: int = MAX_TERMS) -> DataFrame:
    """Per row: the id, counts of each kind, the base's digest and all spans."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    terms = Terms(d, disclosing_terms(d, "text", max_terms=max_terms), "text", max_terms)
    names, shared = ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"), terms.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, found in zip(b.column(1), b.column(2), strict=True):
                base, more = spans_of(t.as_py() or "", Terms.of(shared, found.as_py()))
                n = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(named(base).encode()).hexdigest(), named(base + more)))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], list(names))

    rows = terms.beside(d, "text").select("doc_id", "text", terms.column)
    return rows.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def sanitised_text(text: str, base: list, more: list, bits: dict[str, float]) -> str:
    """Base spans become their kind; disclosing terms become the kind of word they are, or go."""
    cut, at = [], 0
    for k, s, e in sorted(base + more, key=lambda x: (x[1], -x[2])):
        if s < at:
            if e > at:  # overlaps the one before: its rest goes too
                at = e
            continue
        cut.append(text[at:s])
        if k < len(KINDS):
            cut.append(f"[{KINDS[k].upper()}]")
        elif bits[text[s:e].lower()] > CERTAIN:
            w = text[s:e]
            cut.append("[NUMBER]" if any(c.isdigit() for c in w) else "[NAME]" if w[:1].isupper() else "[TERM]")
        at = e
    return "".join([*cut, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", max_terms: int = MAX_TERMS) -> DataFrame:
    """``docs`` with sanitised texts; ``chars_col``, where it exists, is counted anew; null texts stay null."""
    d = docs.select(F.col(text_col).alias("text"))
    terms = Terms(d, disclosing_terms(d, "text", max_terms=max_terms), "text", max_terms)
    shared = terms.shared

    @F.pandas_udf("string")
    def clean(text, found):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(t: str | None, f) -> str | None:  # noqa: ANN001
            bits = Terms.of(shared, f)
            return None if t is None else sanitised_text(t, *spans_of(t, bits), bits)

        return pd.Series([one(t, f) for t, f in zip(text, found, strict=True)], dtype=object)

    out = terms.beside(docs, text_col)
    out = out.withColumn(text_col, clean(F.col(text_col), F.col(terms.column))).drop(terms.column)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(*docs.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def doubt_bits(n_with_entity: int, n: int) -> float:
    """What is left unknown of an entity, in bits, by a term with so many contexts, so many of them with it."""
    return -math.log2((n_with_entity + 1) / (n + 2))
