"""Operators 11 to 13: edge tables, brute force, and what their methods promise."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import CLASHES, LONG, ODD, SCHEMA

from barloom.llm import alignment, bands, bpe, importance, registry, sketch


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in (*CLASHES, "feature", "weight", "before", "block", "pairs", "a", "b", "n_words")}).repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


OPERATORS = {
    "importance": lambda df: importance.resample(df, df),
    "sketch": sketch.near_duplicates,
    "alignment": alignment.alignments,
}
#: Columns that depend on the number of other rows.
OTHERS = {"importance": ("rank", "weight", "score"), "sketch": (), "alignment": ("n_best", "count_sum")}


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_empty_tables_and_long_words(spark, odd, name):
    f = OPERATORS[name]
    once = {r.doc_id: r for r in f(odd).drop(*OTHERS[name]).collect()}
    twice = f(odd.unionByName(odd)).drop(*OTHERS[name]).collect()
    assert len(twice) == 2 * len(once) and all(r == once[r.doc_id] for r in twice)
    assert f(odd.limit(0)).collect() == []
    texts = ["x" * 100_000, "é" * 50_000, "0123456789abcdef" * 4_000, "1." * 30_000 + "@" * 10_000]
    long = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert set(by_id(f(long))) == set(range(len(texts)))


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_without_an_id(spark, name):
    rows = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "other words")], "doc_id long, text string")
    got = OPERATORS[name](rows).collect()
    assert len(got) == 4 and sum(r.doc_id is None for r in got) == 3
    if name == "sketch":
        assert sorted((r.doc_id is None, r.component_id is None, r.kept) for r in got) == [(False, False, True), (True, False, False), (True, False, False), (True, True, True)]


# 11 -----------------------------------------------------------------------------


def test_importance_equals_sql(spark, data, duck):
    rel = duck.sql(importance.ORACLE_SQL)
    assert sorted(map(tuple, importance.op11_importance(spark, data).select(*rel.columns).collect()), key=str) == sorted(rel.fetchall(), key=str)


def plain_words(text):
    return "".join(c.lower() if c.isascii() and c.isalpha() else c if c.isascii() and c.isdigit() or ord(c) > 127 else " " for c in text or "").split(" ")


def brute_importance(docs, target):
    def features(t):
        w = [x for x in plain_words(t) if x]
        return len(w), [*w, *(f"{x} {y}" for x, y in zip(w, w[1:], strict=False))]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    of = {i: features(t) for i, t in docs.items()}
    s, t = Counter(bucket(f) for _, fs in of.values() for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = {}
    for i, (n, fs) in of.items():
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    enough = sorted((i for i, x in out.items() if x[0] >= 20), key=lambda i: (-out[i][3], i))
    for rank, i in enumerate(enough[: 25 * len(enough) // 100], 1):
        out[i][4] = rank
    return out


def test_importance_by_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: rng.choice(["alpha", "Beta", "γ", "d3", "eps-ilon", "x" * 90, "日本", "zeta,eta", "\x1c", "\xa0", "it's"])
    docs = {i: " ".join(word() for _ in range(rng.integers(0, 60))) for i in range(120)} | {500: None, 501: "", 502: " ,;"}
    target = [" ".join(word() for _ in range(30)) for _ in range(5)] + [None]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = by_id(importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string")))
    want = brute_importance(docs, target)
    assert {i: [r.n_words, r.n_features, r.weight, r.score, r["rank"]] for i, r in got.items()} == want
    kept = importance.drawn(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert kept.columns == df.columns and {r.doc_id: r.text for r in kept.collect()} == {i: docs[i] for i, x in want.items() if x[4]}


def test_blocks_of_any_size_count_alike(spark, monkeypatch, odd):
    want = {r.feature: r.n for r in importance.feature_counts(odd).collect()}
    counts = Counter()
    for _, t, *_ in ODD:
        w = [x for x in plain_words(t) if x]
        counts.update([*w, *(f"{x} {y}" for x, y in zip(w, w[1:], strict=False))])
    assert want == counts
    block = importance.Block()
    for _, t, *_ in ODD:
        block.add(pa.array([t], pa.string()))  # a batch each
    got = {s.decode(): n for strings, ns in block.counted(3) for s, n in zip(strings.to_pylist(), ns.tolist(), strict=True)}
    assert {k: n for k, n in got.items() if k.count(" ") < 2} == counts
    assert [(s.to_pylist(), np.bincount(n, minlength=len(s)).tolist()) for s, _, n in block.runs(3)] == [(s.to_pylist(), n.tolist()) for s, n in block.counted(3)]


def test_checksums_of_many_strings():
    strings = pa.array([b"", b"a", b"hello world", b"z" * 63, b"z" * 64, b"z" * 65, "né".encode() * 300])
    assert importance.crc32(strings).tolist() == [zlib.crc32(s.as_py()) for s in strings]
    assert importance.crc32(strings[2:5]).tolist() == [zlib.crc32(s.as_py()) for s in strings[2:5]]


# 12 -----------------------------------------------------------------------------


def test_rounds_fill_every_coordinate():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 300, 5_000, 70_000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        s = sketch.sketch(x)
        rounds = s >> np.uint64(32)
        assert (s != sketch.EMPTY).all() and int(rounds.max()) < 2 * sketch.PLACES
        if n >= 5_000:
            assert int(rounds.max()) <= 1  # large sets need one or two rounds
        assert (sketch.sketch(x[::-1].copy()) == s).all()
    assert (sketch.sketch(np.zeros(0, dtype=np.uint64)) == sketch.EMPTY).all()


def test_a_sketch_by_hand():
    """Each coordinate is the least of (round, u) over the bins of all rounds, however they are dealt to blocks."""
    x = np.array([11, 22, 33], dtype=np.uint64)
    want = [None] * sketch.PLACES
    for i in range(2 * sketch.PLACES):
        h = sketch.mixed(x ^ sketch.ROUNDS[i])
        for v in h.tolist():
            at = (v >> 32) % sketch.PLACES if i < sketch.PLACES else i - sketch.PLACES
            value = i << 32 | v & 0xFFFFFFFF
            want[at] = value if want[at] is None else min(want[at], value)
    assert sketch.sketch(x).tolist() == want


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(4)
    for j in (0.2, 0.5, 0.85):
        errors = []
        for _ in range(150):
            union = np.unique(rng.integers(0, 1 << 63, int(rng.integers(8, 400)), dtype=np.uint64))
            both = round(j * len(union))
            a, b = (np.concatenate([union[:both], union[both + k :: 2]]) for k in (0, 1))
            errors.append(sketch.likeness(sketch.sketch(a), sketch.sketch(b)) - both / len(union))
        assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 1.2 * (j * (1 - j) / sketch.PLACES) ** 0.5


def brute_classes(texts, k=3, percent=85):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[x : x + k]) for x in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("few", [bands.FEW, 1])
def test_sketch_classes_by_brute_force(spark, data, monkeypatch, few):
    """Also with all buckets judged as large ones."""
    monkeypatch.setattr(bands, "FEW", few)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rng, base = np.random.default_rng(6), [f"w{i}" for i in range(100)]
    for i in range(30):  # chains of texts at, above and below the threshold
        w = list(base)
        for at in rng.choice(100, int(rng.integers(0, 5)), replace=False):
            w[at] = f"v{i}-{at}"
        texts[10_000 + i] = " ".join(w)
    texts |= {20_000: None, 20_001: "", 20_002: " \n", 20_003: "One", 20_004: "one", 20_005: "two words", 20_006: "TWO\twords", 20_007: "two words more"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in sketch.near_duplicates(df).collect()} == brute_classes(texts)


def test_links_at_the_threshold(spark):
    """17 of 20 shingles link, 16 of 19 don't."""
    w = [f"w{i}" for i in range(19)]  # 17 shingles
    texts = {1: " ".join(w), 2: " ".join([*w, "x", "y", "z"]), 3: " ".join(["a", *w[1:], "b"])}
    sets = brute_classes(texts)
    got = by_id(sketch.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == sets and sets[2][1] == 1 and sets[3][1] == 3


# 13 -----------------------------------------------------------------------------


class Brute:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe.byte_bpe_path())
        self.a.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_bpe_path())
        letters, names = bpe._bytes_of_letters(), {i: s for s, i in self.a.get_vocab().items()}
        self.a_bytes = lambda i: bytes(letters[c] for c in names[i])

    def b_bytes(self, i):
        p = self.sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode()

    def of(self, text):
        if not text:
            return None
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.sp.encode(text)
        parts = [list(map(f, x)) for f, x in ((self.a_bytes, a), (self.b_bytes, b))]
        if any(b"".join(p) != f" {text}".encode() for p in parts):
            return None
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        (ra, rb), links, j = ([list(zip([0, *e], e, strict=False)) for e in ends]), [], 0
        for i, (lo, hi) in enumerate(ra):
            while rb[j][1] <= lo:
                j += 1
            k = j
            while k < len(rb) and rb[k][0] < hi:
                links.append((a[i], b[k]))
                k += 1
        groups, at = [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            upto = [x.index(e) + 1 for x in ends]
            groups.append("|".join(",".join(map(str, ids[m:n])) for ids, m, n in zip((a, b), at, upto, strict=True)))
            at = upto
        return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def brute_alignments(texts):
    brute = Brute()
    of = {i: brute.of(t) for i, t in texts.items()}
    n = Counter(p for x in of.values() if x for p in set(x[3]))
    most = {}
    for (a, _), c in n.items():
        most[a] = max(c, most.get(a, 0))
    return {i: (*x[:3], len(x[3]), x[4], sum(n[p] == most[p[0]] for p in x[3]), sum(n[p] for p in x[3])) if x else (0, 0, 0, 0, "", 0, 0) for i, x in of.items()}


def aligned_rows(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in df.collect()}


def test_alignment_by_brute_force(spark, data):
    """Also with the counts sent back by shuffle."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60).collect()}
    rng = np.random.default_rng(8)
    alphabet = [*" \n\t  abcde'sltréé日😀\x1c\x00\xa0_<|>019.,ßÉ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'re", "   ", "▁", "ﬁ"]
    texts |= {1_000 + i: "".join(rng.choice(alphabet, rng.integers(0, 40))) for i in range(150)} | {5_000: None, 5_001: "", 5_002: " ", 5_003: LONG[:5_000]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute_alignments(texts)
    assert sum(x[0] > 0 for x in want.values()) > 100
    assert aligned_rows(alignment.alignments(df)) == want
    assert aligned_rows(alignment.alignments(df, few=0)) == want


def test_packed_pairs_come_back():
    rng = np.random.default_rng(9)
    for k in (0, 1, 500):
        codes = np.unique(rng.integers(0, 50_257, k) << 32 | rng.integers(0, 32_000, k))
        n = rng.integers(1, 70_000, len(codes))
        got = alignment.unpacked(alignment.packed(codes, n))
        assert (got[0] == codes).all() and (got[1] == n).all()


def test_other_merge_orders_take_the_exact_codec(tmp_path, monkeypatch):
    """A vocabulary whose ids don't follow its merges is encoded by operator 9's codec, with the library's result."""
    import json

    from tokenizers import Tokenizer

    with open(bpe.byte_bpe_path(), encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    names = sorted((s for s in vocab if len(s) > 1 and s not in {t["content"] for t in spec["added_tokens"]}), key=vocab.get)
    spec["model"]["vocab"] |= {s: vocab[t] for s, t in zip(names, reversed(names), strict=True)} | {}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    ours, theirs = alignment.ByteTokens(str(path)), Tokenizer.from_file(str(path))
    for text in (" some text to encode, twice", " <|", " né 日本 12"):
        assert list(ours.encode(text)) == theirs.encode(text, add_special_tokens=False).ids


def test_all_are_registered():
    assert {"op11_importance", "op12_fast_sketch", "op13_alignment"} <= set(registry.QUERIES) and "op11_importance" in registry.ORACLE_SQL
