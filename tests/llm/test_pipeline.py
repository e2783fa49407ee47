import numpy as np
import pytest

import corpus_pipeline as P
from barloom.llm import packing, pii, quality_rules, records, registry
from barloom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [("documents", docs)]
    for name, f in P.STAGES:
        docs = written(f(spark, docs, data))
        out.append((name, docs))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_in_order(stages):
    assert [n for n, _ in stages[1:]] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "pii", "best_fit_packing"]
    for _, df in stages[1:-1]:
        assert df.columns == COLUMNS
    sizes = [len(ids(df)) for _, df in stages]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]


def test_rules_take_effect(stages):
    assert ids(stages[1][1]) == {r.doc_id for r in quality_rules.judge(stages[0][1]).filter("kept").collect()}


def test_clean_documents_stay(spark, data, stages):
    good = ids(spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1")) & ids(stages[1][1])
    assert len(good & ids(stages[2][1])) >= 0.97 * len(good)


def similar_roots(texts):
    """The smallest id of each document's class by all pairs with five-word Jaccard >= 0.8 that share a shingle."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root, holders = {i: i for i in texts}, {}
    for i, s in sets.items():
        for g in s or {()}:
            holders.setdefault(g, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_one_of_each_class_stays(stages):
    """By brute force over what the stage got: the stage links texts by Jaccard similarity, not by op1's 2 bits."""
    texts = {r.doc_id: r.text for r in stages[2][1].collect()}
    assert ids(stages[3][1]) == set(similar_roots(texts).values())


def test_no_personal_data_is_left(stages):
    assert ids(stages[4][1]) == ids(stages[3][1])
    for r in stages[4][1].collect():
        assert pii.base_spans(r.text or "") == [] and r.n_chars == len(r.text or "")


def test_every_document_is_packed_whole(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(records.word_bpe_path())
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in stages[4][1].collect()}
    got = {}
    for r in sorted(stages[5][1].collect(), key=lambda r: r.offset):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u2").tolist())
    assert got == want
    fill = stages[5][1].groupBy("bin_id").sum("length").toPandas()["sum(length)"]
    assert fill.max() <= packing.CAPACITY


def test_run_and_registry(spark, data, stages):
    assert P.run(spark, data).count() == stages[-1][1].count()
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_near_copies_go_by_brute_force_jaccard(spark, data):
    """The stage against all pairs of sf0.01 with five-word Jaccard >= 0.8; all lie beyond the trees' 2 bits."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = set(similar_roots(texts).values())
    assert len(want) < len({" ".join((t or "").lower().split()) for t in texts.values()})
    assert ids(P.near_duplicates(spark, docs, data)) == want


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_odd_tables(spark, name):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names, an empty table."""
    from test_operators import CLASHES, ODD, SCHEMA

    stage = dict(P.STAGES)[name]
    odd = spark.createDataFrame([*ODD, ODD[4], (None, None, None, None, None)], SCHEMA).selectExpr("*", *[f"1 as `{c}`" for c in CLASHES])
    out = stage(spark, odd, "")
    if name != P.STAGES[-1][0]:
        assert out.columns == odd.columns
    rows = out.collect()
    assert stage(spark, odd.limit(0), "").count() == 0
    if name == "simhash_near_dedup":
        assert sorted((r.doc_id for r in rows), key=repr) == sorted([1, 4, 5, 7, 8, 9], key=repr)
    if name == "pii":
        assert len(rows) == len(ODD) + 2 and sum(r.text is None for r in rows) == 2
    if name == "best_fit_packing":
        assert {r.doc_id for r in rows} == {r[0] for r in ODD} | {None}
