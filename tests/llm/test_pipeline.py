"""The pipeline's stages: near duplicates against brute force, columns of any name, nulls, repeated ids, empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import simhash

STAGES = dict(corpus_pipeline.STAGES)
ODD = "doc_id long, text string, lang string, source string, n_chars long, keep int, copies string, copy int, text_hash string, quality_p double, row int, nth int, id int, h int, class int, rep int, k int, size int, block int"
MORE = (7, "c", 5, "t", 0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def classes(texts):
    """Classes of ids by links of similarity 0.8."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {frozenset(d for d in ids if find(d) == r) for r in set(map(find, ids))}


def found(spark, texts, **more):
    got = {}
    for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **more).collect():
        got.setdefault(r["class"], set()).add(r.doc_id)
    return {frozenset(x) for x in got.values()}


def test_near_duplicates_are_those_of_brute_force(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = classes(texts)
    assert found(spark, texts) == want
    kept = {r.doc_id for r in STAGES["SimHash near-dedup"](spark, spark.read.parquet(f"{data}/documents.parquet"), data).collect()}
    assert kept == {min(x) for x in want}


def test_near_duplicates_in_hot_shards(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=400)
    texts = {}
    for i in range(60):  # copies of one text, a few words changed in each
        t = list(base)
        for at in rng.sample(range(400), 3):
            t[at] = "x" + str(rng.random())
        texts[i] = " ".join(t)
    for i in range(100, 140):  # one common line in texts of their own
        texts[i] = " ".join(rng.choices(words, k=100) + base[:30])
    texts |= {500: "", 501: None, 502: "one two", 503: "One  two", 504: "three four"}
    want = classes(texts)
    real = simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda own, budget: real(own, budget, hot=5))
    assert found(spark, texts) == want


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_with_odd_columns_and_rows(spark, data, name):
    rows = [(1, "a good text of some words " * 9, "en", "s", 1), (1, "another text under the same number " * 9, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id but words here " * 6, "de", "t", 4), (4, "a repeated row " * 20, "en", "t", 5), (4, "a repeated row " * 20, "en", "t", 5)]
    docs = spark.createDataFrame([r + MORE for r in rows], ODD)
    for d in (docs, docs.where("false")):
        out = corpus_pipeline.written(STAGES[name](spark, d, data), "odd")
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= {r + MORE for r in rows}
    if name == "SimHash near-dedup":
        assert sorted((r[0] is None, r[0], r[1]) for r in STAGES[name](spark, docs, data).collect()) == sorted((r[0] is None, r[0], r[1]) for r in [*rows[:3], rows[4], rows[5]])
    if name == "mixing sources to target weights":
        one = docs.where("doc_id = 4").limit(1).withColumn("source", F.lit("only")).unionByName(docs.where("doc_id = 4").limit(1).withColumn("source", F.lit("only")))
        assert STAGES[name](spark, one, data).count() == 2  # a single source: each row once


def test_token_stage_of_odd_rows(spark, data):
    docs = spark.createDataFrame([(1, None) + ("en", "s", 0) + MORE, (None, "x", "en", "s", 0) + MORE], ODD)
    out = STAGES["token-ID output"](spark, docs, data).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in out) == [(False, 1), (True, 2)]
    assert STAGES["token-ID output"](spark, docs.where("false"), data).count() == 0
