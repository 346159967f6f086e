"""The corpus queries against brute force on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing, simhash, tokens, warc
from tidemark.llm.entry import QUERIES


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_substrings(spark, data, texts):
    seen, want = set(), {}
    for d in sorted(texts):
        w = texts[d].encode().split()
        cover = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                cover[i : i + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(x for x, c in zip(w, cover, strict=True) if not c)
        want[d] = (len(w), sum(cover), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op2_automata"](spark, data).collect()}
    assert got == want


def test_simhash(spark, data, texts):
    fp = {d: simhash.fingerprint(t.encode()) for d, t in texts.items()}
    root = {d: d for d in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                low = min(root[a], root[b])
                if (fp[a] ^ fp[b]).bit_count() <= 4 and (root[a] != low or root[b] != low):
                    root[a] = root[b] = low
                    changed = True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, data).collect()}
    assert got == {d: (f"{fp[d]:016x}", root[d]) for d in fp}


def test_minhash(spark, data, texts):
    ids = sorted(texts)
    rows = {r.doc_id: r for r in QUERIES["op3_minhash"](spark, data).collect()}
    assert sorted(rows) == ids
    off, away = [], []
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    for i, d in enumerate(ids):
        a, b = texts[d], texts[ids[(i + 1) % len(ids)]]
        new = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert rows[d].n_chars == len(a) and rows[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        x, y = grams(a), grams(new)
        off.append(rows[d].near_edited - len(x & y) / max(1, len(x | y)))
        z = grams(b)
        away.append(rows[d].near_next - (len(x & z) / len(x | z) if x | z else rows[d].near_next))
    assert abs(sum(off) / len(off)) < 0.01 and max(map(abs, off)) < 0.2
    assert abs(sum(away) / len(away)) < 0.02 and max(map(abs, away)) < 0.2


def test_mix(spark, data, texts):
    rows = QUERIES["op5_cube_mix"](spark, data).collect()
    assert {r.doc_id: r.size for r in rows} == {d: len(t.encode().split()) for d, t in texts.items()}
    assert all(r.taken <= 3 * r.size for r in rows)
    total = {}
    for r in rows:
        s = total.setdefault(r.source, [0, r.target, 0])
        s[0] += r.taken
        s[2] = max(s[2], r.size)
    assert abs(sum(t for _, t, _ in total.values()) - sum(r.size for r in rows)) < 1e-3
    assert all(abs(a - t) <= big for a, t, big in total.values())


def test_targets():
    assert mixing.targets({"a": 10, "b": 1000}, {"a": 5, "b": 1}) == {"a": 30.0, "b": 980.0}


def test_warc(spark, data):
    pages = sorted((r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{data}/pages.parquet").collect())
    first, want = {}, {}
    for p, html in pages:
        f = first.setdefault(html, p)
        want[p] = (len(html), warc.payload_digest(html), "response" if f == p else "revisit", None if f == p else f)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op6_warc"](spark, data).collect()}
    assert got == want


def test_tokens(spark, data, texts):
    import numpy as np

    tok, at = tokens.Encoder(tokens.tokenizer_path()).tok, 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_bitpack"](spark, data).collect()}
    for d in sorted(texts):
        ids = [*tok.encode(texts[d], add_special_tokens=False).ids, 2]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pipeline_stages_take_effect(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    have = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, data), "stage")
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids and ids <= have
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs, have = out, ids


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark, data, texts):
    rows = QUERIES["op1_pii"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in PII)
        assert set(want) <= set(r.spans.split(","))


def test_base_spans_of_random_texts(spark):
    from tidemark.llm import pii

    rng = random.Random(3)
    marks = [*"0123456789" * 2, *"..--  +()@@", "a", "é", "_", "😀", "\n", "4111111111111111", "192.168.0.1", "x@y.zz", "+1 (222) 333-4444", "000255", "256"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(3000)] + ["a." * 1000 + "@", "1." * 1000, "1 " * 1000, "+1" + "-" * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(docs).collect():
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r.base] == base_spans(texts[r.doc_id])


def test_language_model(spark, data, texts):
    tokens_of = {d: [*t.encode().lower().split(), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    words, pairs, triples = Counter(), Counter(), Counter()
    for d, k in tokens_of.items():
        if not held[d]:
            words.update(k)
            pairs.update(zip([0, *k], k))
            triples.update(zip([0, *k], k, k[1:]))
    n, v, docs = sum(words.values()), len(words), sum(not h for h in held.values())
    follow, after = Counter(a for a, _ in pairs), Counter((a, b) for a, b, _ in triples)
    size = lambda c: docs if c == 0 else words[c]
    for r in QUERIES["op9_elias_fano"](spark, data).collect():
        k = tokens_of[r.doc_id]
        p = [(words[w] + 0.1) / (n + 0.1 * (v + 1)) for w in k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(k), sum(words[w] > 0 for w in k), n)
        assert abs(r.base_score - sum(map(math.log10, p))) < 1e-6 * abs(r.base_score)
        full = 0.0
        for i, (w, x) in enumerate(zip(k, p)):
            a = k[i - 1] if i else 0
            if size(a):
                x = max(0, pairs[a, w] - 0.75) / size(a) + 0.75 * follow[a] / size(a) * x
            if i and pairs[u := k[i - 2] if i > 1 else 0, a]:
                x = max(0, triples[u, a, w] - 0.75) / pairs[u, a] + 0.75 * after[u, a] / pairs[u, a] * x
            full += math.log10(x)
        assert abs(r.score - full) < 0.04 * len(k)  # probabilities are quantised in steps of 1/32


def test_decontamination_is_that_of_brute_force(spark, data):
    """Both ways, at 1,000 documents: every item is aligned with every stretch of every document that has half of its words."""
    import numpy as np

    from tidemark.llm.decontaminate import overlaps

    data = data.replace("sf0.001", "sf0.01")
    ids: dict = {}
    coded = lambda t: np.array([ids.setdefault(w, len(ids)) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower())], int)
    items = {b.item_id: coded(b.text) for b in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    own = {i: set(x.tolist()) for i, x in items.items()}
    want = set()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    for r in docs:
        x = coded(r.text)
        have = set(x.tolist())
        for i, item in items.items():
            if own[i] and len(own[i] & have) >= 0.5 * len(own[i]):
                n = 2 * len(item)
                if any(len(own[i] & set(x[at : at + 2 * n].tolist())) >= 0.5 * len(own[i]) and overlaps(item, x[at : at + 2 * n], 0.6, 0.5) for at in range(0, len(x), n)):
                    want.add((r.doc_id, i))
    rows = QUERIES["op10_latent"](spark, data).collect()
    assert len(rows) == len(docs)
    assert want and {(r.doc_id, i) for r in rows for i in r["items"]} == want
    assert all(r.contaminated == bool(r.n_items) for r in rows)


def test_classifier_scores_every_document(spark, data, texts):
    rows = QUERIES["op8_cotraining"](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(0 <= r.quality_p <= 1 and 0 <= r.toxic_p <= 1 for r in rows)
