"""Hard negatives, BPE and the prefix trie: against SQL, brute force and the tokenizers library, on the given tables and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import connection, rows
from tidemark.llm import bpe, negatives, prefixes
from tidemark.llm.entry import ORACLE, QUERIES

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, data, name):
    assert rows(QUERIES[name](spark, data).toArrow()) == rows(connection(data).sql(ORACLE[name]).to_arrow_table())


# --- hard negatives -----------------------------------------------------------------------------------------------------------


def mined(vectors, positives, negatives_, low, high, scale=256):
    """Brute force over (id, vector, label, anchor)."""
    ok = [(i, [math.floor(scale * x) for x in v], label, a) for i, v, label, a in vectors if label is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)]
    first = lambda found, k: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    out = []
    for n, (i, v, label, anchor) in enumerate(ok):
        if not anchor:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, other) for m, (j, w, other, _) in enumerate(ok) if m != n and len(w) == len(v)]
        for p, j, _ in first([s for s in scored if s[2] == label], positives):
            for rank, (score, k, _) in enumerate(first([s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p], negatives_), 1):
                out.append((i, j, rank, k, p, score))
    return sorted(out, key=str)


def found(df, **kw):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted([tuple(r) for r in negatives.hard_negatives(df, F.col("anchor"), "id", "vector", "label", **kw).select(cols).collect()], key=str)


SCHEMA = "id long, vector array<double>, label int, anchor boolean, row long, block string, group int, score double, dim int, scores int, search int"


def test_hard_negatives_in_small_tiles(spark):
    rng = random.Random(3)
    middle = {c: [rng.gauss(0, 0.3) for _ in range(19)] for c in range(3)}
    made = []
    for i in range(200):
        c = rng.choice([0, 0, 1, 2])
        made.append((i, [m + rng.gauss(0, 0.2) for m in middle[c]], c if rng.random() < 0.9 else (c + 1) % 3, i % 6 == 0))
    want = mined(made, 4, 3, 70, 95)
    df = spark.createDataFrame([(*r, 1, "b", 2, 0.5, 7, 0, 0) for r in made], SCHEMA)
    assert want and found(df, positives=4, negatives=3, low=70, high=95, rows_in_tile=23, anchors_in_tile=7) == want
    assert found(df.repartition(5), positives=4, negatives=3, low=70, high=95) == want


def test_hard_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(1, None, 1, True), (2, [1.0, None], 1, True), (3, [nan, 1.0], 1, True), (4, [inf, 1.0], 1, True), (5, [1e308, 1.0], 1, True), (6, [1.0, 1.0], None, True)]
    made = [(10, [1.0, 0.5], 1, True), (10, [1.0, 0.5], 1, True), (11, [1.0, 0.5], 1, False), (12, [1.0, 0.4], 2, None), (12, [1.0, 0.4], 2, False), (None, [1.0, 0.4], 2, True), (13, [], 1, True), (14, [], 1, False), (15, [], 2, False), (16, [0.9], 1, True), (17, [0.8], 1, False), (18, [0.75], 3, False), (19, [1e9, -2e9], 1, True), (20, [3e9, -1e9], 1, False), (21, [2.9e9, -1e9], 2, False), (22, [-1.0, 0.1], 1, True)]
    df = spark.createDataFrame([(*r, None, None, 0, None, 1, 1, 1) for r in odd + made], SCHEMA)
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    want = sorted([(*r[:4], clip(r[4]), clip(r[5])) for r in mined(odd + made, 5, 5, 80, 100)], key=str)
    assert want and found(df) == want
    assert found(df.where("false")) == [] and found(df.where("not anchor")) == []


def test_bounds_hold_and_settle_clustered_vectors():
    rng = np.random.default_rng(1)
    v = np.floor(np.repeat(rng.normal(0, 60, (50, 16)), 4, axis=1) + rng.normal(0, 4, (50, 64)))
    made = negatives.Vectors([x.astype("<i4").tobytes() for x in v], [np.concatenate(negatives._summary(x[None]), axis=1).tobytes() for x in v], 64)
    every, true = np.arange(50), v @ v.T
    for level in range(len(negatives.SEGMENTS)):
        low, high = negatives.bounds(made, every, made, every, level)
        assert (low <= true).all() and (true <= high).all()
    assert np.median(high - low) < 0.05 * np.median(np.outer(made.norm, made.norm))


# --- BPE ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    for text, ids in zip(texts, bpe.bpe(PATH).encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert bpe.bpe(PATH).decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(max_size=30) | st.lists(st.sampled_from(["a", "aa", "b", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "<|endof", "'s", "'", "12", "the", " th", "ing", "　", "日本", "\x1c", "\x85", "!!", "Ġ", "́", "🙂"]), max_size=30).map("".join), max_size=8))
def test_bpe_on_any_text(library, texts):
    same(library, texts)


def test_bpe_on_long_words_and_unlike_ones(library):
    rng = random.Random(2)
    letters = "".join(rng.choice("abcdeth ") for _ in range(20_000))
    same(library, ["a" * 50_000, "ab" * 20_000, letters, letters.replace(" ", ""), "x" * 65 + " " + "y" * 64, "", " ", "\n" * 3000 + "x", "1234567890" * 3000])


def test_every_token_and_both_ways_of_exact_merging(library):
    code = bpe.bpe(PATH)
    words = [bytes(code.text.data[code.text.at[k] : code.text.at[k + 1]]) for k in range(50256)]
    ids, at = code.words(words)
    assert [ids[lo:hi].tolist() for lo, hi in zip(at[:-1], at[1:], strict=True)] == [code.merged(w) for w in words]
    together, word = code.merged_together(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    assert together.tolist() == ids.tolist() and (np.bincount(word) == np.diff(at)).all()
    assert [k for k in range(50256) if at[k + 1] - at[k] == 1] == [k for k in range(50256) if ids[at[k]] == k]


def test_bad_utf8_and_unknown_ids(library):
    code = bpe.bpe(PATH)
    rng = random.Random(4)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert code.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        code.decode(np.array([60_000], np.uint32))
    with pytest.raises(ValueError):
        bpe.Bpe(str(public_tokenizers.path("word_bpe_49k.json")))


def test_memory_of_chunks_is_bounded_and_changes_nothing(library):
    small = bpe.Bpe(PATH, memory=50)
    rng = random.Random(6)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abct") for _ in range(rng.randrange(1, 90))) for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in small.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(small.memory) <= 200


def test_bpe_query(spark, data, library):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_bpe"](spark, data).collect()} == want


def test_bpe_of_odd_rows(spark, library):
    made = [(1, None, None, 1), (1, None, None, 1), (None, "", "x", 2), (2, "one<|endoftext|> two", "x", 3), (3, "w " * 3000 + "x" * 50_000, None, None)]
    df = spark.createDataFrame(made, "doc_id long, text string, ids string, n_tokens int")
    got = bpe.decode(bpe.encode(df, PATH).withColumnRenamed("text", "was"), PATH).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([(i, t or "") for i, t, *_ in made], key=str)
    assert all(r.ids == library.encode(r.was or "", add_special_tokens=False).ids and r.n_tokens in (1, 2, 3, None) for r in got)
    assert len(bpe.round_trip(df, PATH).collect()) == 5
    assert bpe.round_trip(df.where("false"), PATH).count() == 0 and bpe.encode(df.where("false"), PATH).count() == 0


# --- prefix trie --------------------------------------------------------------------------------------------------------------


def grown(turns, head, source):
    """Brute force over (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, n, role, text in turns:
        if c is not None:
            key = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            own[c].append(((n is not None, n or 0, hashlib.sha256(key.encode()).hexdigest()), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {c: own.get(source(c), [])[: head(c)] + v[head(c) :] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in under), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_prefix_trie_of_random_conversations(spark):
    rng = random.Random(8)
    turns = [(c, n, rng.choice(["user", "assistant", None]), rng.choice(["", None, "é", "b", "ab"])) for c in range(-12, 60) for n in range(rng.randrange(1, 9))]
    turns += [(100 + c, n, "user", "the same") for c in range(25) for n in range(4)]  # copies
    turns += [(200, n % 300, "user", f"t{n % 300}") for n in range(600)] + [(203, n, "user", f"t{n // 2}") for n in range(400)]  # long ones, ties and repeated rows
    turns += [(300, None, "a", "x"), (300, None, "a", "y"), (300, 0, None, None), (None, 1, "a", "b"), (-7, 2, "user", "z"), (-7, 2, "user", "z")]
    rng.shuffle(turns)
    df = spark.createDataFrame([(*t, "k", 1, 2) for t in turns], "conv_id long, turn long, role string, text string, block string, depth int, bytes int")
    crc = lambda c: zlib.crc32(str(c).encode()) % 9
    got = prefixes.trie(prefixes.rebuilt(df, F.crc32(F.col("conv_id").cast("string")) % 9, F.col("conv_id") - F.col("conv_id") % 5))
    assert sorted([tuple(r) for r in got.collect()], key=str) == grown(turns, crc, lambda c: c - int(math.fmod(c, 5)))
    assert prefixes.trie(prefixes.rebuilt(df.where("false"), F.lit(2), F.col("conv_id"))).count() == 0


def test_ends_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 7)
    rows_ = [(1, c % 3, 0, 0, 0, c) for c in range(-40, 60)]
    df = spark.createDataFrame(rows_, "depth long, s1 long, s2 long, s3 long, s4 long, conv_id long")
    want = {k: hashlib.sha256(",".join(str(r[5]) for r in rows_ if r[1] == k).encode()).hexdigest() for k in range(3)}
    assert {r.s1: r.ends_sha256 for r in prefixes.ends(df).collect()} == want
