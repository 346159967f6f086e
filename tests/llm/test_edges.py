"""Nulls, empty and odd texts, repeated rows, empty tables and extra columns: each operator has a defined result."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import decontaminate, ef, lm, minhash, mixing, pii, quality, simhash, substrings, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, a int, words string"
ROWS = [(1, None, None, None, None, "x", 1, ""), (2, "", "en", "s", 0, "x", 1, ""), (3, "one", "en", "s", 3, "x", 1, ""), (3, "one", "en", "s", 3, "x", 1, ""), (None, "two words", None, None, 9, None, None, None), (4, "w " * 3000 + "x" * 50_000, "en", "t", 1, "x", 1, ""), (5, "w " * 3000 + "x" * 50_000, "en", "t", 1, "x", 1, ""), (6, " \t\n\r\x0b\x0c\x1c  é<|endoftext|>  \x85 '　s 12", "en", "t", 1, "x", 1, "")]
DOC_OPS = {
    "pii": lambda d: pii.detect(d),
    "substrings": lambda d: substrings.remove_repeats(d),
    "minhash": lambda d: minhash.fingerprints(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "mix": lambda d: mixing.mix_sources(d),
    "tokens": lambda d: tokens.token_files(d, tokens.tokenizer_path(), 2),
    "lm": lambda d: lm.language_model_scores(d),
}


@pytest.mark.parametrize("name", DOC_OPS)
def test_odd_rows_and_empty_tables(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = DOC_OPS[name](docs).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.doc_id or -1) for r in got) == sorted((r[0] or -1) for r in ROWS)
    same = [tuple(r) for r in got if r.doc_id == 3]
    if name not in ("tokens", "mix"):
        assert same[0] == same[1]
    assert DOC_OPS[name](docs.where("false")).collect() == []


def test_classifier_without_labels_keeps_all(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep for r in quality.score(docs, quality.fit(docs, none)).collect())
    assert quality.score(docs.where("false"), quality.fit(docs.where("false"), none)).count() == 0


def test_classifier_on_held_out_labels(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic, junk = i % 7 == 0, i % 5 == 0
        t = [rng.choice(words) + ("!!" if junk else "") for _ in range(60)] + (["scum", "trash"] if toxic else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t).upper() if junk else " ".join(t), "en", f"s{i % 3}"))
        labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    truth = {i: q == 1 and not t for i, q, t in labels}
    got = quality.score(docs, quality.fit(docs, spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int"))).where("doc_id >= 400").collect()
    assert sum(r.keep == truth[r.doc_id] for r in got) / len(got) > 0.95


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)] + [(9, None), (10, "")]
    noise = lambda n: " ".join(word() for _ in range(n))
    near = items[1][1].split()
    near[3], near[17] = "other", "words"
    docs = [(0, noise(300)), (1, f"{noise(100)} {items[0][1].upper()}. {noise(90)}"), (2, f"{noise(50)} {' '.join(near)} {noise(40)}"), (3, f"{noise(10)} {' '.join(items[2][1].split()[:8])} {noise(20)}"), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((h.doc_id, h.item_id) for h in hits) == [(1, 0), (2, 1)]
    assert decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench.where("false")).count() == 0


def test_bootstrapped_identifiers(spark):
    known = [(i, f"some words here contact mail: user{i}@host{i}.com and more text") for i in range(20)]
    hidden = [(100 + i, f"other text contact mail: user{i}(at)host{i}x5.com and more text") for i in range(5)]
    other = [(200 + i, f"nothing about version 1.{i} of this") for i in range(20)]
    got = {r.doc_id: r.added for r in pii.detect(spark.createDataFrame(known + hidden + other, "doc_id long, text string")).collect()}
    assert all(len(got[100 + i]) == 1 and got[100 + i][0]["kind"] == "email" for i in range(5))
    assert not any(got[d] for d, _ in known + other)


def test_archives_of_odd_pages(spark):
    rows = [(2, "u\r\nX: y", "same", 1), (1, None, "same", 1), (1, None, "same", 1), (None, "n", "same", 1), (5, "e", None, 1), (6, "e", "", 1), (7, "z", "\r\n\r\nWARC/1.1\r\n" * 50, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    got = warc.read_archives(warc.archive(pages)).collect()
    assert len(got) == 7
    assert sorted(r.record_type for r in got if r.payload_bytes == 4) == ["response", "revisit", "revisit", "revisit"]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1, 5}
    assert warc.read_archives(warc.archive(pages.where("false"))).collect() == []


@pytest.mark.parametrize(("n", "u"), [(0, 5), (1, 1), (1, 2), (3, (1 << 64) - 1), (1000, (1 << 64) - 1), (5000, 1 << 44), (3000, 3000), (100_000, 1 << 36)])
def test_elias_fano_queries_on_the_coded_sequence(n, u):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, u, n, dtype=np.uint64) // np.uint64(7 if n == 3000 else 1))
    e = ef.EliasFano(np.frombuffer(b"before!!" + ef.encoded(x, u) + b"rest", np.uint8), 8)
    assert (e.get(np.arange(n)) == x).all() if n else e.n == 0
    q = np.concatenate([x[:500], rng.integers(0, u, 500, dtype=np.uint64)])
    place, hit = e.find(q)
    assert (place == np.searchsorted(x, q)).all() and (hit == np.isin(q, x)).all()


def test_words_of_one_pattern_are_told_apart(spark):
    """Sums over powers of one base modulo 2**64 can't tell a Thue-Morse word of 1,024 letters from its complement."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    train_id, held_id = (next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 10 == 0) == held) for held in (False, True))
    docs = spark.createDataFrame([(train_id, a), (held_id, f"{a} {b}")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.language_model_scores(docs).collect()}
    assert got[held_id].n_known == 2 and got[held_id].n_tokens == 3  # the word seen and the end


def test_contexts_that_lie_in_several_shards(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the"] * 6 + [f"w{rng.randint(0, 400)}"] * 5) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r.score for r in lm.language_model_scores(docs).collect()}
    monkeypatch.setattr(lm, "SHARD", 300)
    cut = {r.doc_id: r.score for r in lm.language_model_scores(docs).collect()}
    model = lm.train(docs.select("text"))
    assert len(model.pairs.paths) > 20 and len(model.pairs.shared)
    assert all(abs(whole[d] - cut[d]) < 1e-6 for d in whole)


def test_bit_packing_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 3, 13, 16, 17, 20, 32):
        ids = rng.integers(0, 1 << bits, 10_001).astype(np.uint32)
        assert (tokens.unpack(tokens.pack(ids, bits), len(ids), bits) == ids).all()


def test_encoder_is_the_library():
    rng = random.Random(1)
    enc = tokens.Encoder(tokens.tokenizer_path(), memory=50)
    marks = [" ", "  ", "\n", " \n", "\t", "a", "B", "é", "'s", " 's", "12", " 3", "!!", ".", " .", " ", "　", "日本", " 日本", "<|endoftext|>", " <|endoftext|>", "\u0085", "\x1c", "😀", "the", " of", "'"]
    for _ in range(3000):
        t = "".join(rng.choices(marks, k=rng.randint(0, 14)))
        assert enc(t) == enc.whole(t)


def test_suffix_automaton_statistics():
    rng = random.Random(2)
    for _ in range(200):
        refs = [[rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(3)]
        sa = substrings.SuffixAutomaton()
        for r in refs:
            sa.add(r)
        q = [rng.choice("abcd") for _ in range(15)]
        known = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [max([n for n in range(1, i + 2) if tuple(q[i - n + 1 : i + 1]) in known], default=0) for i in range(len(q))]
        assert sa.matches(q) == want


def test_trie_join_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    x = np.unique(base[rng.integers(0, 20, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    key = rng.integers(0, 2, len(x))
    a, b = simhash.trie_links(key, x, 4)
    pos = {int(v): i for i, v in enumerate(x)}
    label = simhash._labels(len(x), np.array([pos[int(v)] for v in a], int), np.array([pos[int(v)] for v in b], int))
    i, j = np.nonzero((np.bitwise_count(x[:, None] ^ x[None, :]) <= 4) & (key[:, None] == key[None, :]))
    assert (label == simhash._labels(len(x), i, j)).all()


def test_a_long_benchmark_item_hides_no_short_one(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    items = [(i, say(20 + i)) for i in range(20)] + [(99, say(500))]
    docs = [(i, f"{say(600)} {t} {say(600)}") for i, t in items]
    hits = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((h.doc_id, h.item_id) for h in hits) == [(i, i) for i, _ in items]


@pytest.mark.parametrize("n", [1_009, 2_000])
def test_decontamination_by_a_large_benchmark(spark, n):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(4000)]
    say = lambda k: " ".join(rng.choices(vocab, k=k))
    items = [(i, say(20)) for i in range(n)]
    docs = [(i, f"{say(30)} {t} {say(30)}") for i, t in items]
    hits = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(i, i) for i, _ in items} == {(h.doc_id, h.item_id) for h in hits}


@pytest.mark.parametrize("size", [40, 600])
def test_edited_benchmark_items_in_corpora_of_several_sizes(spark, size):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(500)]
    rare, common = words[:300], words[300:]
    say = lambda k: [rng.choice(rare if rng.random() < 0.11 else common) for _ in range(k)]
    items = [rng.sample(rare, 17) for _ in range(30)]
    docs = [(100 + i, " ".join(say(1000))) for i in range(size)]
    for i, t in enumerate(items):
        t = list(t)
        for at in rng.sample(range(12), 5):
            t[at] = rng.choice(common)
        docs.append((i, " ".join(say(100) + t + say(100))))
    hits = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    assert {(h.doc_id, h.item_id) for h in hits} == {(i, i) for i in range(30)}


def test_masked_identifiers_come_back(spark, data):
    """Of a whole table with identifiers in wordings that recur, half are spelt so that no base pattern finds them: the rounds find these, and no other tokens."""
    rng = random.Random(12)
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    ways = [("write to me at {} for details", lambda i: f"user{i}@host{i % 50}.example.org", lambda i: f"user{i}(at)host{i % 50}.example.org"), ("please call the office under {} before noon", lambda i: f"+1 (555) 01{i % 90 + 10}-{1000 + i}", lambda i: f"(555) 01{i % 90 + 10}-{1000 + i}")]
    docs, masked = [], {}
    for i, text in enumerate(texts * 2):
        words = text.split(" ")
        k, hide = i % 2, i % 4 >= 2
        say, plain, hidden = ways[k]
        at = rng.randrange(len(words) + 1)
        one = (hidden if hide else plain)(i)
        line = say.format(one)
        before = " ".join(words[:at])
        docs.append((i, f"{before} {line} {' '.join(words[at:])} version 2.{i} of {rng.randint(1, 10**6)} pieces"))
        if hide:
            begin = len(before) + 1 + line.index(one)
            masked[i] = (("email", "phone")[k], begin, begin + len(one))
    got = {r.doc_id: {(x["kind"], x["start"], x["end"]) for x in r.added} for r in pii.detect(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    back = sum(any(kind == k and s < end and e > begin for k, s, e in got[i]) for i, (kind, begin, end) in masked.items())
    wrong = sum(1 for i, found in got.items() for k, s, e in found if i not in masked or not (s < masked[i][2] and e > masked[i][1]))
    assert back >= 0.95 * len(masked) and wrong <= 0.02 * len(docs)


@pytest.mark.parametrize("name", [*DOC_OPS, "decontaminate", "similar", "quality"])
def test_a_text_of_megabytes(spark, name):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choices(words, k=600_000))
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, "x" * 3_000_000, "en", "s"), (3, "short text", "en", "t")], "doc_id long, text string, lang string, source string")
    if name == "decontaminate":
        item = " ".join(long.split(" ")[300_000:300_025])
        hits = decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
        assert [(h.doc_id, h.item_id) for h in hits] == [(1, 7)]
    elif name == "similar":
        assert len({r["class"] for r in simhash.similar_documents(docs).collect()}) == 3
    elif name == "quality":
        none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        assert quality.score(docs, quality.fit(docs, none)).count() == 3
    else:
        assert len(DOC_OPS[name](docs).collect()) == 3


def test_scores_replace_columns_of_their_names(spark):
    rows = [(i, f"word{i % 5} text here", "en", "s", 5, 0.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep int, quality_p double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert dict(quality.score(docs, model).dtypes)["keep"] == "boolean"
    assert quality.kept(docs, model).columns == docs.columns
