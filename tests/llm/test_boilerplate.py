"""Near-duplicate classes where all documents share most of their words, so that every pair is a candidate and caps on candidates would lose links."""

import random

import pytest

from tidemark.llm import simhash


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def grams(text):
    t = text.split()
    return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}


def likeness(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def made(n, seed):
    """Pairs of likeness 0.8 and more behind 300 common words, 0.61 across pairs."""
    rng = random.Random(seed)
    common, out = words(rng, 300), []
    for i in range(0, n, 2):
        own = words(rng, 95)
        other, k, at = list(own), rng.randrange(20, 40), rng.randrange(0, 50)
        other[at : at + k] = words(rng, k)
        out += [(i, " ".join(common + own)), (i + 1, " ".join(common + other))]
    return out


@pytest.mark.parametrize("n", [1000, 4000])
def test_no_link_is_lost_among_documents_of_common_words(spark, n):
    rows = made(n, n)
    assert likeness(rows[0][1], rows[2][1]) > 0.58
    got = {r.doc_id: r["class"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [i for i in range(0, n, 2) if likeness(rows[i][1], rows[i + 1][1]) >= 0.8]
    assert len(near) > 0.45 * n and all(got[i] == got[i + 1] for i in near)
    assert len(set(got.values())) == n - len(near)


def test_copies_with_few_changes_and_a_chain_are_one_class_each(spark):
    rng = random.Random(7)
    base = words(rng, 200)
    copies = [(i, " ".join(base[:k] + words(rng, 2) + base[k + 2 :])) for i, k in enumerate(rng.randrange(0, 198) for _ in range(900))]
    chain, text = [], words(rng, 200)
    for i in range(40):
        chain.append((1000 + i, " ".join(text)))
        text = text[3:] + words(rng, 3)
    rows = copies + chain + [(2000, None), (2001, ""), (2002, "one"), (2003, "one"), (None, "one")]
    got = {}
    for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["class"], set()).add(r.doc_id)
    assert sorted(map(len, got.values())) == [2, 3, 40, 900]
