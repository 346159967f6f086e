"""Decontamination in a latent space of fewer dimensions than items: found passages against a brute force of its own, and what the space contributes."""

import random
import re

from tidemark.llm import decontaminate


def common(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def planted(seed):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(4, 9))) for _ in range(3000)]
    weights = [1 / (k + 5) for k in range(3000)]
    prose = lambda n: rng.choices(lexicon, weights, k=n)
    items = [prose(rng.randrange(24, 60)) for _ in range(150)]
    docs, truth = [], {}
    for i, item in enumerate(items):
        text = list(item)
        if i % 3 == 1:  # a word in seven goes
            text = [w for w in text if rng.random() > 0.15]
        if i % 3 == 2:  # words come between, and a few are others
            text = [x for w in text for x in ((w, rng.choice(lexicon)) if rng.random() < 0.1 else (w if rng.random() > 0.1 else rng.choice(lexicon),))]
        docs.append((i, " ".join(prose(150) + text + prose(120))))
        truth[i] = i
    docs += [(1000 + k, " ".join(prose(300))) for k in range(300)]
    return items, docs, truth


def test_planted_and_edited_items_are_found_in_a_space_of_half_their_number(spark):
    items, docs, truth = planted(11)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    hits = decontaminate.decontaminate(*frames).collect()
    got = {(r.doc_id, r.item_id) for r in hits}
    want = {(d, i) for d, i in truth.items() if common(items[i], re.findall(r"\w+", dict(docs)[d])[140 : 160 + 2 * len(items[i])]) >= 0.75 * len(items[i])}
    assert len(want) > 120 and len(want & got) >= 0.95 * len(want)
    assert all(common(items[i], dict(docs)[d].split()) >= 0.6 * len(items[i]) for d, i in got)
    assert not any(d >= 1000 for d, _ in got)


def test_the_space_decides(spark):
    items, docs, _ = planted(12)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    runs = {dims: {(r.doc_id, r.item_id): r.cosine for r in decontaminate.decontaminate(*frames, dims=dims).collect()} for dims in (0.05, 0.5, 3.0)}
    both = runs[0.5].keys() & runs[3.0].keys()
    assert max(abs(runs[0.5][k] - runs[3.0][k]) for k in both) > 0.02  # the whole space would give the plain cosine of the block's words
    strict = {k for k, c in runs[0.5].items() if c >= 0.97}
    assert strict != {k for k, c in runs[3.0].items() if c >= 0.97}
