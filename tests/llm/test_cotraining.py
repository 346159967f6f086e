"""Co-training by sums in Spark against the same rounds in a plain loop over rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import quality


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.6, rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        text += (["clear", "reason", "proof", "study"] if good else ["buy", "now!!!!", "CLICK", "HERE"]) * rng.randrange(1, 4) + (["scum", "trash"] if toxic else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text) + ("\n" * (0 if good else 20)), "en" if good == (rng.random() < 0.97) else "xx", f"s{int(good)}{int(toxic)}" if rng.random() < 0.95 else "s"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def matrices(docs, chosen):
    b = pa.RecordBatch.from_arrays([pa.array([d[k] for d in docs]) for k in (1, 2, 3)], names=["text", "lang", "source"])
    return quality.views(len(docs), len(chosen), *quality.features(b, chosen))


def one_step(beta, rows, ridge):
    """A Newton step from rows (x, y, weight), one row after another; the step is bounded to 5 and the bias hardly pulled."""
    d = len(beta)
    grad, curve = np.zeros(d), np.zeros((d, d))
    for x, y, w in rows:
        z = np.append(x.astype(float), 1.0)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(z @ beta)))))
        grad += w * (y - p) * z
        curve += w * p * (1 - p) * np.outer(z, z)
    pull = np.full(d, ridge)
    pull[-1] = 1e-3
    step = np.linalg.solve(curve + np.diag(pull), grad - pull * beta)
    return beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))


def test_rounds_are_those_of_a_plain_loop_and_change_the_views(spark):
    docs, labels = corpus(5, 900)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5)
    known = spark.createDataFrame(labels[:500], "doc_id long, quality int, toxic int")
    args = {"sure": 0.95, "weight": 0.3, "ridge": 2.0, "max_words": 12}
    got = quality.fit(frame, known, rounds=2, steps=2, **args)
    alone = quality.fit(frame, known, rounds=0, **args)
    assert (got.chosen == alone.chosen).all() and len(got.chosen)
    mine, rest = matrices(docs[:500], got.chosen), matrices(docs[500:], got.chosen)
    truth = {"quality": np.array([q for _, q, _ in labels[:500]], float), "toxic": np.array([t for *_, t in labels[:500]], float)}
    views, cuts = {}, {}
    for t, y in truth.items():
        begun, cuts[t] = quality.start(mine, y, 0.95)
        views[t] = list(begun.views)
        for v in (0, 1):  # the views from labels alone stand where no step moves them
            assert np.allclose(one_step(views[t][v], list(zip(mine[v], y, np.ones(500), strict=True)), 2.0), views[t][v], atol=1e-4)
            assert np.allclose(alone.targets[t].views[v], views[t][v], atol=1e-6)
    taught = 0
    for _ in range(2):
        teachers = {t: list(v) for t, v in views.items()}
        for _ in range(2):
            new = {}
            for t, y in truth.items():
                for v in (0, 1):
                    z = rest[1 - v] @ teachers[t][1 - v][:-1].astype(np.float32) + np.float32(teachers[t][1 - v][-1])
                    sure = [np.flatnonzero((z if label else -z) >= cuts[t][1 - v][label]) for label in (0, 1)]
                    rows = list(zip(mine[v], y, np.ones(500), strict=True))
                    if all(len(s) for s in sure):
                        taught += 1
                        for label, s in enumerate(sure):
                            rows += [(rest[v][k], label, 0.3 * min(1.0, (y == label).sum() / len(s))) for k in s]
                    new[t, v] = one_step(views[t][v], rows, 2.0)
            for (t, v), beta in new.items():
                views[t][v] = beta
    assert taught >= 4
    moved = 0.0
    for t in truth:
        for v in (0, 1):
            assert np.allclose(got.targets[t].views[v], views[t][v], atol=1e-3), (t, v)
            moved = max(moved, float(np.abs(got.targets[t].views[v] - alone.targets[t].views[v]).max()))
    assert moved > 0.01


def test_a_labelled_id_of_several_texts_is_always_fitted_by_the_same(spark):
    docs, labels = corpus(6, 200)
    twice = docs + [(i, f"{t} other words", lang, s) for i, t, lang, s in docs[:80]]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fits = []
    for seed in (1, 2):
        rows = list(twice)
        random.Random(seed).shuffle(rows)
        fits.append(quality.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(seed * 3), known, rounds=0))
    assert (fits[0].chosen == fits[1].chosen).all()
    for t in quality.TARGETS:
        for a, b in zip(fits[0].targets[t].views, fits[1].targets[t].views, strict=True):
            assert a == pytest.approx(b, abs=1e-9)
