"""Findings of round 4: each failed before its change."""

from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators import portfolio as pf


def walks(names=300, days=60, seed=4, share=0.7):
    """Rows (symbol, date, r) of names of which a day is at hand with a chance of `share`, and the same as matrices (values, mask) of names x days."""
    rng = np.random.default_rng(seed)
    x, held = rng.normal(size=(names, days)) + rng.normal(size=(names // 6, days)).repeat(6, axis=0), rng.random((names, days)) < share
    return [(int(k), date(2020, 1, 1) + timedelta(int(d)), float(x[k, d])) for k, d in np.argwhere(held)], x, held


def shuffled(spark) -> int:
    """Bytes that the session's stages have shuffled so far."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    nothing = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, nothing, jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("halflife", [None, 20])
def test_series_are_not_sent_once_a_tile(spark, halflife):
    """with many tiles as with few, a series is shuffled once at most; the pairs are all there and right."""
    rows, x, held = walks()
    df, before = spark.createDataFrame(rows, "symbol long, date date, r double"), shuffled(spark)
    got = {(r.a, r.b): r for r in pf.correlations(df, halflife=halflife, size=12).collect()}
    assert 0 < shuffled(spark) - before < 3 * 16 * len(rows)
    assert len(got) == 300 * 299 // 2
    weight = np.ones(60) if halflife is None else 0.5 ** (np.arange(60)[::-1] / halflife)
    for a in range(0, 300, 7):
        for b in range(a + 1, 300, 5):
            r, both = got[a, b], held[a] & held[b]
            w, p, q = weight[both], x[a, both], x[b, both]
            p, q = p - (w * p).sum() / w.sum(), q - (w * q).sum() / w.sum()
            cov = (w * p * q).sum() / (w.sum() - (w * w).sum() / w.sum())
            assert r.n == both.sum() and r["cov"] == pytest.approx(cov, abs=1e-12) and r["corr"] == pytest.approx((w * p * q).sum() / np.sqrt((w * p * p).sum() * (w * q * q).sum()), abs=1e-12)


def greedy(x, held, strength, limit):
    """Names that stay, one at a time from the strongest; ties to the smaller number."""
    kept = []
    for k in sorted(range(len(x)), key=lambda k: (-strength[k], k)):
        near = lambda o: (both := held[k] & held[o]).sum() > 1 and abs(np.corrcoef(x[k, both], x[o, both])[0, 1]) > limit
        if not any(near(o) for o in kept):
            kept.append(k)
    return sorted(kept)


@pytest.mark.parametrize("batch", [16, 8192])
def test_names_are_dropped_without_all_pairs(spark, batch, monkeypatch):
    """what stays is the greedy choice, whatever the batch; names without returns stay; a pair is no row, and no series is shuffled once a tile."""
    rows, x, held = walks(names=90, share=0.9)
    strength = [float(k * 37 % 30) for k in range(90)]
    signals = spark.createDataFrame([(k, v) for k, v in enumerate(strength) if k % 9] + [(500, 1.0)], "symbol long, strength double")
    monkeypatch.setattr(pf, "correlations", None)
    taken = [k for k in range(90) if k % 9]
    want = [taken[k] for k in greedy(x[taken], held[taken], [strength[k] for k in taken], 0.35)]
    df, before = spark.createDataFrame(rows, "symbol long, date date, r double"), shuffled(spark)
    got = pf.uncorrelated(signals, df, 0.35, batch)
    assert sorted(r.symbol for r in got.collect()) == [*want, 500] and 10 < len(want) < 60
    if batch > 90:
        assert shuffled(spark) - before < 3 * 16 * len(rows)
    assert pf.uncorrelated(signals.limit(0), df).count() == 0


def test_the_filter_compares_only_with_names_that_stay(spark, data, monkeypatch):
    """the query has no table of edges."""
    import __spark_entry__ as entry

    def refuse(*_, **__):
        raise AssertionError("all pairs")

    monkeypatch.setattr(pf, "correlations", refuse)
    assert entry.queries()["k23_correlation_filter"](spark, data).count()
