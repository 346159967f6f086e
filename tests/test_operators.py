"""Hand-made frames with known answers, helpers against plain loops, and invariants."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ewm, features
from tidemark.operators import asof, drift, portfolio, quality, research
from tidemark.sources import ingest


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def prices(spark, n=300, symbols=("A", "B")):
    rng = np.random.default_rng(42)
    rows = []
    for s in symbols:
        p = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
        rows += [(s, day(i), float(x * 0.99), float(x * 1.02), float(x * 0.98), float(x), float(x), int(rng.integers(5e5, 5e6))) for i, x in enumerate(p)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, adj_close double, volume long")


def test_signals_by_hand(spark):
    df = spark.createDataFrame([(day(0), s, x) for s, x in zip("abcd", (0.05, 0.03, 0.01, None))], "date date, symbol string, p double")
    got = {r.symbol: (r.t, r.k, r.z) for r in df.select("symbol", research.threshold_signal("p", 0.05).alias("t"), research.rank_signal("p", 0.25).alias("k"), research.zscore("p", "date").alias("z")).collect()}
    assert [got[s][0] for s in "abcd"] == [1.0, 0.0, 0.0, 0.0]
    assert sum(v[1] for v in got.values()) == 1.0 and got["a"][1] == 1.0
    z = [got[s][2] for s in "abc"]
    assert abs(np.mean(z)) < 0.01 and abs(np.std(z, ddof=1) - 1) < 0.01 and got["d"][2] is None


def test_percent_rank_is_that_of_pandas(spark):
    x = [3.0, 1.0, 1.0, None, 7.0, 3.0]
    df = spark.createDataFrame([(day(0), i, v) for i, v in enumerate(x)], "date date, i int, x double")
    got = [r.k for r in df.select("i", research.percent_rank(F.col("x"), "date").alias("k")).orderBy("i").collect()]
    want = pd.Series(x).rank(pct=True)
    assert all((a is None and math.isnan(b)) or abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_ranges_and_short_history(spark):
    p = prices(spark)
    f = features.window_features(p, ["williams_r_14d", "mfi_14d", "sma_200d"]).toPandas()
    w, m = f["williams_r_14d"].dropna(), f["mfi_14d"].dropna()
    assert len(w) and w.between(-100, 0).all() and m.between(0, 100).all()
    assert f.groupby("symbol")["sma_200d"].count().eq(101).all()
    long, failed = features.run(p.where("symbol = 'A' or date < date'2024-01-20'"), ["returns_1d"], "2024-01-01", "2024-12-31")
    assert [r.symbol for r in failed.collect()] == ["B"]
    assert {r.symbol for r in long.select("symbol").distinct().collect()} == {"A"}


def test_exponential_averages_are_those_of_pandas(spark):
    p = prices(spark, 120, ("A",))
    got = ewm.ewm_features(p).orderBy("date").toPandas()
    want = ewm.averages(p.withColumnRenamed("close", "p").orderBy("date").toPandas())
    for c in ewm.OUTPUTS:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_rolling_rank_ic_against_pandas(spark):
    rng = np.random.default_rng(0)
    rows = [("f", 5, "A", day(i), float(rng.integers(0, 9)), float(rng.normal())) for i in range(90)]
    df = spark.createDataFrame(rows, "feature string, horizon int, symbol string, date date, x double, y double")
    got = [r.ic for r in research.rolling_rank_ic(df, 60).orderBy("date").collect()]
    x, y = pd.Series([r[4] for r in rows]), pd.Series([r[5] for r in rows])
    want = [x[i - 59 : i + 1].rank().corr(y[i - 59 : i + 1].rank()) for i in range(59, 89)]
    assert np.allclose(got, want)


def test_universe_by_hand(spark):
    rows = [("AAPL", day(0), True), ("MSFT", day(0), True), ("MSFT", day(9), False), ("GOOGL", day(9), True)]
    u = spark.createDataFrame(rows, "symbol string, date date, in_universe boolean")
    assert sorted(r.symbol for r in asof.universe_as_of(u, "2024-01-15").collect()) == ["AAPL", "GOOGL"]
    assert asof.universe_as_of(u, "2023-12-31").count() == 0
    log = spark.createDataFrame([("X", day(0), "ADDED"), ("X", day(5), "ADDED"), ("X", day(5), "REMOVED"), ("Y", day(1), "ADDED")], "symbol string, effective_date date, action string")
    assert [r.symbol for r in asof.members_from_log(log, "2024-02-01").collect()] == ["Y"]


def test_asof_join_carries_the_latest_row(spark):
    facts = spark.createDataFrame([("A", day(0), 1.0, 5.0), ("A", day(10), None, 6.0)], "k string, at date, v double, w double")
    probes = spark.createDataFrame([("A", day(5)), ("A", day(10)), ("A", day(40)), ("B", day(5)), (None, day(5))], "k string, t date")
    got = {(r.k, r.t): (r.v, r.w) for r in asof.asof_join(probes, facts, ["k"], "t", "at", ["v", "w"]).collect()}
    assert got == {("A", day(5)): (1.0, 5.0), ("A", day(10)): (None, 6.0), ("A", day(40)): (None, 6.0), ("B", day(5)): (None, None), (None, day(5)): (None, None)}
    near = asof.asof_join(probes.where("k = 'A'"), facts, ["k"], "t", "at", ["w"], tolerance_days=5).orderBy("t").collect()
    assert [r.w for r in near] == [5.0, 6.0, None]


def test_anomalies_by_hand(spark):
    p = spark.createDataFrame([("UP", day(0), 100.0), ("UP", day(1), 200.0), ("SPLIT", day(0), 100.0), ("SPLIT", day(1), 50.0), ("OK", day(0), 100.0), ("OK", day(1), 102.0)], "symbol string, date date, close double")
    a = spark.createDataFrame([("SPLIT", day(1)), ("SPLIT", day(1))], "symbol string, date date")
    got = quality.price_anomalies(p, a, 0.4).collect()
    assert [(r.symbol, r.severity) for r in got] == [("UP", "critical")]


def test_upsert_and_membership_rules(spark):
    old = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "k string, d int, v double")
    new = spark.createDataFrame([("A", 1, 5.0, 1), ("A", 1, 6.0, 2), ("C", 1, 7.0, 1)], "k string, d int, v double, seq int")
    got = {r.k: r.v for r in ingest.upsert(old, new, ["k", "d"], "seq").collect()}
    assert got == {"A": 6.0, "B": 2.0, "C": 7.0}
    raw = spark.createDataFrame([("2024-01-01", " aapl ", "added"), ("x", "A", "ADDED"), ("2024-01-01", "B", "SPLIT"), (None, None, None)], "effective_date string, symbol string, action string")
    assert [(r.symbol, r.action) for r in ingest.membership_changes(raw).collect()] == [("AAPL", "ADDED")]


def test_strategy_against_itself(spark):
    rng = np.random.default_rng(1)
    x = [(day(i), float(v)) for i, v in enumerate(rng.normal(0, 0.01, 60))]
    r = spark.createDataFrame([("s", d, v) for d, v in x], "k string, date date, r double")
    b = spark.createDataFrame(x, "date date, b double")
    m = portfolio.relative(r, b, "k").first()
    assert abs(m.beta - 1) < 1e-9 and abs(m.alpha) < 1e-9 and m.tracking_error < 1e-9


def test_limits_hold(spark):
    rng = np.random.default_rng(2)
    rows = [(day(0), i, ["Tech", "Bank", None][i % 3], float(w), 1e9) for i, w in enumerate(rng.dirichlet(np.ones(40)) * 2)]
    x = portfolio.limited(spark.createDataFrame(rows, "date date, symbol int, sector string, weight double, value_traded double")).toPandas()
    assert x["w5"].max() <= 0.05 + 1e-9 and x["w5"].sum() <= 1 + 1e-9
    assert x[x.sector == "Tech"]["w5"].sum() <= 0.25 + 1e-9 and x[x.sector.isna()]["w5"].sum() <= 0.10 + 1e-9


def stops_by_loop(lows, levels, on):
    """Stop events by bar: a position opens where none is open and the signal is on; later bars are checked, then the signal."""
    held, out = None, []
    for i, (low, level, sig) in enumerate(zip(lows, levels, on)):
        if held is None:
            if sig:
                held = [i, low]
        else:
            held[1] = max(held[1], low)
            if low <= level:
                out.append((held[0], i, held[1]))
                held = None
            if not sig:
                held = None
    return out


def test_stops_against_a_loop(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for k in range(40):
        lows, levels, on = rng.integers(1, 20, 60).astype(float), rng.integers(1, 20, 60).astype(float), rng.random(60) < 0.7
        rows += [(k, day(i), float(a), float(b), float(s)) for i, (a, b, s) in enumerate(zip(lows, levels, on))]
        want += [(k, day(a), day(b), lows[a], lows[b], top) for a, b, top in stops_by_loop(lows, levels, on)]
    df = spark.createDataFrame(rows, "symbol int, date date, low double, stop_level double, signal double")
    scanned = portfolio.stop_scan(df)
    got = [(r.symbol, r.entry_date, r.exit_date, r.entry_price, r.exit_price, r.trailing_high) for r in portfolio.stop_exits(scanned).collect()]
    assert sorted(got) == sorted(want)
    exits = {(k, b) for k, _, b, *_ in want}
    for r in scanned.collect():
        assert r.signal_after == (0.0 if (r.symbol, r.date) in exits else r.signal)
    stats = {r.symbol: (r.n_stops, r.n_trades) for r in portfolio.stop_statistics(scanned).collect()}
    assert all(stats[k][0] == sum(x[0] == k for x in want) and stats[k][1] >= stats[k][0] for k in range(40))


def test_stop_levels(spark):
    df = spark.createDataFrame([(100.0, 3.0, 0.02)], "close double, atr double, vol20 double")
    assert [df.select(portfolio.stop_level(k)).first()[0] for k in portfolio.STOPS] == [94.0, 95.0, 96.0]


@pytest.mark.parametrize(("t", "n", "p"), [(0.0, 5, 0.5), (2.015048, 5, 0.95), (1.959964, 1_000_000, 0.975), (-1.812461, 10, 0.05), (1.0, 1, 0.75)])
def test_student(spark, t, n, p):
    got = spark.createDataFrame([(t, n)], "t double, n long").select(1 - portfolio.student_tail(F.col("t"), F.col("n"))).first()[0]
    assert abs(got - p) < 1e-5


def test_bootstrap_covers_the_measures_and_agrees(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.1, 1, 400)
    df = spark.createDataFrame([("A", day(i), float(v)) for i, v in enumerate(x)], "k string, date date, r double")
    a, b = portfolio.bootstrap(df, "k").first(), portfolio.bootstrap(df, "k").first()
    assert a == b
    mean, sd = x.mean() * 252, x.std(ddof=1) * 252**0.5
    assert a.mean_low < mean < a.mean_high and a.std_low < sd < a.std_high and a.sharpe_low < mean / sd < a.sharpe_high
    assert abs((a.mean_high - a.mean_low) / (2 * 1.96 * sd * 252**0.5 / 20) - 1) < 0.2


def test_simulated_risk_is_that_of_the_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0.001, 0.02, 500)
    df = spark.createDataFrame([("A", float(v)) for v in x], "k string, r double")
    one, ten = portfolio.simulated_var(df, "k").first(), portfolio.simulated_var(df, "k", days=10).first()
    assert abs(one["var"] / (1.645 * x.std(ddof=1) - x.mean()) - 1) < 0.05 and one.cvar > one["var"]
    assert abs(ten["var"] / (1.645 * x.std(ddof=1) * 10**0.5 - 10 * x.mean()) - 1) < 0.05
    assert one == portfolio.simulated_var(df, "k").first()
    t = rng.standard_t(5, 4000) * 0.01
    heavy = portfolio.simulated_var(spark.createDataFrame([("A", float(v)) for v in t], "k string, r double"), "k", level=0.999, heavy=True).first()
    assert heavy["var"] > 3.5 * t.std(ddof=1)  # a normal has 3.09


def test_exponential_covariance_is_the_debiased_one(spark):
    import pandas as pd

    rng = np.random.default_rng(6)
    x = pd.DataFrame(rng.normal(0, 1, (90, 3)), columns=list("ABC")).mask((rng.random((90, 3)) < 0.2) & [False, True, True])
    rows = [(c, day(i), float(v)) for c in x for i, v in enumerate(x[c]) if v == v]
    got = {(r.a, r.b): r["cov"] for r in portfolio.correlations(spark.createDataFrame(rows, "symbol string, date date, r double"), halflife=20).collect()}
    for (a, b), v in got.items():
        p = x[[a, b]].dropna()
        w = 0.5 ** ((89 - p.index.to_numpy()) / 20)
        d = p - np.average(p, axis=0, weights=w)
        assert abs(v - (w * d[a] * d[b]).sum() / w.sum() * w.sum() ** 2 / (w.sum() ** 2 - (w**2).sum())) < 1e-9
    complete = portfolio.correlations(spark.createDataFrame(rows, "symbol string, date date, r double"), complete=True).collect()
    assert {r.n for r in complete} == {len(x.dropna())}


def test_verdict_of_missing_measures(spark):
    m = spark.createDataFrame([(1.2, 500, 0.1, 0.6, 2.0, 900, -0.02, -0.04), (None,) * 8], "sharpe double, trades long, max_drawdown double, win_rate double, profit_factor double, oos_days int, var double, cvar double")
    a, b = portfolio.validated(m).collect()
    assert a.passed and abs(a.confidence - 1.0) < 1e-9
    assert b.failed == ["sharpe", "trades", "max_drawdown", "win_rate", "profit_factor", "oos_days"] and b.confidence == 0


def test_refitted_predictions(spark):
    rng = np.random.default_rng(7)
    rows = [(s, day(i), float(a), float(b), float(2 * a - b + 1)) for i in range(120) for s in range(4) for a, b in [rng.normal(size=2)]]
    df = spark.createDataFrame(rows, "symbol int, date date, a double, b double, y double")
    got = research.refit_predictions(df, ["a", "b"], "y", 50, 10, 5).collect()
    truth = {(s, d): y for s, d, _, _, y in rows}
    assert len(got) == 4 * 70 and all(abs(r.prediction - truth[r.symbol, r.refit_date]) < 1e-9 for r in got)
    assert all((r.date - r.refit_date).days in range(10) and (r.refit_date - day(0)).days % 10 == 0 for r in got)


def test_snapping_by_running_values(spark):
    cal = spark.createDataFrame([(day(i),) for i in (0, 1, 20)], "date date")
    dates = spark.createDataFrame([(1, day(1)), (2, day(5)), (3, day(14)), (4, None), (5, day(5))], "k int, date date")
    got = {r.k: (r.previous_session, r.next_session) for r in asof.snap(dates, cal).collect()}
    assert got == {1: (day(1), day(1)), 2: (day(1), None), 3: (None, day(20)), 4: (None, None), 5: (day(1), None)}


def test_drop_correlated_is_greedy(spark):
    s = spark.createDataFrame([("A", 4.0), ("B", 3.0), ("C", 2.0), ("D", 1.0)], "symbol string, strength double")
    e = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.9), ("C", "D", 0.9)], "a string, b string, corr double")
    assert sorted(r.symbol for r in portfolio.drop_correlated(s, e).collect()) == ["A", "C"]


def test_dependencies_of_any_depth(spark):
    edges = lambda n: spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(n)], "feature string, input string")
    assert drift.closure(edges(18)).count() == 18 * 19 // 2
    ring = edges(3).union(spark.createDataFrame([("f3", "f0")], "feature string, input string"))
    assert drift.closure(ring).count() == 16
    diamonds = spark.createDataFrame([(f"n{i}", f"{side}{i}") for i in range(4) for side in "ab"] + [(f"{side}{i}", f"n{i + 1}") for i in range(4) for side in "ab"], "feature string, input string")
    assert {r.depth for r in drift.closure(diamonds).where("feature = 'n0' and input = 'n4'").collect()} == {8}
    log = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(60)], "lineage_id long, parent_id long, hypothesis_id long")
    assert drift.event_chain(log, 17).count() == 18


def test_next_event_after(spark):
    probes = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 9, "z"), ("b", 1, "x"), (None, 1, "n"), ("a", None, "t")], "k string, ts int, tag string")
    events = spark.createDataFrame([("a", 5, "p"), ("a", 7, "s"), ("a", 7, "q"), (None, 3, "r"), ("a", None, "u")], "k string, ts int, name string")
    got = {(r.k, r.tag): (r.at, r.name) for r in asof.next_after(probes, events, ["k"], "ts", "ts", {"ts": "at", "name": "name"}).collect()}
    assert got == {("a", "x"): (5, "p"), ("a", "y"): (7, "q"), ("a", "z"): (None, None), ("b", "x"): (None, None), (None, "n"): (None, None), ("a", "t"): (None, None)}
    assert asof.next_after(probes, events.where("false"), ["k"], "ts", "ts", {"ts": "at"}).where("at is null").count() == 6


def test_gate_calibration_has_both_rates(spark):
    kills = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:00", "a"), (3, "2024-01-02 00:00:00", None), (4, "2024-01-01 00:00:00", "a")], "hypothesis_id long, ts string, reason string").withColumn("ts", F.to_timestamp("ts"))
    updates = spark.createDataFrame([(1, "2024-01-01 06:00:00"), (3, "2024-01-02 00:00:00")], "hypothesis_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    passes = spark.createDataFrame([(i, "2024-01-01") for i in (5, 6, 7, 8)], "hypothesis_id long, ts string")
    statuses = spark.createDataFrame([(2, "deployed"), (5, "rejected"), (6, "draft"), (7, "draft")], "hypothesis_id long, status string")
    outcomes = spark.createDataFrame([(6, -0.10), (6, 0.05), (7, -0.01)], "hypothesis_id long, r double")
    got = {(r.side, r.reason): (r.n, r.wrong, r.rate, r.hours) for r in portfolio.gate_calibration(kills, passes, updates, statuses, outcomes).collect()}
    assert got == {("kill", "a"): (3, 2, pytest.approx(2 / 3), 6.0), ("kill", "unknown"): (1, 0, 0.0, None), ("pass", None): (4, 2, 0.5, None)}


def descended(x, y, alpha, ratio, sweeps=200):
    """Coordinate descent on the rows themselves."""
    x, y = x - x.mean(axis=0), y - y.mean()
    b = np.zeros(x.shape[1])
    for _ in range(sweeps):
        for j in range(len(b)):
            rest = y - x @ b + x[:, j] * b[j]
            pull = x[:, j] @ rest / len(y)
            size = x[:, j] @ x[:, j] / len(y) + alpha * (1 - ratio)
            b[j] = np.sign(pull) * max(abs(pull) - alpha * ratio, 0) / size if size else 0
    return b


def test_lasso_and_elastic_net_against_a_loop_over_rows(spark):
    rng = np.random.default_rng(5)
    frames = []
    for fold in (1, 2, 3):
        x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
        x[:, 4] = 3.0 if fold == 3 else x[:, 4]  # doesn't vary
        frames.append(pd.DataFrame(x, columns=list("abcde")).assign(y=x @ [1.0, 0, -0.5, 0, 0.2] + rng.normal(0, 0.3, 200), fold=fold))
    all_ = pd.concat(frames)
    sums = research.cross_products(spark.createDataFrame(all_), list("abcde"), "y", "fold")
    for alpha, ratio in ((0.05, 1.0), (0.3, 1.0), (0.1, 0.5), (0.1, 0.0)):
        for r in research.penalised(sums, alpha, ratio, 300).collect():
            f = all_[all_["fold"] == r.fold]
            want = descended(f[list("abcde")].to_numpy(), f["y"].to_numpy(), alpha, ratio, 300)
            assert np.allclose(r.beta, want, atol=1e-6)
            assert r.intercept == pytest.approx(f["y"].mean() - want @ f[list("abcde")].mean().to_numpy(), abs=1e-6)
    assert sum(b == 0 for r in research.penalised(sums, 0.3, 1.0).collect() for b in r.beta) >= 3
