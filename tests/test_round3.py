"""Findings of round 3: each failed before its change."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import session
from tidemark.functions import ewm, features
from tidemark.operators import drift, quality, research, scans
from tidemark.operators import portfolio as pf
from tidemark.plans import operations
from tidemark.session import written
from tidemark.sources import ingest
from tidemark.streaming import intraday as stream

from .oracle import connection, rows


def tables(spark, data, to, **changed):
    """A folder with the tables of `data`, of which those of `changed` are written anew."""
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if t in changed:
            changed[t].coalesce(1).write.parquet(f"{to}/made/{t}")
            part = next((to / "made" / t).glob("*.parquet"))
            part.rename(to / f"{t}.parquet")
        else:
            (to / f"{t}.parquet").symlink_to(f"{data}/{t}.parquet")
    return str(to)


def same_as_sql(spark, name, folder):
    got = entry.queries()[name](spark, folder).toArrow()
    want = connection(folder).sql(entry.oracle_sql()[name]).to_arrow_table()
    assert rows(got) == rows(want)
    return got


def test_a_changed_row_is_not_lost(spark, data, tmp_path):
    """an event that is both to change and to be lost counts as changed; so does one without a user."""
    e = spark.read.parquet(f"{data}/events.parquet")
    more = e.limit(1).withColumn("event_id", F.lit(3422507).cast("long")).union(e.limit(1).withColumn("event_id", F.lit(5).cast("long")).withColumn("user_id", F.lit(None).cast("long")))
    folder = tables(spark, data, tmp_path, events=e.where("event_id <> 5").union(more))
    got = same_as_sql(spark, "q19_verify_partitions", folder)
    assert {r["event_id"]: r["kind"] for r in got.to_pylist()}[3422507] == "changed"


@pytest.mark.parametrize("name", ["k41_score_decisions", "k41_decision_counts"])
def test_decisions_of_flat_results(spark, data, tmp_path, name):
    """symbols whose results don't vary, are 0 on average, or are of one trade only."""
    sup = spark.read.parquet(f"{data}/supplier.parquet")
    n = sup.count()
    orders = spark.read.parquet(f"{data}/orders.parquet").where(f"o_custkey % {n} > 3")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in orders.schema)
    day = lambda k: datetime(1997, 3, 1 + k)
    # keys that are equal modulo 41 and 23 give equal results and predictions; 3 gives 0.01 (7 * 3 % 41 = 21), 17 gives 0.17, 32 -0.01
    made = [(3 + 41 * 23 * 40 * k, 0, "F", 100.0, day(k), "1-URGENT") for k in range(4)] + [(3, 1, "F", 100.0, day(0), "1-URGENT"), (41 * 120 + 32 + 41, 2, "F", 100.0, day(9), "1-URGENT"), (41 * 120 + 3, 2, "F", 100.0, day(9), "1-URGENT"), (17, 3, "F", 100.0, day(1), "2-HIGH")]
    folder = tables(spark, data, tmp_path, orders=orders.union(spark.createDataFrame(made, kind)))
    same_as_sql(spark, name, folder)


def test_ratio_and_correlation_of_flat_values(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 2.0, 3.0), ("d", 1.0, None)], "g string, x double, y double")
    got = {r.g: r.c for r in df.groupBy("g").agg(pf.correlation("x", "y").alias("c")).collect()}
    assert math.isnan(got["a"]) and math.isnan(got["b"]) and got["c"] == pytest.approx(1.0) and got["d"] is None
    r = spark.range(1).select(pf.ratio(F.lit(1.0), F.lit(0.0)).alias("a"), pf.ratio(F.lit(-1.0), F.lit(0.0)).alias("b"), pf.ratio(F.lit(0.0), F.lit(0.0)).alias("c"), pf.ratio(F.lit(None).cast("double"), F.lit(0.0)).alias("d")).first()
    assert r.a == math.inf and r.b == -math.inf and math.isnan(r.c) and r.d is None


def test_correlations_meet_in_tiles(spark):
    """No row a pair and day; results are those of the pairs' own days, whatever the tiles, also of flat and single pairs."""
    rng = np.random.default_rng(3)
    made = pd.DataFrame([(f"s{k:02d}", datetime(2020, 1, 1 + d).date(), float(rng.normal()) if k else 0.5) for k in range(40) for d in range(28) if rng.random() < (0.6 if k != 1 else 0.04)], columns=["symbol", "date", "r"])
    df = spark.createDataFrame(made, "symbol string, date date, r double")
    wide = made.pivot(index="date", columns="symbol", values="r").sort_index()
    for size in (7, 1024):
        got = pf.correlations(df, size=size)
        table = {(r.a, r.b): r for r in got.collect()}
        for a in wide.columns:
            for b in wide.columns[wide.columns > a]:
                both = wide[[a, b]].dropna()
                if not len(both):
                    assert (a, b) not in table
                    continue
                r = table.pop((a, b))
                assert r.n == len(both)
                c, v = (both[a].corr(both[b]), both[a].cov(both[b])) if len(both) > 1 else (math.nan, math.nan)
                assert (r["corr"] is None) if math.isnan(c) or "s00" in (a, b) else r["corr"] == pytest.approx(c)
                assert (r["cov"] is None) if math.isnan(v) else r["cov"] == pytest.approx(v, abs=1e-12)
        assert not table


def test_tiles_hold_bounded_numbers_of_names(spark):
    """A group of two tiles sees at most their names and a row a name, not a row a pair and day."""
    rows_ = [(k, datetime(2020, 1, 1 + d).date(), float((k * 7 + d * d) % 11)) for k in range(640) for d in range(5)]
    got = pf.correlations(spark.createDataFrame(rows_, "symbol long, date date, r double"), size=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
    assert got.count() == 640 * 639 // 2


def test_drop_correlated_along_a_chain(spark):
    """of a chain of names each of which correlates with the next, every other one stays; edges in either direction, ties to the smaller name."""
    names = spark.createDataFrame([(k, 100.0 - k // 2) for k in range(20)] + [(99, 1.0)], "symbol long, strength double")
    edges = spark.createDataFrame([(k, k + 1, 0.9) if k % 2 else (k + 1, k, -0.9) for k in range(19)] + [(99, 500, 0.9), (0, 19, 0.1)], "a long, b long, corr double")
    assert sorted(r.symbol for r in pf.drop_correlated(names, edges).collect()) == [*range(0, 20, 2), 99]
    assert pf.drop_correlated(names.limit(0), edges).count() == 0


def test_simulated_draws_are_not_rows(spark):
    """draws are the hashes that Spark gives, and no plan makes rows of them."""
    want = [r[0] for r in spark.range(4).select(F.xxhash64(F.col("id"), (F.col("id") - 2).cast("int"), F.lit(7))).collect()]
    seed = np.array([r[0] for r in spark.range(4).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    assert pf._hashed(pf._hashed(seed, np.arange(-2, 2)), 7).view(np.int64).tolist() == want
    df = spark.createDataFrame([("A", float(v)) for v in np.random.default_rng(0).normal(size=60)] + [("B", 1.0)], "k string, r double")
    got = pf.simulated_var(df, "k", heavy=True)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.k for r in got.collect()] == ["A"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_keys_are_not_joined_by_the_key(spark):
    """Totals and edges of a few keys are broadcast, as a join by the key would fill one task with each."""
    df = spark.createDataFrame([(k % 2, f"2020-01-{k % 28 + 1:02d}", k, float(k * 7 % 13)) for k in range(90)], "g int, date string, symbol int, v double")
    for got in (scans.tiled(df, ["g"], ["v", "symbol"], 10, "t"), scans.quantiles(df, ["g"], "v", q=0.5), research.after_embargo(df, 10, "g"), drift.histogram_drift(df.select(F.col("g").cast("string").alias("feature"), F.when(F.col("symbol") % 3 > 0, "new").otherwise("reference").alias("side"), F.col("v").alias("x")), 5, 1)):
        assert "strategy=broadcast" in plan_of(got) and got.count()


def test_dates_of_folds_are_read_once(spark):
    """The dates at hand are used; the rows are not read again for them."""
    df = spark.createDataFrame([(k, f"2020-01-{d:02d}") for k in range(3) for d in range(1, 21)], "symbol int, date string")
    table = research.fold_table(20, 2, 5)
    want, got = research.with_folds(df, table), research.with_folds(df, table, df.where("symbol = 0").select("date"))
    assert sorted(want.collect()) == sorted(got.collect())


def test_rank_correlations_of_series_that_share_values(spark):
    """a series that begins like another one uses its ranks; all series are those of pandas."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, 90).astype(float), {5: rng.normal(size=90), 20: rng.integers(0, 5, 90).astype(float)}
    made = [(f, h, "A", datetime(2020, 1, 1).date() + timedelta(days=i), float(x[i] if f == "p" else -x[i]), float(y[h][i])) for f in ("p", "q") for h in (5, 20) for i in range(90 if h == 5 else 75)] + [("p", 5, "B", datetime(2020, 1, 1).date(), 1.0, 1.0)]
    got = research.rolling_rank_ic(spark.createDataFrame(made, "feature string, horizon int, symbol string, date date, x double, y double"), 60)
    assert "FlatMapGroupsInArrow" in plan_of(got)
    table = {(r.feature, r.horizon, r.date): r.ic for r in got.collect()}
    assert len(table) == 2 * (30 + 15)
    for (f, h, at), ic in table.items():
        i = (at - datetime(2020, 1, 1).date()).days
        a, b = (pd.Series(v[i - 59 : i + 1]).rank() for v in (x if f == "p" else -x, y[h]))
        assert ic == pytest.approx(a.corr(b))


def test_stops_in_one_pass(spark):
    """statistics read the scanned bars once, and true ranges are averaged beside the bars, alone and without a join."""
    bars_ = spark.createDataFrame([("A", datetime(2020, 1, 1 + d).date(), 9.0 + d % 3, 10.0 + d % 5, 8.0 + d % 4, 1.0 if d % 7 else 0.0) for d in range(28)] + [("B", datetime(2020, 1, 1).date(), 1.0, 1.0, 1.0, 0.0)], "symbol string, date date, close double, high double, low double, signal double").withColumn("adj_close", F.col("close"))
    one = ewm.ewm_features(bars_, ("atr_14d",), ("close", "low", "signal"))
    assert "Join" not in plan_of(one) and one.columns == ["symbol", "date", "close", "low", "signal", "atr_14d"]
    assert [r.atr_14d for r in one.orderBy("symbol", "date").collect()] == [r.atr_14d for r in ewm.ewm_features(bars_).orderBy("symbol", "date").collect()]
    scanned = pf.stop_scan(one.withColumn("stop_level", F.col("close") * 0.95))
    s = pf.stop_statistics(scanned)
    assert "Join" not in plan_of(s)
    events = pf.stop_exits(scanned).toPandas()
    r = {x.symbol: x for x in s.collect()}
    assert (r["A"].n_stops, r["B"].n_stops, r["B"].mean_pnl) == (len(events), 0, 0.0) and len(events) > 0
    assert r["A"].sum_pnl == pytest.approx(events["pnl"].sum()) and r["A"].mean_pnl == pytest.approx(events["pnl"].mean())


def test_landed_files_are_numbered_in_blocks(spark, data, monkeypatch):
    """no window over all events in one task tells the six files apart."""
    seen = []
    kept = operations.written
    monkeypatch.setattr(operations, "written", lambda df, name: (seen.append((name, plan_of(df))), kept(df, name))[1])
    operations.QUERIES["t10_stream_silences"](spark, data)
    plan = dict(seen)["landed"]
    assert "row_number" not in plan and "block" in plan


def test_exchanges_follow_the_size_of_the_input(spark, data, tmp_path):
    """tasks of the as-of join's and the ranks' exchange are as many as the files' size asks for, not a fixed number."""
    df = spark.range(300000).select(F.col("id").alias("k"), F.rand(1).alias("v"), F.current_date().alias("at"))
    df.write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    few = spark.sparkContext.defaultParallelism
    assert session.tasks(t) == few and session.tasks(t, 1) == few and session.tasks(t.union(t), 0.01) > few
    for name in ("p02_facts_for_all_dates", "p03_quarterly_series", "r04_r05_composite_ranks"):
        assert "RepartitionByExpression" in plan_of(entry.queries()[name](spark, data))


def test_bars_and_actions_have_tasks_by_size(spark, data, monkeypatch):
    """a task of the bars, of the actions and of their anti join gets a bounded part of the files."""
    from tidemark.sources import views

    monkeypatch.setattr(views, "tasks", lambda df, mb=8: 23)
    monkeypatch.setattr(quality, "tasks", lambda df, mb=8: 23)
    bars_, actions_ = views.bars(spark, data), views.actions(spark, data)
    assert bars_.rdd.getNumPartitions() == 23 and actions_.rdd.getNumPartitions() == 23
    plan = quality.price_anomalies(bars_, actions_)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count(", 23), REPARTITION_BY_NUM") == 3  # bars, moves, actions: none of a fixed number


def test_store_statistics_keep_a_date_once(spark):
    """no second grouping by date for distinct ones; several rows a day, missing dates and keys count as before."""
    at = datetime(2020, 1, 1).date()
    df = spark.createDataFrame([("a", at), ("a", at), ("a", None), ("b", at + timedelta(days=1)), ("c", None), (None, at)], "symbol string, date date")
    got = ingest.store_stats(df, "date", "symbol")
    assert "distinct" not in plan_of(got)
    assert sorted((str(r.symbol), r.n_rows, r.n_dates, str(r.first_date), str(r.last_date)) for r in got.collect()) == [
        ("None", 1, 1, str(at), str(at)), ("None", 6, 2, str(at), str(at + timedelta(days=1))), ("a", 3, 1, str(at), str(at)), ("b", 1, 1, str(at + timedelta(days=1)), str(at + timedelta(days=1))), ("c", 1, 0, "None", "None"),
    ]
    none = ingest.store_stats(df.where("false"), "date", "symbol").collect()
    assert [(r.symbol, r.n_rows, r.n_dates, r.first_date) for r in none] == [(None, 0, 0, None)]


def test_newest_rows_are_those_of_the_windows(spark):
    """features at the newest row without those of all others: equal to the windows and the exponential pass, at short series, gaps, zeros and nulls."""
    rng = np.random.default_rng(5)
    made = []
    for k, n in enumerate([1, 2, 15, 20, 21, 22, 60, 199, 200, 253, 260, 260, 260, 260, 260]):
        for d in range(n):
            p = None if k == 11 and d in (n - 1, n - 5) or k == 12 else 0.0 if k == 13 and d == n - 21 else float(rng.uniform(5, 9))
            made.append((k, datetime(2020, 1, 1).date() + timedelta(days=d + d // 7), p, p and p + 1, p and p - float(rng.random()), None if k == 10 and d == n - 3 else 0 if k == 14 else int(rng.integers(1, 99))))
    df = spark.createDataFrame([(s, at, p, h, low, p, p, v) for s, at, p, h, low, v in made], "symbol long, date date, open double, high double, low double, close double, adj_close double, volume long")
    slow = ("rsi_14d", "adx_14d")
    names = [*features.NEWEST, *slow]
    got = {r.symbol: r for r in features.newest(df, names).collect()}
    last = {r.symbol: r for r in df.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close")).collect()}
    assert {k: (r.last_date, r.close) for k, r in got.items()} == {k: (r.date, r.close) for k, r in last.items()}
    wide = features.window_features(df, list(features.NEWEST)).withColumn("before", F.lag("date").over(features.w()))
    want = {r.symbol: r for r in wide.join(ewm.ewm_features(df, slow), ["symbol", "date"]).withColumn("rn", F.row_number().over(features.w())).groupBy("symbol").agg(F.max_by(F.struct("date", "before", *names), "rn").alias("r")).select("symbol", "r.*").collect()}
    assert {k for k, r in got.items() if r.date} == set(want) == set(range(15)) - {12}
    for k, r in want.items():
        assert (got[k].date, got[k].before) == (r.date, r.before)
        for n in names:
            assert got[k][n] == (None if r[n] is None else pytest.approx(r[n], rel=1e-9, abs=1e-12)), (k, n)


def test_exponential_averages_of_gaps_are_those_of_pandas():
    """the recurrence as pandas has it, bit by bit, with missing and constant values."""
    rng = np.random.default_rng(6)
    x = np.where(rng.random(300) < 0.2, np.nan, rng.normal(size=300))
    for v in (x, np.full(50, 0.1), x[:0], np.array([np.nan, np.nan]), np.nan_to_num(x)):
        for span in (9, 14, 26):
            assert np.array_equal(ewm.ema(v, span), pd.Series(v, dtype=float).ewm(span=span, adjust=False).mean().to_numpy(), equal_nan=True)


def test_state_in_arrays_equals_the_batch_plan(spark):
    """bars of a batch are taken in arrays, across chunks, batches, days, missing and zero values alike, and no missing feature is a row."""
    n = F.col("id")
    number = lambda seed: F.pmod(F.hash(n, F.lit(seed)), F.lit(1000))
    bars_ = spark.range(9600).select(
        F.when(n % 12 > 0, "a").when(n % 24 > 0, "b").otherwise("c").alias("symbol"), (F.lit("2024-03-04 09:30:00").cast("timestamp") + F.make_dt_interval(mins=n.cast("int"))).alias("ts"), n.alias("event_id"),
        F.when((number(1) >= 20) | (n < 9000), F.when(number(2) < 5, 0.0).otherwise(number(3) / 10 - 3)).alias("close"), F.when((n < 3000) | (n > 3900), number(4) % 7).otherwise(F.lit(0)).cast("long").alias("volume"),
    )
    bars_ = written(bars_.withColumn("close", F.when((n := F.col("event_id")) % 997 > 0, F.col("close"))), "bars")
    folder = stream.new_folder(spark, "test")
    for low, high in ((0, 9100), (9100, 9140), (9140, 9600)):
        bars_.where(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
    got = stream.stateful(spark.readStream.schema(bars_.schema).option("maxFilesPerTrigger", 1).parquet(folder)).select("symbol", "ts", "event_id", "feature_name", "value")
    want = stream.features(bars_).unpivot(["symbol", "ts", "event_id"], list(stream.FEATURES), "feature_name", "value").where("value is not null")
    keys = ["symbol", "ts", "event_id", "feature_name"]
    both = got.withColumnRenamed("value", "x").join(want, keys, "full_outer")
    assert both.where("x is null or value is null or isnan(x) or abs(x - value) > 1e-9 * greatest(1, abs(value))").count() == 0
    assert got.count() == want.count() > 50_000 and got.groupBy("feature_name").count().count() == len(stream.FEATURES)
