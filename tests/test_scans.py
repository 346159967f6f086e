"""Scans in blocks against pandas and numpy: few large groups, ties across block edges, repeated rows, empty tables; no window by the key alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import research, scans


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    n = 3000
    g = rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05])
    v = np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 40, n).astype(float))  # one value holds nearly half, across many blocks
    return pd.DataFrame({"g": g, "i": np.arange(n), "v": v, "w": rng.normal(size=n), "day": rng.integers(0, 400, n)})


@pytest.fixture(autouse=True)
def many_blocks(spark):
    """Small tables keep their blocks apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def taken(df, *order):
    return df.toPandas().sort_values(list(order), ignore_index=True)


def test_average_ranks_with_ties_across_blocks(spark, frame):
    df = spark.createDataFrame(frame).repartition(7)
    got = taken(scans.ranks(df, ["g"], "v"), "i")
    assert np.allclose(got["rank"], frame.groupby("g")["v"].rank())
    assert scans.blocks(df, ["g"], ["v"]).where("g = 'a' and v = 7").select("block").distinct().count() > 1


def test_ranks_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([("a", 1.0)] * 50, "g string, v double")
    assert {r["rank"] for r in scans.ranks(one, ["g"], "v").collect()} == {25.5}
    assert scans.ranks(one.where("false"), ["g"], "v").count() == 0


def test_rank_correlation(spark, frame):
    df = spark.createDataFrame(frame.assign(v=frame["v"].where(frame["i"] % 11 > 0)))
    got = {r.g: (r.ic, r.n) for r in scans.rank_correlation(df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))), "v", "w", ["g"]).collect()}
    for g, x in frame[frame["i"] % 11 > 0].groupby("g"):
        assert got[g] == (pytest.approx(x["v"].rank().corr(x["w"].rank())), len(x))
    flat = spark.createDataFrame([("a", 1.0, float(i)) for i in range(9)], "g string, v double, w double")
    assert scans.rank_correlation(flat, "v", "w", ["g"]).first().ic == 0.0


def test_running_sums_and_maxima(spark, frame):
    df = scans.blocks(spark.createDataFrame(frame).repartition(5), ["g"], ["i"])
    got = taken(scans.running(df, ["g"], ["i"], {"top": F.col("w")}, total=F.col("v"), n=F.lit(1)), "i")
    by = frame.groupby("g")
    assert np.allclose(got["total"], by["v"].cumsum()) and np.allclose(got["top"], by["w"].cummax()) and (got["n"] == by.cumcount() + 1).all()


def test_tiles_are_those_of_ntile(spark, frame):
    df = spark.createDataFrame(frame.head(997)).union(spark.createDataFrame(frame.tail(3)).withColumn("g", F.lit("few")))
    both = scans.tiled(df, ["g"], ["v", "i"], 10, "mine").withColumn("theirs", F.expr("ntile(10) over (partition by g order by v, i)"))
    assert both.where("mine <> theirs").count() == 0 and both.count() == 1000


def test_quantiles(spark, frame):
    at = {"low": 0.0, "q5": 0.05, "mid": 0.5, "q95": 0.95, "high": 1.0}
    got = scans.quantiles(spark.createDataFrame(frame), ["g"], "w", **at).toPandas().set_index("g")
    for g, x in frame.groupby("g"):
        assert np.allclose(got.loc[g, list(at)].astype(float), np.quantile(x["w"], list(at.values())))


def test_trailing_sums_over_days(spark, frame):
    got = taken(scans.trailing(spark.createDataFrame(frame), ["g"], F.col("day"), 30, total=F.col("w"), n=F.lit(1)), "i")
    for k in range(0, len(frame), 37):
        r = frame.iloc[k]
        x = frame[(frame["g"] == r["g"]) & (frame["day"] > r["day"] - 30) & (frame["day"] <= r["day"])]
        assert got.iloc[k]["n"] == len(x) and got.iloc[k]["total"] == pytest.approx(x["w"].sum())


def test_no_window_by_the_key_alone(spark, frame):
    df = spark.createDataFrame(frame)
    plan = scans.ranks(df, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("block#" in x for x in windows)


def test_embargo_and_information_of_few_groups(spark):
    rows = [(f, f"2020-01-{k % 28 + 1:02d}", k, float(k * 7 % 13), float(k * 7 % 13 + f)) for f in (1, 2) for k in range(60)] + [(3, "2020-01-01", k, 1.0, 2.0) for k in range(4)]
    df = spark.createDataFrame(rows, "fold int, date string, symbol int, x double, y double")
    left = research.after_embargo(df, 10, "fold").groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in left} == {1: 50, 2: 50, 3: 4}
    info = {r.fold: r.information for r in research.binned_information(df, "x", "y", 4, "fold").collect()}
    assert info[1] == pytest.approx(np.log(4)) and info[1] == pytest.approx(info[2])
