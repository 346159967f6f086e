"""Kept sketches, upserts on partitioned files, digests of partitions: what is read and written again, beside what comes out."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, quality, sketches
from tidemark.sources import ingest

D = dt.date


def test_merged_sketches_answer_ranges_within_their_error(spark):
    rng = np.random.default_rng(3)
    rows = [(s, D(2020, 1 + int(m), 5), float(x)) for s in ("a", "b") for m, x in zip(rng.integers(0, 12, 30_000), rng.lognormal(size=30_000), strict=True)]
    df = spark.createDataFrame([*rows, ("a", D(2020, 3, 1), None)], "s string, d date, v double").repartition(9)
    kept = sketches.monthly(df, ["s"], "d", "v")
    assert kept.count() == 24
    got = {r.s: r for r in sketches.with_quantiles(sketches.merged(kept, ["s"], "2020-03-01", "2020-08-01"), q1=0.01, q5=0.05, q50=0.5, q99=0.99).collect()}
    for s in ("a", "b"):
        x = np.array([v for k, d, v in rows if k == s and 3 <= d.month <= 8])
        assert got[s].n == len(x) and got[s].lo == x.min() and got[s].hi == x.max() and got[s].total == pytest.approx(x.sum())
        for name, q in (("q1", 0.01), ("q5", 0.05), ("q50", 0.5), ("q99", 0.99)):
            assert abs((x <= got[s][name]).mean() - q) <= sketches.ERROR
    assert len(kept.first().sketch) < 16_000  # whatever it has seen
    assert sketches.merged(kept.where("false"), ["s"]).count() == 0


def test_drift_from_sketches(spark):
    rng = np.random.default_rng(4)
    rows = [("f", "reference", float(x)) for x in rng.normal(0, 1, 20_000)] + [("f", "new", float(x)) for x in rng.normal(0.7, 1.3, 15_000)]
    df = spark.createDataFrame(rows, "feature string, side string, x double")
    side = lambda k: sketches.merged(sketches.monthly(df.where(F.col("side") == k).withColumn("d", F.lit("2020-01-01").cast("date")), ["feature"], "d", "x", 1000), ["feature"], k=1000)
    got = sketches.drift(side("reference"), side("new"), ["feature"]).first()
    true = drift.histogram_drift(df, 10).first()
    assert (got.n_ref, got.n_new) == (20_000, 15_000) and got.psi == pytest.approx(true.psi, abs=0.03) and true.psi > 0.3


def stamps(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_upsert_leaves_other_partitions_as_they_are(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/store"
    row = lambda s, y, v: (s, D(y, 3, 1), float(v), y)
    frame = lambda *r: spark.createDataFrame(list(r), "symbol string, date date, close double, year int")
    assert sorted(ingest.upsert_files(frame(row("a", 2001, 1), row("a", 2002, 2), row("b", 2002, 3), row("c", 2003, 4)), f"file://{folder}", ["symbol", "date"], "year")) == [2001, 2002, 2003]
    before = stamps(folder)
    assert ingest.upsert_files(frame(row("b", 2002, 30), row("b", 2002, 31), row("d", 2002, 5)), f"file://{folder}", ["symbol", "date"], "year", seq="close") == [2002]
    after = stamps(folder)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("year=")[1][:4] for f in same} == {"2001", "2003"} and {f.split("year=")[1][:4] for f in set(after) - same} == {"2002"}
    got = {(r.symbol, r.year): r.close for r in spark.read.parquet(f"file://{folder}").collect()}
    assert got == {("a", 2001): 1, ("a", 2002): 2, ("b", 2002): 31, ("c", 2003): 4, ("d", 2002): 5}
    assert ingest.upsert_files(frame(row("a", 2001, 1)).where("false"), f"file://{folder}", ["symbol", "date"], "year") == [] and stamps(folder) == after
    ingest.upsert_files(frame(row("e", 2004, 9)).withColumn("extra", F.lit("x")), f"file://{folder}", ["symbol", "date"], "year")
    assert spark.read.option("mergeSchema", True).parquet(f"file://{folder}").where("extra = 'x'").count() == 1


def test_digests_find_a_changed_row_and_read_its_partition_only(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    rows = [(i // 10, i, i % 7) for i in range(100)]
    stores = []
    for name, changes in (("left", {}), ("right", {35: 99})):
        df = spark.createDataFrame([(p, k, changes.get(k, v)) for p, k, v in rows if not (name == "right" and k == 71)], "p int, k int, v int")
        quality.provenance_hash(df, ["k", "v"]).select("p", "k", "hash").repartition(3).write.partitionBy("p").parquet(f"file://{top}/{name}")
        stores.append(spark.read.parquet(f"file://{top}/{name}"))
    digests = [quality.partition_digests(s, "p") for s in stores]
    got = quality.differing(*stores, *digests, "p", "k")
    assert {(r.p, r.k, r.kind) for r in got.collect()} == {(3, 35, "changed"), (7, 71, "left")}
    read = {f.split("/p=")[1].split("/")[0] for f in got.inputFiles()}
    assert read <= {str(p) for p in range(10)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [p#") >= 2 and "IN (3,7)" in plan.replace("INSET 3, 7", "IN (3,7)").replace("p IN (3,7)", "IN (3,7)")
    assert quality.differing(stores[0], stores[0], digests[0], digests[0], "p", "k").count() == 0
