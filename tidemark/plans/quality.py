"""Queries of data quality and constraints (Q01-Q19)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof
from ..operators import quality as q
from ..session import shared_folder, written
from ..sources import ingest
from ..sources.views import ACTIONS, BARS, FILINGS, LINEAGE, STATEMENTS, SYMBOLS, TRADES, UNIVERSE, actions, bars, filings, lineage, r, read, sql_r, statements, symbols, trades, universe

QUERIES, ORACLE = {}, {}
DAY = "1998-07-15"


def _query(name, sql):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


_MOVES = "m AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS pct FROM bars)"
_Q01 = f"""SELECT 'price_anomaly' AS "check", symbol, date, CASE WHEN abs(pct) > 0.9 THEN 'critical' ELSE 'warning' END AS severity, {sql_r('pct')} AS detail FROM m ANTI JOIN actions USING (symbol, date) WHERE abs(pct) > 0.5"""


@_query("q01_price_anomalies", f"WITH {BARS}, {ACTIONS}, {_MOVES} {_Q01}")
def q01(spark, d):
    return q.price_anomalies(bars(spark, d), actions(spark, d)).withColumn("detail", r("detail"))


@_query("q02_completeness", f"WITH {BARS}, {UNIVERSE} SELECT symbol FROM (SELECT * FROM universe WHERE date <= DATE '{DAY}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) WHERE in_universe AND symbol NOT IN (SELECT symbol FROM bars WHERE date = DATE '{DAY}')")
def q02(spark, d):
    return q.missing_on(asof.universe_as_of(universe(spark, d), DAY), bars(spark, d), DAY)


_GAPS = "sess AS (SELECT DISTINCT date FROM bars WHERE date < (SELECT max(date) FROM bars)), miss AS (SELECT symbol, date FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN sess EXCEPT SELECT symbol, date FROM bars), g AS (SELECT symbol, (SELECT count(*) FROM sess) AS expected, count(*) AS n_missing, list_sort(list(date))[1:5] AS first_missing FROM miss GROUP BY symbol)"


@_query("q03_gaps", f"WITH {BARS}, {_GAPS} SELECT symbol, expected, n_missing, first_missing, CASE WHEN n_missing > 10 THEN 'critical' ELSE 'warning' END AS severity FROM g WHERE expected - n_missing < floor(0.8 * expected)")
def q03(spark, d):
    b = bars(spark, d)
    return q.gaps(b, b.select("date"))


@_query("q04_stale", f"WITH {BARS}, l AS (SELECT s_suppkey AS symbol, max(date) AS last_date FROM supplier LEFT JOIN bars ON symbol = s_suppkey GROUP BY ALL) SELECT symbol, last_date, CAST(DATE '2001-10-20' - last_date AS INTEGER) AS age, CASE WHEN last_date IS NULL OR DATE '2001-10-20' - last_date > 7 THEN 'critical' ELSE 'warning' END AS severity FROM l WHERE last_date IS NULL OR DATE '2001-10-20' - last_date > 3")
def q04(spark, d):
    return q.stale(symbols(spark, d), bars(spark, d), "2001-10-20")


_MEAN = "v AS (SELECT symbol, date, volume, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean FROM bars)"
_Q05 = "SELECT 'volume_anomaly' AS \"check\", symbol, date, CASE WHEN volume = 0 THEN 'warning' ELSE 'info' END AS severity, CAST(volume AS DOUBLE) AS detail FROM v WHERE volume = 0 OR volume > {f} * mean"


@_query("q05_volume_anomalies", f"WITH {BARS}, {_MEAN} " + _Q05.format(f=3))
def q05(spark, d):
    return q.volume_anomalies(bars(spark, d), 3.0)


@_query("q06_row_checks", f"WITH {BARS}, c AS (SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("open", "high", "low", "close", "volume")) + ", count(*) FILTER (close <= 0) AS close_not_positive, count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (close > high OR close < low) AS close_outside_range, count(*) FILTER (volume = 0) AS volume_zero, count(*) FILTER (volume < 0) AS volume_negative FROM bars) SELECT rule, n FROM (UNPIVOT c ON COLUMNS(*) INTO NAME rule VALUE n)")
def q06(spark, d):
    return q.row_checks(bars(spark, d))


@_query("q07_constraints", f"WITH {SYMBOLS}, {FILINGS}, {ACTIONS}, {TRADES} SELECT 'negative_market_cap' AS rule, count(*) FILTER (market_cap < 0) AS n FROM symbols UNION ALL SELECT 'score_out_of_range', count(*) FILTER (score NOT BETWEEN -1 AND 1) FROM filings UNION ALL SELECT 'factor_not_positive', count(*) FILTER (split_to / split_from <= 0) FROM actions UNION ALL SELECT 'status_unknown', count(*) FILTER (status IS NULL OR status NOT IN ('open', 'closed')) FROM trades")
def q07(spark, d):
    out = q.counted(symbols(spark, d), {"negative_market_cap": F.col("market_cap") < 0})
    out = out.union(q.counted(filings(spark, d), {"score_out_of_range": ~F.col("score").between(-1, 1)}))
    out = out.union(q.counted(actions(spark, d), {"factor_not_positive": F.try_divide("split_to", "split_from") <= 0}))
    return out.union(q.counted(trades(spark, d), {"status_unknown": F.col("status").isNull() | ~F.col("status").isin("open", "closed")}))


@_query("q08_orphans", f"WITH {LINEAGE} SELECT 'lineitem_orders' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineage_parent', count(*) FROM lineage WHERE parent_id NOT IN (SELECT lineage_id FROM lineage) UNION ALL SELECT 'labels_documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def q08(spark, d):
    t = lambda n: read(spark, d, n)
    out = q.orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", "lineitem_orders").union(q.orphans(t("orders"), t("customer"), "o_custkey", "c_custkey", "orders_customer"))
    return out.union(q.orphans(lineage(spark, d), lineage(spark, d), "parent_id", "lineage_id", "lineage_parent")).union(q.orphans(t("labels"), t("documents"), "doc_id", "doc_id", "labels_documents"))


@_query("q09_symbol_master", f"WITH {BARS}, {FILINGS}, {TRADES} SELECT DISTINCT symbol FROM (SELECT symbol FROM bars UNION SELECT symbol FROM filings UNION SELECT symbol FROM trades) WHERE symbol NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def q09(spark, d):
    return q.symbol_master(bars(spark, d), filings(spark, d), trades(spark, d), existing=symbols(spark, d).where("market_cap > 0"))


@_query("q10_readiness", f"WITH {BARS}, x AS (SELECT *, CASE WHEN volume % 8 <> 0 THEN close END AS c FROM bars) SELECT symbol, count(*) AS n_rows, count(*) - count(c) AS n_null, count(*) >= 530 AS ready, count(*) - count(c) > 0.1 * count(*) AS null_warning FROM x GROUP BY symbol")
def q10(spark, d):
    return q.readiness(bars(spark, d).withColumn("close", F.when(F.col("volume") % 8 != 0, F.col("close"))), 530)


@_query("q11_missing_metrics", f"WITH {STATEMENTS}, f AS (SELECT symbol, CAST(period_end + 45 AS DATE) AS report_date, units FROM statements) SELECT symbol, report_date, CASE WHEN units % 3 = 0 THEN ['discounts', 'taxes'] ELSE ['taxes'] END AS missing, CAST(0 AS BIGINT) AS n_null FROM f")
def q11(spark, d):
    s = statements(spark, d).withColumn("discounts", F.when(F.col("units") % 3 != 0, F.col("discounts")))
    return q.missing_metrics(ingest.statement_facts(s, ["revenue", "discounts", "units"]), ["revenue", "discounts", "taxes", "units"])


_REPORT = f"""WITH {BARS}, {ACTIONS}, {_MOVES}, {_MEAN}, i AS ({_Q01} UNION ALL {_Q05.format(f=3)}),
h AS (SELECT symbol, year(date) AS year, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info FROM i GROUP BY ALL),
s AS (SELECT *, CAST(greatest(0, 100 - least(60, 20 * n_critical) - least(30, 5 * n_warning)) AS BIGINT) AS score, n_critical = 0 AS passed FROM h)"""


def _report(spark, d):
    found = q.price_anomalies(bars(spark, d), actions(spark, d)).unionByName(q.volume_anomalies(bars(spark, d), 3.0))
    return q.health(found.withColumn("year", F.year("date").cast("long")), ["symbol", "year"])


@_query("q12_quality_report", _REPORT + " SELECT * FROM s")
def q12(spark, d):
    return _report(spark, d)


@_query("q13_health_trend", _REPORT + f""", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS rn FROM s), l AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM k WHERE rn <= 7),
a AS (SELECT symbol, avg(score) FILTER (rn > n - 3) AS first3, avg(score) FILTER (rn <= 3) AS last3, count(*) AS n FROM l GROUP BY symbol)
SELECT symbol, {sql_r('first3')} AS first3, {sql_r('last3')} AS last3, CASE WHEN n < 2 THEN 'stable' WHEN last3 - first3 > 5 THEN 'improving' WHEN last3 - first3 < -5 THEN 'declining' ELSE 'stable' END AS trend FROM a""")
def q13(spark, d):
    return q.trend(_report(spark, d), "symbol", "year").select("symbol", r("first3").alias("first3"), r("last3").alias("last3"), "trend")


@_query("q14_backfill_validation", f"WITH {BARS}, sess AS (SELECT DISTINCT date FROM bars WHERE year(date) = 1999) SELECT s_suppkey AS symbol, (SELECT count(*) FROM sess) AS expected, count(date) AS actual, (SELECT count(*) FROM sess) - count(date) AS missing FROM supplier LEFT JOIN (SELECT * FROM bars WHERE year(date) = 1999) ON symbol = s_suppkey GROUP BY s_suppkey")
def q14(spark, d):
    b = bars(spark, d).where(F.year("date") == 1999)
    expected = b.agg(F.countDistinct("date").alias("expected"))
    have = b.groupBy("symbol").agg(F.count("*").alias("actual"))
    own = symbols(spark, d).select("symbol").join(have, "symbol", "left").crossJoin(F.broadcast(expected)).withColumn("actual", F.coalesce("actual", F.lit(0)))
    return own.select("symbol", "expected", "actual", (F.col("expected") - F.col("actual")).alias("missing"))


@_query("q15_retention", f"WITH {BARS} SELECT 'prices' AS tab, count(*) FILTER (date >= DATE '1998-11-04') AS kept, count(*) FILTER (date < DATE '1998-11-04') AS dropped FROM bars UNION ALL SELECT 'intraday', count(*) FILTER (ts >= TIMESTAMP '2024-01-10'), count(*) FILTER (ts < TIMESTAMP '2024-01-10') FROM events")
def q15(spark, d):
    a = q.retention(bars(spark, d), "date", "1998-11-04").select(F.lit("prices").alias("tab"), "*")
    return a.union(q.retention(read(spark, d, "events"), "ts", "2024-01-10").select(F.lit("intraday").alias("tab"), "*"))


_TWICE = f"""WITH {LINEAGE}, x AS (SELECT lineage_id, event_type, hypothesis_id, nullif(lineage_id % 3, 0) AS experiment_id, actor, ts FROM lineage),
y AS (SELECT * FROM x UNION ALL SELECT lineage_id + 100000000, event_type, hypothesis_id, experiment_id, CASE WHEN lineage_id % 10 = 0 THEN 'agent' ELSE actor END, date_trunc('minute', ts) + INTERVAL 59 SECOND FROM x WHERE lineage_id % 5 = 0)"""


@_query("q16_lineage_dedup", f"{_TWICE} SELECT min(lineage_id) AS lineage_id, event_type, hypothesis_id, experiment_id, actor, date_trunc('minute', ts) AS at, count(*) AS n FROM y GROUP BY event_type, hypothesis_id, experiment_id, actor, date_trunc('minute', ts)")
def q16(spark, d):
    """One event in five was logged again within its minute, half of these by another actor, which is another event; null experiments are equal."""
    x = lineage(spark, d).select("lineage_id", "event_type", "hypothesis_id", F.expr("nullif(lineage_id % 3, 0)").alias("experiment_id"), "actor", "ts")
    again = x.where("lineage_id % 5 = 0").select((F.col("lineage_id") + 100000000).alias("lineage_id"), "event_type", "hypothesis_id", "experiment_id", F.when(F.col("lineage_id") % 10 == 0, "agent").otherwise(F.col("actor")).alias("actor"), (F.date_trunc("minute", "ts").cast("timestamp_ntz") + F.expr("interval 59 seconds")).alias("ts"))
    return q.first_of_minute(x.unionByName(again))


@_query("q17_title_duplicates", "WITH t AS (SELECT o_orderkey AS id, o_custkey AS title, o_orderstatus AS status, o_orderdate AS placed FROM orders), f AS (SELECT title, min(placed) AS first_at FROM t WHERE status = 'F' GROUP BY title) SELECT id, t.title FROM t JOIN f ON t.title = f.title WHERE status = 'O' AND placed > first_at")
def q17(spark, d):
    t = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))
    first = F.min(F.when(F.col("status") == "F", F.col("at"))).over(Window.partitionBy("title"))
    return t.withColumn("first_at", first).where("status = 'O' and at > first_at").select("id", "title")


_LOG = "lg AS (SELECT ['prices', 'orders', 'events'][CAST(event_id % 3 + 1 AS INTEGER)] AS tab, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 < 2 THEN 'failed' WHEN event_id % 2 = 0 THEN 'Completed' ELSE 'completed' END AS status, ts AS completed_at FROM events)"


@_query("q18_freshness", f"""WITH {BARS}, {_LOG}, x AS (SELECT 'prices' AS tab, count(*) AS n, max(date) AS newest FROM bars UNION ALL SELECT 'orders', count(*), CAST(max(o_orderdate) AS DATE) FROM orders UNION ALL SELECT 'events', count(*), CAST(max(ts) AS DATE) FROM events),
g AS (SELECT tab, count(*) AS runs, count(*) FILTER (lower(status) = 'completed') * 100.0 / count(*) AS rate, max(completed_at) FILTER (lower(status) = 'completed') AS last_success FROM lg GROUP BY tab)
SELECT tab, n, newest, CAST(DATE '2024-01-31' - newest AS INTEGER) AS age, DATE '2024-01-31' - newest <= 3 AS is_fresh, runs, {sql_r('rate', 1)} AS success_rate, last_success FROM x JOIN g USING (tab)""")
def q18(spark, d):
    """Age of each table, and of its ingestion runs (events as a log) how many succeeded and when one did last."""
    x = None
    for name, df, c in (("prices", bars(spark, d), "date"), ("orders", read(spark, d, "orders"), "o_orderdate"), ("events", read(spark, d, "events"), "ts")):
        one = df.agg(F.lit(name).alias("tab"), F.count("*").alias("n"), F.to_date(F.max(c)).alias("newest"))
        x = one if x is None else x.union(one)
    e = read(spark, d, "events")
    tab = F.element_at(F.array(F.lit("prices"), F.lit("orders"), F.lit("events")), (F.col("event_id") % 3 + 1).cast("int"))
    failed = F.get_json_object("props", "$.k").cast("long") % 10 < 2
    log = e.select(tab.alias("tab"), F.when(failed, "failed").when(F.col("event_id") % 2 == 0, "Completed").otherwise("completed").alias("status"), F.col("ts").alias("completed_at"))
    age = F.date_diff(F.lit("2024-01-31").cast("date"), "newest")
    out = x.withColumn("age", age).withColumn("is_fresh", F.col("age") <= 3).join(q.run_summary(log, "tab"), "tab")
    return out.withColumn("success_rate", r("success_rate", 1))


@_query("q19_provenance_hash", "SELECT event_id, sha256('event_id=' || event_id || '|event_type=' || coalesce(event_type, 'null') || '|user_id=' || coalesce(CAST(user_id AS VARCHAR), 'null')) AS hash FROM events")
def q19(spark, d):
    return q.provenance_hash(read(spark, d, "events"), ["user_id", "event_type", "event_id"]).select("event_id", "hash")


@_query("q19_verify_partitions", "SELECT CAST(ts AS DATE) AS day, event_id, CASE WHEN event_id % 1777 = 5 THEN 'changed' WHEN event_id % 2500 = 7 THEN 'left' ELSE 'right' END AS kind FROM events WHERE event_id % 1777 = 5 OR event_id % 2500 = 7 OR event_id % 3000 = 11")
def q19_verify(spark, d):
    """A store of events by day against a copy in which some rows were changed, lost or (in the first store) never there: days are told apart by digests."""
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    cols = ["user_id", "event_type", "event_id"]
    n = F.col("event_id")
    # a changed row is never lost, as the SQL has it: event 3422507 is both; a changed null user becomes 0
    copy = e.where((n % 2500 != 7) | (n % 1777 == 5)).withColumn("user_id", F.when(n % 1777 == 5, F.coalesce(F.col("user_id") + 1, F.lit(0))).otherwise(F.col("user_id")))
    stores = []
    for name, rows in (("left", e.where((n % 3000 != 11) | (n % 1777 == 5) | (n % 2500 == 7))), ("right", copy)):
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        q.provenance_hash(rows, cols).select("day", "event_id", "hash").write.partitionBy("day").parquet(path)
        stores.append(spark.read.parquet(path))
    digests = [written(q.partition_digests(x, "day"), "digests") for x in stores]
    return q.differing(*stores, *digests, "day", "event_id")
