"""Queries of sources and sinks (S01-S16) and of point-in-time joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof
from ..session import shared_folder
from ..sources import ingest
from ..sources.views import ACTIONS, BARS, CHANGES, FILINGS, STATEMENTS, SYMBOLS, UNIVERSE, actions, bars, change_log, filings, r, read, sql_r, statements, symbols, universe

DAY = "1998-06-30"
METRICS = ["revenue", "discounts", "taxes", "units"]
QUERIES, ORACLE = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


FACTS = STATEMENTS + ", facts AS (SELECT symbol, period_end, metric, CAST(value AS DOUBLE) AS value, CAST(period_end + 45 AS DATE) AS report_date FROM (UNPIVOT statements ON revenue, discounts, taxes, units INTO NAME metric VALUE value))"


def facts(spark, sf_dir) -> DataFrame:
    return ingest.statement_facts(statements(spark, sf_dir), METRICS)


@_query("s01_normalise_bars", "SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS open, l_extendedprice AS high, l_extendedprice AS low, l_extendedprice AS close, l_extendedprice AS adj_close, CAST(l_quantity AS BIGINT) AS volume, 'vendor' AS source FROM lineitem")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "lineitem").select(F.concat(F.lit(" s"), "l_suppkey").alias("Symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"), *[F.col("l_extendedprice").alias(c) for c in ("Open", "High", "Low", "Close")], F.lit(None).cast("double").alias("Adj Close"), F.col("l_quantity").alias("Volume"))
    return ingest.normalise_bars(v, "vendor")


@_query("s02_primary_fallback", f"WITH {BARS}, prim AS (SELECT symbol, date, close FROM bars WHERE symbol % 3 <> 0), fb AS (SELECT symbol, date, open AS close FROM bars) SELECT *, false AS fallback_used FROM prim UNION ALL SELECT *, true FROM fb WHERE symbol NOT IN (SELECT symbol FROM prim)")
def s02(spark, sf_dir):
    b = bars(spark, sf_dir)
    return ingest.with_fallback(b.where("symbol % 3 <> 0").select("symbol", "date", "close"), b.select("symbol", "date", F.col("open").alias("close")))


@_query("s03_upsert_prices", f"WITH {BARS} SELECT symbol, date, CASE WHEN date >= DATE '1999-01-01' THEN open ELSE close END AS close, CASE WHEN date >= DATE '1999-01-01' THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS ingested_at FROM bars")
def s03(spark, sf_dir):
    """Rows that stand keep the stamp of the run that brought them."""
    b = bars(spark, sf_dir)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    old = b.select("symbol", "date", "close", at("2024-01-01").alias("ingested_at"))
    return ingest.upsert(old, b.where("date >= date'1999-01-01'").select("symbol", "date", F.col("open").alias("close")), ["symbol", "date"], at=at("2024-02-01"))


@_query("s01_s03_files_upserted", f"WITH {BARS} SELECT CAST(symbol AS VARCHAR) AS symbol, date, CASE WHEN date BETWEEN DATE '1999-03-01' AND DATE '2000-02-10' AND symbol % 3 = 0 THEN open ELSE close END AS close, volume, CASE WHEN date BETWEEN DATE '1999-03-01' AND DATE '2000-02-10' AND symbol % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS ingested_at, CAST(year(date) AS INTEGER) AS year FROM bars")
def s01_s03_files(spark, sf_dir):
    """Vendor CSV files read into a store by years, then a correction of some symbols over two of the years, which alone are written again."""
    b = bars(spark, sf_dir)
    vendor = f"{shared_folder(spark)}/vendor-{uuid.uuid4().hex}"
    b.select(F.col("symbol").cast("string").alias("Symbol"), F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("adj_close").alias("Adj Close"), F.col("volume").alias("Volume")).write.option("header", True).csv(vendor)
    rows = ingest.read_bars(spark, vendor).withColumn("year", F.year("date"))
    store = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    ingest.upsert_files(rows, store, ["symbol", "date"], "year", at=at("2024-01-01"))
    mended = rows.where("date between date'1999-03-01' and date'2000-02-10' and cast(symbol as int) % 3 = 0").withColumn("close", F.col("open"))
    ingest.upsert_files(mended, store, ["symbol", "date"], "year", at=at("2024-02-01"))
    return spark.read.parquet(store).select("symbol", "date", "close", "volume", "ingested_at", "year")


@_query("s04_membership_csv_rules", f"WITH {CHANGES} SELECT effective_date, 'S' || symbol AS symbol, action FROM changes")
def s04(spark, sf_dir):
    c = change_log(spark, sf_dir)
    raw = c.select(F.date_format("effective_date", "yyyy-MM-dd").alias("effective_date"), F.concat(F.lit(" s"), "symbol", F.lit(" ")).alias("symbol"), F.lower("action").alias("action"))
    bad = raw.withColumn("effective_date", F.lit("n/a")).unionByName(raw.withColumn("action", F.lit("RENAMED")))
    clean = ingest.membership_changes(raw.unionByName(bad).unionByName(raw))
    return ingest.insert_absent(clean.where("action = 'ADDED'"), clean, ["effective_date", "symbol", "action"])


@_query("s05_s07_statement_facts", f"WITH {FACTS} SELECT symbol, period_end, metric, value, report_date FROM facts WHERE report_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def s05(spark, sf_dir):
    return ingest.valid_facts(facts(spark, sf_dir)).where("report_date between date'1996-01-01' and date'2000-12-31'").select("symbol", "period_end", "metric", "value", "report_date")


@_query("s06_line_coalescing", f"WITH {STATEMENTS} SELECT symbol, period_end, CASE WHEN units % 2 = 0 THEN revenue ELSE coalesce(discounts, taxes) END AS income FROM statements")
def s06(spark, sf_dir):
    s = statements(spark, sf_dir).withColumn("diluted", F.when(F.col("units") % 2 == 0, F.col("revenue")))
    return s.select("symbol", "period_end", ingest.first_line("diluted", "discounts", "taxes").alias("income"))


@_query("s08_snapshot_features", f"WITH {SYMBOLS} SELECT symbol, DATE '2001-12-31' AS date, 'market_cap' AS feature_name, market_cap AS value, 'v1' AS version FROM symbols WHERE market_cap IS NOT NULL")
def s08(spark, sf_dir):
    return ingest.snapshot_features(symbols(spark, sf_dir).withColumn("date", F.lit("2001-12-31").cast("date")), ["market_cap"])


@_query("s09_corporate_actions", f"WITH {ACTIONS} SELECT symbol, date, 'split' AS action_type, coalesce(split_to / nullif(split_from, 0), 1.0) AS factor FROM actions UNION ALL SELECT symbol, date, 'dividend', cash FROM actions WHERE cash > 0")
def s09(spark, sf_dir):
    return ingest.normalise_actions(actions(spark, sf_dir))


@_query("s10_parse_messages", "SELECT event_type AS symbol, date_trunc('second', ts) AS ts, value AS close, event_id AS trades FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def s10(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    ms = F.unix_seconds(F.col("ts").cast("timestamp")) * 1000
    msg = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 0, "Q").otherwise("AM").alias("ev"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("sym"), ms.alias("s"), F.col("value").alias("c"), F.col("event_id").alias("n")))
    return ingest.parse_messages(e.select(msg.alias("value"))).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "trades")


@_query("s11_store_stats", f"WITH {BARS} SELECT symbol, count(*) AS n_rows, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY symbol UNION ALL SELECT NULL, count(*), count(DISTINCT date), min(date), max(date) FROM bars")
def s11(spark, sf_dir):
    return ingest.store_stats(bars(spark, sf_dir), "date", "symbol")


@_query("s15_range_read", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30' AND l_returnflag IN ('A', 'N')")
def s15(spark, sf_dir):
    li = ingest.range_read(read(spark, sf_dir, "lineitem"), "l_shipdate", "1997-01-01", "1997-06-30", l_returnflag=["A", "N"])
    return li.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@_query("s16_backfill_pending", f"WITH {BARS} SELECT s_suppkey AS symbol FROM supplier WHERE s_suppkey NOT IN (SELECT symbol FROM bars WHERE date >= DATE '2001-10-01') UNION SELECT CAST(c_custkey AS BIGINT) FROM customer WHERE c_custkey % 50 = 0 AND c_custkey NOT IN (SELECT symbol FROM bars WHERE date >= DATE '2001-10-01')")
def s16(spark, sf_dir):
    """Requested: all suppliers and a few symbols that were never priced; completed: what has a bar of the last weeks."""
    asked = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("symbol")).union(read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").cast("long")))
    return ingest.pending(asked, bars(spark, sf_dir).where("date >= date'2001-10-01'"))


@_query("p01_facts_as_of", f"WITH {FACTS} SELECT symbol, metric, value, report_date FROM facts WHERE report_date <= DATE '{DAY}' QUALIFY row_number() OVER (PARTITION BY symbol, metric ORDER BY report_date DESC, period_end DESC) = 1")
def p01(spark, sf_dir):
    return asof.facts_as_of(facts(spark, sf_dir), DAY).select("symbol", "metric", "value", "report_date")


_WIDE = STATEMENTS + ", w AS (SELECT *, CAST(period_end + 45 AS DATE) AS report_date FROM statements)"


@_query("p02_facts_for_all_dates", f"WITH {BARS}, {_WIDE} SELECT b.symbol, b.date, CAST(w.revenue AS DOUBLE) AS revenue, CAST(w.units AS DOUBLE) AS units FROM bars b ASOF LEFT JOIN w ON b.symbol = w.symbol AND b.date >= w.report_date")
def p02(spark, sf_dir):
    f = statements(spark, sf_dir).select("symbol", F.date_add("period_end", 45).alias("report_date"), F.col("revenue").cast("double").alias("revenue"), F.col("units").cast("double").alias("units"))
    return asof.asof_join(bars(spark, sf_dir).select("symbol", "date"), f, ["symbol"], "date", "report_date", ["revenue", "units"])


@_query("p03_quarterly_series", f"WITH {BARS}, {_WIDE}, j AS (SELECT b.symbol, b.date, CASE WHEN w.units % 2 = 0 THEN CAST(w.revenue AS DOUBLE) END AS ts_revenue, CAST(w.taxes AS DOUBLE) AS ts_taxes FROM bars b ASOF JOIN w ON b.symbol = w.symbol AND b.date >= w.report_date) SELECT symbol, date, feature_name, value FROM (UNPIVOT j ON ts_revenue, ts_taxes INTO NAME feature_name VALUE value)")
def p03(spark, sf_dir):
    f = statements(spark, sf_dir).select("symbol", F.date_add("period_end", 45).alias("report_date"), F.when(F.col("units") % 2 == 0, F.col("revenue").cast("double")).alias("ts_revenue"), F.col("taxes").cast("double").alias("ts_taxes"))
    j = asof.asof_join(bars(spark, sf_dir).select("symbol", "date"), f, ["symbol"], "date", "report_date", ["ts_revenue", "ts_taxes"])
    return j.unpivot(["symbol", "date"], ["ts_revenue", "ts_taxes"], "feature_name", "value").where("value is not null")


@_query("p04_snapshot_to_all_days", f"WITH {BARS}, {FACTS}, n AS (SELECT symbol, 'ts_' || metric AS feature_name, arg_max(value, report_date) AS value FROM facts GROUP BY ALL) SELECT b.symbol, b.date, feature_name, value FROM bars b JOIN n ON b.symbol = n.symbol WHERE year(b.date) = 2000")
def p04(spark, sf_dir):
    n = facts(spark, sf_dir).groupBy("symbol", F.concat(F.lit("ts_"), "metric").alias("feature_name")).agg(F.max_by("value", "report_date").alias("value"))
    return bars(spark, sf_dir).where(F.year("date") == 2000).select("symbol", "date").join(n, "symbol").select("symbol", "date", "feature_name", "value")


@_query("p05_latest_pivot", f"WITH {FACTS} SELECT symbol, arg_max(value, report_date) FILTER (metric = 'revenue') AS revenue, arg_max(value, report_date) FILTER (metric = 'discounts') AS discounts, arg_max(value, report_date) FILTER (metric = 'taxes') AS taxes, arg_max(value, report_date) FILTER (metric = 'units') AS units FROM facts GROUP BY symbol")
def p05(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("symbol").pivot("metric", METRICS).agg(F.max_by("value", "report_date"))


@_query("p06_universe_as_of", f"WITH {UNIVERSE} SELECT symbol, date FROM (SELECT * FROM universe WHERE date <= DATE '{DAY}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) WHERE in_universe")
def p06(spark, sf_dir):
    return asof.universe_as_of(universe(spark, sf_dir), DAY).select("symbol", "date")


@_query("p07_universe_from_log", f"WITH {CHANGES} SELECT symbol, max(effective_date) AS since FROM changes WHERE effective_date <= DATE '{DAY}' GROUP BY symbol HAVING arg_max(action, effective_date) = 'ADDED'")
def p07(spark, sf_dir):
    return asof.members_from_log(change_log(spark, sf_dir), DAY)


@_query("p08_transitions", f"""WITH {UNIVERSE}, x AS (SELECT *, lag(in_universe) OVER w AS was, coalesce(bool_or(in_universe) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ever FROM universe WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, CASE WHEN NOT in_universe THEN 'removed' WHEN ever THEN 'readded' ELSE 'added' END AS transition FROM x WHERE in_universe AND NOT coalesce(was, false) OR NOT in_universe AND was""")
def p08(spark, sf_dir):
    return asof.transitions(universe(spark, sf_dir)).select("symbol", "date", "transition")


@_query("p09_sector_breakdown", f"WITH {UNIVERSE}, {SYMBOLS} SELECT sector, count(*) AS n FROM (SELECT * FROM universe WHERE date <= DATE '{DAY}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) JOIN symbols USING (symbol) WHERE in_universe GROUP BY sector")
def p09(spark, sf_dir):
    return asof.universe_as_of(universe(spark, sf_dir), DAY).join(symbols(spark, sf_dir), "symbol").groupBy("sector").agg(F.count("*").alias("n"))


_EXCL = "CASE WHEN sector IN ('ASIA') THEN 'excluded_sector:' || regexp_replace(lower(sector), '[^a-z0-9]+', '_', 'g') WHEN upper(industry) LIKE '%REIT%' THEN 'excluded_sector:reit' WHEN price < 5 THEN 'penny_stock:price_below_5.00' END"


@_query("p10_p12_exclusions", f"WITH {BARS}, {SYMBOLS}, l AS (SELECT symbol, arg_max(close, date) / 1000 AS price FROM bars GROUP BY symbol), x AS (SELECT symbol, {_EXCL} AS reason FROM symbols LEFT JOIN l USING (symbol)) SELECT symbol, reason, reason IS NULL AS in_universe FROM x")
def p10(spark, sf_dir):
    last = bars(spark, sf_dir).groupBy("symbol").agg((F.max_by("close", "date") / 1000).alias("price"))
    why = asof.exclusion(F.col("sector"), F.col("industry"), F.col("price"), ["ASIA"])
    return symbols(spark, sf_dir).join(last, "symbol", "left").select("symbol", why.alias("reason"), why.isNull().alias("in_universe"))


@_query("p11_snapshot_diff", f"""WITH {UNIVERSE}, s AS (SELECT *, lag(in_universe) OVER (PARTITION BY symbol ORDER BY date) AS was, date AS d FROM universe)
SELECT d AS date, count(*) FILTER (in_universe AND NOT coalesce(was, false)) AS added, count(*) FILTER (NOT in_universe AND coalesce(was, false)) AS removed, count(*) FILTER (in_universe) AS members, count(*) FILTER (NOT in_universe) AS excluded FROM s GROUP BY d""")
def p11(spark, sf_dir):
    was = F.coalesce(F.lag("in_universe").over(Window.partitionBy("symbol").orderBy("date")), F.lit(False))
    u = universe(spark, sf_dir).withColumn("was", was)
    return u.groupBy("date").agg(F.count_if(F.col("in_universe") & ~F.col("was")).alias("added"), F.count_if(~F.col("in_universe") & F.col("was")).alias("removed"), F.count_if("in_universe").alias("members"), F.count_if(~F.col("in_universe")).alias("excluded"))


@_query("p13_membership_history", f"WITH {CHANGES} SELECT symbol, effective_date, action FROM changes WHERE effective_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def p13(spark, sf_dir):
    return change_log(spark, sf_dir).where("effective_date between date'1997-01-01' and date'1999-12-31'")


@_query("p14_p15_ratio_features", f"WITH {BARS}, {_WIDE}, {SYMBOLS}, j AS (SELECT b.symbol, b.date, b.close, w.* EXCLUDE (symbol) FROM bars b ASOF LEFT JOIN w ON b.symbol = w.symbol AND b.date >= w.report_date) SELECT j.symbol, j.date, {sql_r('discounts / CAST(nullif(revenue, 0) AS DOUBLE)', 6)} AS roe, {sql_r('taxes / CAST(nullif(revenue, 0) AS DOUBLE)', 6)} AS earnings_quality, {sql_r('revenue / 100.0 / nullif(market_cap, 0)', 2)} AS fcf_yield, {sql_r('close / nullif(revenue / 100.0 / nullif(units, 0), 0)', 4)} AS price_to_fcf FROM j JOIN symbols s ON s.symbol = j.symbol")
def p14(spark, sf_dir):
    f = statements(spark, sf_dir).withColumn("report_date", F.date_add("period_end", 45))
    j = asof.asof_join(bars(spark, sf_dir).select("symbol", "date", "close"), f, ["symbol"], "date", "report_date", METRICS).join(symbols(spark, sf_dir), "symbol")
    rev = F.col("revenue") / F.lit(100.0)
    return j.select("symbol", "date", r(F.try_divide(F.col("discounts").cast("double"), F.col("revenue").cast("double")), 6).alias("roe"), r(F.try_divide(F.col("taxes").cast("double"), F.col("revenue").cast("double")), 6).alias("earnings_quality"), r(F.try_divide(rev, F.col("market_cap")), 2).alias("fcf_yield"), r(F.try_divide("close", F.try_divide(rev, F.col("units").cast("double")))).alias("price_to_fcf"))


@_query("p16_pass_through", f"WITH {BARS}, {SYMBOLS} SELECT symbol, date, market_cap FROM bars LEFT JOIN symbols USING (symbol)")
def p16(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "date").join(symbols(spark, sf_dir).select("symbol", "market_cap"), "symbol", "left")


_KINDS = ("10-K", "10-Q", "8-K")


@_query("p17_p20_sentiment_as_of", f"WITH {BARS}, {FILINGS}, f AS (SELECT symbol, filing_type, filing_date, last(score ORDER BY doc_id) AS score FROM filings GROUP BY ALL) SELECT b.symbol, b.date, " + ", ".join(f"k{i}.score AS score_{i}" for i in range(3)) + ", CASE WHEN k0.score >= 0.3 THEN 'positive' WHEN k0.score <= -0.3 THEN 'negative' WHEN k0.score IS NOT NULL THEN 'neutral' END AS category FROM bars b " + " ".join(f"ASOF LEFT JOIN (SELECT * FROM f WHERE filing_type = '{k}') k{i} ON b.symbol = k{i}.symbol AND b.date >= k{i}.filing_date" for i, k in enumerate(_KINDS)))
def p17(spark, sf_dir):
    f, out = filings(spark, sf_dir), bars(spark, sf_dir).select("symbol", "date")
    for i, k in enumerate(_KINDS):
        own = f.where(F.col("filing_type") == k).withColumnRenamed("score", f"score_{i}")
        out = asof.asof_join(out, own, ["symbol"], "date", "filing_date", [f"score_{i}"], order=["doc_id"])
    return out.withColumn("category", asof.sentiment_category(F.col("score_0")))


@_query("p18_p19_sentiment_average_momentum", f"WITH {FILINGS} SELECT symbol, filing_type, filing_date, doc_id, {sql_r('avg(score) OVER w')} AS sentiment_score_avg, {sql_r('score - first(score) OVER w')} AS sentiment_momentum FROM filings WINDOW w AS (PARTITION BY symbol ORDER BY filing_date, doc_id ROWS UNBOUNDED PRECEDING)")
def p18(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("filing_date", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return filings(spark, sf_dir).select("symbol", "filing_type", "filing_date", "doc_id", r(F.avg("score").over(w)).alias("sentiment_score_avg"), r(F.last("score").over(w) - F.first("score").over(w)).alias("sentiment_momentum"))


@_query("p21_latest_filing", f"WITH {FILINGS} SELECT symbol, filing_type, filing_date, doc_id, score FROM filings QUALIFY row_number() OVER (PARTITION BY symbol, filing_type ORDER BY filing_date DESC, doc_id DESC) = 1")
def p21(spark, sf_dir):
    return asof.latest(filings(spark, sf_dir), ["symbol", "filing_type"], [F.desc("filing_date"), F.desc("doc_id")])


@_query("p22_price_within_five_days", f"WITH {BARS}, {FILINGS}, j AS (SELECT f.doc_id, f.symbol, f.filing_date, b.close, b.date FROM filings f ASOF LEFT JOIN bars b ON f.symbol = b.symbol AND f.filing_date >= b.date) SELECT doc_id, symbol, filing_date, CASE WHEN filing_date - date <= 5 THEN close END AS close FROM j")
def p22(spark, sf_dir):
    return asof.asof_join(filings(spark, sf_dir).select("doc_id", "symbol", "filing_date"), bars(spark, sf_dir), ["symbol"], "filing_date", "date", ["close"], tolerance_days=5)


@_query("p23_calendar_snapping", f"WITH {BARS}, {FILINGS}, c AS (SELECT DISTINCT date FROM bars WHERE dayofweek(date) BETWEEN 1 AND 5) SELECT doc_id, filing_date AS date, (SELECT max(c.date) FROM c WHERE c.date <= filing_date AND c.date >= filing_date - 10) AS previous_session, (SELECT min(c.date) FROM c WHERE c.date >= filing_date AND c.date <= filing_date + 10) AS next_session FROM filings")
def p23(spark, sf_dir):
    calendar = bars(spark, sf_dir).select("date").distinct().where(F.dayofweek("date").between(2, 6))
    return asof.snap(filings(spark, sf_dir).select("doc_id", F.col("filing_date").alias("date")), calendar)


@_query("p23_sessions_in_range", f"WITH {BARS}, c AS (SELECT DISTINCT date FROM bars WHERE dayofweek(date) BETWEEN 1 AND 5 AND date BETWEEN DATE '1998-02-07' AND DATE '1999-02-28') SELECT min(date) AS first_session, max(date) AS last_session, count(*) AS sessions FROM c")
def p23_range(spark, sf_dir):
    return asof.in_range(bars(spark, sf_dir).where(F.dayofweek("date").between(2, 6)), "1998-02-07", "1999-02-28")
