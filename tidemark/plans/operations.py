"""Queries of drift (D01-D04), lineage (L01-L09) and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import drift, scans, sketches
from ..operators.research import spearman
from ..session import written
from ..sources.views import INTRADAY, LINEAGE, TRADES, intraday, lineage, r, read, sql_r, trades
from ..streaming import intraday as stream
from .research import _LONGSQL, _long

QUERIES, ORACLE = {}, {}


def _query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _drift_sql(bins: int) -> str:
    return f"""WITH {_LONGSQL}, s AS (SELECT feature, fx AS x, CASE WHEN date < DATE '1999-01-01' THEN 'reference' ELSE 'new' END AS side FROM long),
e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM s WHERE side = 'reference' GROUP BY feature), p AS (SELECT feature, (hi - lo) / {bins} AS width, least(CAST(floor((x - lo) / ((hi - lo) / {bins})) AS INTEGER), {bins - 1}) AS bin, side FROM s JOIN e USING (feature) WHERE x BETWEEN lo AND hi),
c AS (SELECT feature, width, bin, count(*) FILTER (side = 'reference') AS p, count(*) FILTER (side = 'new') AS q FROM p GROUP BY ALL), f AS (SELECT w.feature, w.width, b.bin, coalesce(c.p, 0) AS p, coalesce(c.q, 0) AS q FROM (SELECT DISTINCT feature, width FROM c) w CROSS JOIN (SELECT unnest(range({bins})) AS bin) b LEFT JOIN c ON c.feature = w.feature AND c.bin = b.bin),
d AS (SELECT *, p / (sum(p) OVER k * width) + 1e-10 AS dp, q / (sum(q) OVER k * width) + 1e-10 AS dq, sum(p) OVER k AS np, sum(q) OVER k AS nq FROM f WINDOW k AS (PARTITION BY feature)), h AS (SELECT *, dp / sum(dp) OVER k AS sp, dq / sum(dq) OVER k AS sq FROM d WINDOW k AS (PARTITION BY feature)),
o AS (SELECT feature, CAST(any_value(np) AS BIGINT) AS n_ref, CAST(any_value(nq) AS BIGINT) AS n_new, sum(sp * ln(sp / sq)) AS kl, sum((sp - sq) * ln(sp / sq)) AS psi FROM h GROUP BY feature)"""


def _sides(spark, d):
    x = _long(spark, d).where("horizon = 5 and x is not null and y is not null")
    return x.select("feature", "x", F.when(F.col("date") < "1999-01-01", "reference").otherwise("new").alias("side"))


@_query("d01_prediction_drift_kl", _drift_sql(50) + f" SELECT feature, n_ref, n_new, {sql_r('kl')} AS kl, kl > 0.2 AS drifted FROM o")
def d01(spark, d):
    return drift.histogram_drift(_sides(spark, d), 50).select("feature", "n_ref", "n_new", r("kl").alias("kl"), (F.col("kl") > 0.2).alias("drifted"))


@_query("d02_feature_drift_psi", _drift_sql(10) + f" SELECT feature, n_ref, n_new, {sql_r('psi')} AS psi FROM o")
def d02(spark, d):
    return drift.histogram_drift(_sides(spark, d), 10).select("feature", "n_ref", "n_new", r("psi").alias("psi"))


@_query("d02_sketched_drift", _drift_sql(10) + " SELECT feature, n_ref, n_new, true AS within FROM o")
def d02_sketched(spark, d):
    """The same from monthly sketches, of which the reference's are kept: within 0.05 of what the values give."""
    x = written(_sides(spark, d).where("x is not null"), "sides")
    month = F.when(F.col("side") == "reference", "1998-01-01").otherwise("1999-01-01").cast("date")
    kept = written(sketches.monthly(x.withColumn("date", month), ["feature"], "date", "x", 800), "sketches")
    side = lambda m: sketches.merged(kept, ["feature"], m, m, 800)
    found = sketches.drift(side("1998-01-01"), side("1999-01-01"), ["feature"]).withColumnRenamed("psi", "estimate")
    true = drift.histogram_drift(x, 10).select("feature", F.col("n_ref").alias("ref"), F.col("n_new").alias("new"), "psi")
    return found.join(true, "feature").select("feature", F.col("ref").alias("n_ref"), F.col("new").alias("n_new"), (F.abs(F.col("psi") - F.col("estimate")) < 0.05).alias("within"))


_RK = "rank() OVER (PARTITION BY side, model ORDER BY {c}) + (count(*) OVER (PARTITION BY side, model, {c}) - 1) / 2.0"


@_query("d03_concept_drift", f"WITH {TRADES}, t AS (SELECT model, close_date < DATE '1999-01-01' AS side, prediction AS p, round(close_price / entry_price, 9) AS y FROM trades WHERE status <> 'open'), k AS (SELECT side, model, {_RK.format(c='p')} AS a, {_RK.format(c='y')} AS b FROM t), c AS (SELECT side, model, corr(a, b) AS ic FROM k GROUP BY ALL) SELECT n.model, {sql_r('o.ic')} AS reference_ic, {sql_r('n.ic')} AS ic, {sql_r('abs(o.ic - n.ic) / abs(o.ic)', 2)} AS change FROM c n JOIN c o ON o.model = n.model AND o.side AND NOT n.side")
def d03(spark, d):
    t = trades(spark, d).where("status <> 'open'").withColumn("y", F.round(F.col("close_price") / F.col("entry_price"), 9))
    old = spearman(t.where("close_date < '1999-01-01'"), "prediction", "y", "model")
    now = drift.concept_drift(t.where("close_date >= '1999-01-01'"), "prediction", "y", old, "model")
    return now.select("model", r("reference_ic").alias("reference_ic"), r("ic").alias("ic"), r("change", 2).alias("change"))


@_query("d04_prediction_history", f"WITH {TRADES} SELECT model, year(entry_date) AS year, count(*) AS n, {sql_r('avg(prediction)')} AS mean, {sql_r('stddev_pop(prediction)')} AS sd FROM trades GROUP BY ALL")
def d04(spark, d):
    return trades(spark, d).groupBy("model", F.year("entry_date").cast("long").alias("year")).agg(F.count("*").alias("n"), r(F.avg("prediction")).alias("mean"), r(F.stddev_pop("prediction")).alias("sd"))


@_query("l01_lineage_filters", f"WITH {LINEAGE} SELECT lineage_id, event_type, actor, ts FROM lineage WHERE starts_with(actor, 'user:1') AND ts >= TIMESTAMP '2024-01-10' AND hypothesis_id < 20")
def l01(spark, d):
    return lineage(spark, d).where(F.col("actor").startswith("user:1") & (F.col("ts") >= "2024-01-10") & (F.col("hypothesis_id") < 20)).select("lineage_id", "event_type", "actor", "ts")


@_query("l02_event_chain", f"WITH RECURSIVE {LINEAGE}, chain AS (SELECT lineage_id, parent_id, 0 AS depth FROM lineage WHERE hypothesis_id = 7 UNION ALL SELECT l.lineage_id, l.parent_id, c.depth + 1 FROM chain c JOIN lineage l ON l.lineage_id = c.parent_id WHERE c.depth < 64) SELECT lineage_id, CAST(min(depth) AS INTEGER) AS depth FROM chain GROUP BY lineage_id")
def l02(spark, d):
    return drift.event_chain(lineage(spark, d), 7)


@_query("l03_status_summary", f"WITH {LINEAGE} SELECT hypothesis_id, count(*) AS n, count(DISTINCT actor) AS actors, first(lineage_id ORDER BY ts DESC, lineage_id DESC) FILTER (event_type = 'purchase') AS last_purchase, min(ts) AS first_ts, max(ts) AS last_ts FROM lineage GROUP BY hypothesis_id")
def l03(spark, d):
    return lineage(spark, d).groupBy("hypothesis_id").agg(F.count("*").alias("n"), F.countDistinct("actor").alias("actors"), F.max_by("lineage_id", F.when(F.col("event_type") == "purchase", F.struct("ts", "lineage_id"))).alias("last_purchase"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@_query("l03_deployment_trace", f"WITH RECURSIVE {LINEAGE}, chain AS (SELECT lineage_id, parent_id FROM lineage WHERE hypothesis_id = 7 UNION SELECT l.lineage_id, l.parent_id FROM chain c JOIN lineage l ON l.lineage_id = c.parent_id) SELECT lineage_id, event_type, actor, ts FROM lineage JOIN chain USING (lineage_id) WHERE event_type IN ('purchase', 'signup')")
def l03_trace(spark, d):
    return drift.deployment_trace(lineage(spark, d), 7, ["purchase", "signup"]).select("lineage_id", "event_type", "actor", "ts")


@_query("l03_events_between", f"WITH {LINEAGE}, b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM lineage WHERE lineage_id IN (40, 700)) SELECT lineage_id, event_type, ts FROM lineage, b WHERE ts BETWEEN lo AND hi")
def l03_between(spark, d):
    return drift.events_between(lineage(spark, d), 700, 40).select("lineage_id", "event_type", "ts")


_DEFS = "defs AS (SELECT p_name || '#' || p_partkey AS feature, p_brand AS input, 1 AS k FROM part UNION ALL SELECT DISTINCT p_brand, p_type, 2 FROM part)"


def _definitions(spark, d):
    """Feature definitions with JSON inputs: parts rest on brands, brands on types."""
    p = read(spark, d, "part")
    a = p.select(F.concat("p_name", F.lit("#"), "p_partkey").alias("feature"), F.to_json(F.array("p_brand")).alias("inputs"))
    return a.unionByName(p.groupBy(F.col("p_brand").alias("feature")).agg(F.to_json(F.array_sort(F.collect_set("p_type"))).alias("inputs")))


@_query("l04_dependency_closure", f"WITH {_DEFS}, u AS (SELECT feature, input, 1 AS depth FROM defs UNION ALL SELECT a.feature, b.input, 2 FROM defs a JOIN defs b ON a.input = b.feature WHERE a.k = 1 AND b.k = 2) SELECT feature, input, CAST(min(depth) AS INTEGER) AS depth FROM u GROUP BY ALL")
def l04(spark, d):
    return drift.closure(drift.dependency_edges(_definitions(spark, d)))


@_query("l05_impact_analysis", f"WITH {_DEFS}, u AS (SELECT feature, input FROM defs UNION SELECT a.feature, b.input FROM defs a JOIN defs b ON a.input = b.feature WHERE a.k = 1 AND b.k = 2) SELECT input, count(*) AS touched, CASE WHEN count(*) > 10 THEN 'High' WHEN count(*) > 5 THEN 'Medium' ELSE 'Low' END AS level FROM u GROUP BY input")
def l05(spark, d):
    n = F.count("*")
    return l04(spark, d).groupBy("input").agg(n.alias("touched"), F.when(n > 10, "High").when(n > 5, "Medium").otherwise("Low").alias("level"))


@_query("l06_l09_activity_rollups", f"WITH {LINEAGE} SELECT event_type, count(*) AS n, count(DISTINCT actor) AS actors, count(DISTINCT CAST(ts AS DATE)) AS days, min(ts) AS first_ts, max(ts) AS last_ts, {sql_r('avg(CAST(json_extract(details, chr(36) || chr(46) || chr(107)) AS BIGINT))')} AS mean_k FROM lineage GROUP BY event_type")
def l06(spark, d):
    return lineage(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("actor").alias("actors"), F.countDistinct(F.to_date("ts")).alias("days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), r(F.avg(F.get_json_object("details", "$.k").cast("long"))).alias("mean_k"))


@_query("l07_history_append", f"""WITH {LINEAGE}, k AS (SELECT *, json_extract_string(details, '$.k') AS v FROM lineage) SELECT lineage_id, '[{{"type":"created","params":{{}},"timestamp":"2024-01-01"}},{{"type":"' || event_type || '","params":{{"k":"' || v || '"}},"timestamp":"' || CAST(ts AS DATE) || '"}}]' AS history,
'{{"old":"1","' || event_type || '":"' || v || '"}}' AS added, '{{"old":"' || v || '"}}' AS replaced FROM k""")
def l07(spark, d):
    """JSON documents read, extended and written again: a step appended to an array, a key of a map added, and one replaced."""
    x = lineage(spark, d).withColumn("v", F.get_json_object("details", "$.k"))
    history = drift.appended(F.lit('[{"type":"created","params":{},"timestamp":"2024-01-01"}]'), F.col("event_type"), F.create_map(F.lit("k"), F.col("v")), F.to_date("ts").cast("string"))
    checks = F.lit('{"old":"1"}')
    return x.select("lineage_id", history.alias("history"), drift.key_set(checks, F.col("event_type"), F.col("v")).alias("added"), drift.key_set(checks, F.lit("old"), F.col("v")).alias("replaced"))


@_query("l09_conversion_by_model", f"WITH {TRADES}, t AS (SELECT *, close_price / entry_price - 1 AS r FROM trades) SELECT model, count(*) AS n, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'closed') AS n_closed, count(*) FILTER (status = 'stopped') AS n_stopped, {sql_r("count(*) FILTER (status = 'closed') / count(*)")} AS conversion, {sql_r("avg(r) FILTER (status <> 'open') / stddev_samp(r) FILTER (status <> 'open')")} AS mean_sharpe, max(entry_date) AS last_run FROM t GROUP BY model")
def l09(spark, d):
    """Per model: runs by status, the share that was carried through, the Sharpe ratio of those that ended, and the last run."""
    t = trades(spark, d).withColumn("r", F.when(F.col("status") != "open", F.col("close_price") / F.col("entry_price") - 1))
    of = lambda k: F.count_if(F.col("status") == k)
    return t.groupBy("model").agg(F.count("*").alias("n"), of("open").alias("n_open"), of("closed").alias("n_closed"), of("stopped").alias("n_stopped"), r(of("closed") / F.count("*")).alias("conversion"), r(F.try_divide(F.avg("r"), F.stddev_samp("r"))).alias("mean_sharpe"), F.max("entry_date").alias("last_run"))


@_query("l08_payload_filter", f"WITH {LINEAGE} SELECT DISTINCT hypothesis_id FROM lineage WHERE CAST(json_extract(details, '$.k') AS BIGINT) > 90 AND ts >= TIMESTAMP '2024-01-23'")
def l08(spark, d):
    return lineage(spark, d).where((F.get_json_object("details", "$.k").cast("long") > 90) & (F.col("ts") >= "2024-01-23")).select("hypothesis_id").distinct()


def _stream_source(spark, d):
    """Events as a stream of bars."""
    e = stream.stream_of(spark, f"{d}/events.parquet")
    return e.select(F.concat("event_type", F.lit("-"), F.pmod("user_id", F.lit(10)).cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("close"), (F.pmod("event_id", F.lit(97)) * 10).alias("volume"))


def _messages(spark, d) -> DataFrame:
    """Events as JSON messages of minute bars in four arrivals, by number modulo 4, so that later ones correct minutes of earlier ones; some are of no use."""
    e = read(spark, d, "events")
    n, useless = F.col("event_id"), F.col("event_id") % 13 == 0
    symbol = F.concat("event_type", F.lit("-"), F.pmod("user_id", F.lit(10)).cast("string"))
    start = F.unix_millis(F.date_trunc("minute", F.col("ts").cast("timestamp")))
    m = F.to_json(F.struct(F.when(useless, "A").otherwise("AM").alias("ev"), F.when(n % 17 > 0, symbol).alias("sym"), start.alias("s"), F.col("value").alias("c"), F.when(n % 3 > 0, n % 97 * 10).alias("v"), n.alias("n")))
    return e.select((n % 4).alias("part"), F.when(n % 19 == 0, F.lit("not a message")).otherwise(m).alias("value"))


@_query("t01_t12_stream_upsert", f"""WITH m AS (SELECT event_type || '-' || CAST(user_id % 10 AS VARCHAR) AS symbol, date_trunc('minute', ts) AS ts, event_id, value, CASE WHEN event_id % 3 > 0 THEN event_id % 97 * 10 ELSE 0 END AS volume FROM events WHERE event_id % 13 > 0 AND event_id % 17 > 0 AND event_id % 19 > 0)
SELECT symbol, ts, last(event_id ORDER BY event_id % 4, event_id) AS event_id, last(value ORDER BY event_id % 4, event_id) AS close, last(volume ORDER BY event_id % 4, event_id) AS volume, min(event_id % 4) AS first_batch, max(event_id % 4) AS batch FROM m GROUP BY symbol, ts""")
def t01(spark, d):
    """Four files of messages, one a batch, parsed and merged in the stream; the arrival tells which write is the last, not the minute."""
    got = stream.ingest(stream.message_stream(spark, stream.landed(_messages(spark, d), "part", 4)), ["symbol", "ts"], "trades")
    return got.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("trades").alias("event_id"), "close", "volume", "first_batch", "batch")


_O = "(PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN {a} PRECEDING AND {b})"
_o = lambda n: _O.format(a=n - 1, b="CURRENT ROW")
_T = f"""WITH {INTRADAY}, b AS (SELECT *, close - lag(close) OVER w AS step, CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END AS ret, CAST(ts AS DATE) AS day FROM intraday WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
f AS (SELECT symbol, ts, event_id, sum(CASE WHEN volume > 0 THEN close * volume END) OVER {_o(60)} / nullif(sum(CASE WHEN volume > 0 THEN volume END) OVER {_o(60)}, 0) AS intraday_vwap,
CASE WHEN count(step) OVER {_o(14)} = 14 THEN CASE WHEN sum(greatest(-step, 0)) OVER {_o(14)} > 1e-12 THEN 100 - 100 / (1 + sum(greatest(step, 0)) OVER {_o(14)} / sum(greatest(-step, 0)) OVER {_o(14)}) ELSE 100 END END AS intraday_rsi_14,
CASE WHEN lag(close, 20) OVER w > 0 THEN close / lag(close, 20) OVER w - 1 END AS intraday_momentum_20, CASE WHEN count(ret) OVER {_o(20)} = 20 THEN stddev_samp(ret) OVER {_o(20)} * sqrt(252 * 390) END AS intraday_volatility_20,
CASE WHEN count(volume) OVER {_O.format(a=20, b='1 PRECEDING')} = 20 THEN volume / nullif(avg(volume) OVER {_O.format(a=20, b='1 PRECEDING')}, 0) END AS intraday_volume_ratio,
CASE WHEN first(close) OVER y > 0 THEN close / first(close) OVER y - 1 END AS intraday_price_to_open, CASE WHEN max(close) OVER y > min(close) OVER y THEN (close - min(close) OVER y) / (max(close) OVER y - min(close) OVER y) ELSE 0.5 END AS intraday_range_position
FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id), y AS (PARTITION BY symbol, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
_DIG = {"intraday_volatility_20": 1, "intraday_momentum_20": 2, "intraday_price_to_open": 2}


@_query("t02_t08_intraday_features", _T + " SELECT symbol, ts, event_id, " + ", ".join(f"{sql_r(c, _DIG.get(c, 3))} AS {c}" for c in stream.FEATURES) + " FROM f")
def t02(spark, d):
    return stream.features(intraday(spark, d)).select("symbol", "ts", "event_id", *[r(c, _DIG.get(c, 3)).alias(c) for c in stream.FEATURES])


@_query("t09_stateful_stream", _T + " SELECT symbol, event_id, feature_name, value FROM (" + " UNION ALL ".join(f"SELECT symbol, event_id, '{c}' AS feature_name, {sql_r(c, _DIG.get(c, 3))} AS value FROM f WHERE {c} IS NOT NULL" for c in stream.FEATURES) + ")")
def t09(spark, d):
    out = stream.stateful(_stream_source(spark, d))
    digits = {c: _DIG.get(c, 3) for c in stream.FEATURES}
    value = F.coalesce(*[F.when(F.col("feature_name") == c, r("value", n)) for c, n in digits.items()])
    return out.select("symbol", "event_id", "feature_name", value.alias("value"))


@_query("t10_reconnect_gaps", f"WITH {INTRADAY}, l AS (SELECT symbol, CAST(floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts)))) / 60) AS BIGINT) AS minutes, epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts))) AS seconds FROM intraday GROUP BY symbol) SELECT symbol, minutes, CASE WHEN seconds < 120 THEN 'none' WHEN seconds <= 7200 THEN 'refill' ELSE 'skip' END AS action FROM l")
def t10(spark, d):
    return stream.reconnect_plan(intraday(spark, d), "2024-01-31")


@_query("t11_stream_roll_up", f"WITH {INTRADAY} SELECT symbol, date_trunc('hour', ts) AS ts, first(close ORDER BY ts, event_id) AS open, max(close) AS high, min(close) AS low, last(close ORDER BY ts, event_id) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM intraday GROUP BY symbol, date_trunc('hour', ts)")
def t11(spark, d):
    path = stream.new_folder(spark, "rolled")
    rolled = stream.roll_up(_stream_source(spark, d), "1 hour", late="60 days")
    stream.drained(rolled, lambda df, i: df.withColumn("batch", F.lit(i).cast("long")).write.mode("append").parquet(path), "update")
    newest = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.desc("batch")))
    return spark.read.parquet(path).withColumn("rn", newest).where("rn = 1").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def _bar_files(spark, d, part, parts: int) -> DataFrame:
    """Bars of the event stream landed in `parts` files, one a batch, by the arrival number `part`; the last file only carries the time on."""
    b = intraday(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    end = b.agg(F.max("ts").alias("ts")).select(F.lit("~").alias("symbol"), F.col("ts") + F.expr("interval 40 days"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("close"), F.lit(0).cast("long").alias("volume"))
    folder = stream.new_folder(spark, "bars")
    for k in range(parts):
        b.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    end.toDF("symbol", "ts", "event_id", "close", "volume").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(folder)


_LATE = f"""WITH {INTRADAY}, m AS (SELECT *, event_id % 20 = 0 AS second FROM intraday), wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 DAY AS wm FROM m WHERE NOT second AND event_id < (SELECT max(event_id) FROM m)), k AS (SELECT m.*, second AND ts <= wm AS late FROM m, wm)"""


@_query("t11_t12_chained_roll_up", f"""{_LATE} SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, first(close ORDER BY ts, event_id) AS open, max(close) AS high, min(close) AS low, last(close ORDER BY ts, event_id) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n FROM k WHERE NOT late GROUP BY symbol, date_trunc('day', ts)
UNION ALL SELECT '(late)', NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM k WHERE late""")
def t11_chained(spark, d):
    """Days by way of minutes and hours in one stream. One event in twenty comes in a last file, after a watermark of ten days: older ones are counted.

    The last event comes by itself between the two: rows are late by the watermark that was in force a batch before, at which windows were closed.
    """
    path = stream.new_folder(spark, "days")
    newest = read(spark, d, "events").agg(F.max("event_id")).first()[0]
    part = F.when(F.col("event_id") % 20 == 0, 2).when(F.col("event_id") == newest, 1).otherwise(0)
    late = stream.drained_counting(stream.chained(_bar_files(spark, d, part, 3), "10 days"), path)
    days = spark.read.parquet(path).where("symbol <> '~'").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", "n")
    none = [F.lit(None).cast(days.schema[c].dataType).alias(c) for c in ("ts", "open", "high", "low", "close", "volume")]
    return days.unionByName(spark.range(1).select(F.lit("(late)").alias("symbol"), *none, F.lit(late).cast("long").alias("n")))


@_query("t10_stream_silences", f"""WITH {INTRADAY}, b AS (SELECT symbol, epoch_us(ts) // 1000 AS ms, ntile(6) OVER (ORDER BY event_id) - 1 AS part FROM intraday), p AS (SELECT symbol, part, max(ms) AS newest FROM b GROUP BY ALL), wm AS (SELECT part, max(max(newest)) OVER (ORDER BY part) AS wm FROM p GROUP BY part),
l AS (SELECT symbol, part, newest, lead(newest) OVER w AS after, lead(part) OVER w AS next_part FROM p WINDOW w AS (PARTITION BY symbol ORDER BY part)),
s AS (SELECT l.*, (SELECT max(wm) FROM wm WHERE next_part IS NULL OR wm.part < next_part - 1) AS seen FROM l),
o AS (SELECT symbol, newest AS "last", newest + 120000 AS told, 'refill' AS kind FROM s WHERE next_part IS NULL OR seen >= newest + 120000 UNION ALL SELECT symbol, newest, newest + 7200001, 'skip' FROM s WHERE next_part IS NULL OR seen >= newest + 7200001
 UNION ALL SELECT symbol, was, ms, 'reconnect' FROM (SELECT symbol, ms, lag(ms) OVER (PARTITION BY symbol ORDER BY ms) AS was FROM b) WHERE ms - was >= 120000)
SELECT symbol, make_timestamp("last" * 1000) AS "last", make_timestamp(told * 1000) AS "at", kind, CAST(floor((told - "last") / 60000) AS BIGINT) AS minutes FROM o""")
def t10_stream(spark, d):
    """Silences told by timers as the stream's time goes on: six files in order of time."""
    landed = scans.tiled(intraday(spark, d).withColumn("__all", F.lit(0)), ["__all"], ["event_id"], 6, "part")  # arrival numbers, in blocks
    parts = written(landed.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", "close", "volume", (F.col("part") - 1).alias("part")), "landed")  # each file's task only copies rows
    folder = stream.new_folder(spark, "bars")
    for k in range(6):
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    end = parts.agg(F.max("ts").alias("ts")).select(F.lit("~").alias("symbol"), (F.col("ts") + F.expr("interval 40 days")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("close"), F.lit(0).cast("long").alias("volume"))
    end.coalesce(1).write.mode("append").parquet(folder)
    bars_ = spark.readStream.schema(parts.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return stream.silences(bars_).where("symbol <> '~'").select("symbol", at("last"), at("at"), "kind", "minutes")
