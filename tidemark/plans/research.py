"""Queries of factor research (R01-R29; R13 is the momentum screen of the feature queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features
from ..operators import research as rs
from ..session import tasks, written
from ..sources.views import BARS, TRADES, bars, r, read, sql_r, trades
from .features import _SQL, _STAGES

QUERIES, ORACLE = {}, {}


def _query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_NAMES = ["momentum_20d", "volatility_20d"]
_PANEL = f"""{_STAGES}, panel AS (SELECT symbol, date, p AS close, {_SQL['momentum_20d']} AS momentum_20d, {_SQL['volatility_20d']} AS volatility_20d,
lead(p, 5) OVER w / p - 1 AS f5, lead(p, 20) OVER w / p - 1 AS f20, r1 FROM s3 WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def panel(spark, d) -> DataFrame:
    """Two features and forward returns over 5 and 20 rows, one shuffle."""
    f = features.window_features(bars(spark, d), [*_NAMES, "returns_1d"]).withColumnRenamed("p", "close").withColumnRenamed("returns_1d", "r1")
    return f.withColumn("f5", rs.forward_return(5)).withColumn("f20", rs.forward_return(20))


@_query("r01_forward_returns", f"WITH {BARS} SELECT symbol, date, " + ", ".join(f"{sql_r(f'lead(close, {h}) OVER w / close - 1')} AS fwd_{h}" for h in (5, 10, 20)) + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def r01(spark, d):
    return bars(spark, d).select("symbol", "date", *[r(rs.forward_return(h)).alias(f"fwd_{h}") for h in (5, 10, 20)])


@_query("r02_feature_with_forward_return", f"WITH {_PANEL} SELECT symbol, date, {sql_r('momentum_20d')} AS momentum_20d, {sql_r('f20')} AS f20 FROM panel WHERE momentum_20d IS NOT NULL AND f20 IS NOT NULL")
def r02(spark, d):
    return panel(spark, d).where("momentum_20d is not null and f20 is not null").select("symbol", "date", r("momentum_20d").alias("momentum_20d"), r("f20").alias("f20"))


def _long(spark, d) -> DataFrame:
    p = panel(spark, d)
    each = [F.struct(F.lit(f).alias("feature"), F.lit(h).alias("horizon"), F.col(f).alias("x"), F.col(f"f{h}").alias("y")) for f in _NAMES for h in (5, 20)]
    return p.select("symbol", "date", F.explode(F.array(*each)).alias("e")).select("symbol", "date", "e.*")


_IC = _PANEL + ", long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {h} AS horizon, symbol, date, {f} AS x, f{h} AS y FROM panel WHERE {f} IS NOT NULL AND f{h} IS NOT NULL" for f in _NAMES for h in (5, 20)) + """),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY feature, horizon, symbol) AS n FROM long WINDOW w AS (PARTITION BY feature, horizon, symbol ORDER BY date)),
pairs AS (SELECT a.feature, a.horizon, a.symbol, a.i, b.x, b.y FROM n a JOIN n b ON a.feature = b.feature AND a.horizon = b.horizon AND a.symbol = b.symbol AND b.i BETWEEN a.i - 59 AND a.i WHERE a.i >= 60 AND a.i < a.n),
ranked AS (SELECT feature, horizon, symbol, i, rank() OVER (PARTITION BY feature, horizon, symbol, i ORDER BY x) + (count(*) OVER (PARTITION BY feature, horizon, symbol, i, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY feature, horizon, symbol, i ORDER BY y) + (count(*) OVER (PARTITION BY feature, horizon, symbol, i, y) - 1) / 2.0 AS ry FROM pairs),
ics AS (SELECT feature, horizon, symbol, i, corr(rx, ry) AS ic FROM ranked GROUP BY ALL),
summary AS (SELECT feature, CAST(horizon AS INTEGER) AS horizon, avg(ic) AS mean_ic, greatest(stddev_pop(ic), 1e-8) AS std_ic, avg(ic) / greatest(stddev_pop(ic), 1e-8) AS ir, count(ic) AS n FROM ics GROUP BY ALL)"""


@_query("r03_r06_rolling_rank_ic", f"WITH {_IC} SELECT feature, horizon, {sql_r('mean_ic')} AS mean_ic, {sql_r('std_ic')} AS std_ic, {sql_r('ir')} AS ir, n, CASE WHEN abs(mean_ic) >= 0.05 THEN 'strong' WHEN abs(mean_ic) >= 0.03 THEN 'moderate' WHEN abs(mean_ic) >= 0.02 THEN 'weak' ELSE 'none' END AS strength FROM summary")
def r03(spark, d):
    s = rs.ic_summary(rs.rolling_rank_ic(_long(spark, d)))
    return s.select("feature", "horizon", r("mean_ic").alias("mean_ic"), r("std_ic").alias("std_ic"), r("ir").alias("ir"), "n", rs.classify(F.col("mean_ic")).alias("strength"))


_RANK = lambda c: f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY date) END"


@_query("r04_r05_composite_ranks", f"WITH {_PANEL}, k AS (SELECT symbol, date, {_RANK('momentum_20d')} AS a, {_RANK('volatility_20d')} AS b, count(*) OVER (PARTITION BY date) AS names FROM panel) SELECT symbol, date, {sql_r('a', 6)} AS rank_momentum, {sql_r('a - b', 6)} AS composite FROM k WHERE names >= 5")
def r04(spark, d):
    p = panel(spark, d).select("symbol", "date", "momentum_20d", "volatility_20d")
    p = p.repartition(tasks(p, 2), "date")  # four sorts of a task's dates follow
    k = p.select("symbol", "date", rs.percent_rank(F.col("momentum_20d"), "date").alias("a"), rs.percent_rank(F.col("volatility_20d"), "date").alias("b"), F.count("*").over(Window.partitionBy("date")).alias("names"))
    return k.where("names >= 5").select("symbol", "date", r("a", 6).alias("rank_momentum"), r(F.col("a") - F.col("b"), 6).alias("composite"))


@_query("r07_r09_signals", f"""WITH {_PANEL}, q AS (SELECT *, round(momentum_20d, 9) AS m FROM panel) SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY date ORDER BY m DESC NULLS LAST, symbol) <= greatest(1, ceil(count(*) OVER (PARTITION BY date) * 0.1)) THEN CAST(1 AS DOUBLE) ELSE 0 END AS rank_signal,
CASE WHEN m >= 0.05 THEN CAST(1 AS DOUBLE) ELSE 0 END AS threshold_signal, CASE WHEN m IS NOT NULL THEN {sql_r('CASE WHEN stddev_samp(m) OVER (PARTITION BY date) > 1e-12 THEN (m - avg(m) OVER (PARTITION BY date)) / stddev_samp(m) OVER (PARTITION BY date) ELSE 0 END')} END AS zscore FROM q""")
def r07(spark, d):
    p = panel(spark, d).withColumn("m", F.round("momentum_20d", 9))
    return p.select("symbol", "date", rs.rank_signal("m", 0.1).alias("rank_signal"), rs.threshold_signal("m", 0.05).alias("threshold_signal"), r(rs.zscore("m", "date")).alias("zscore"))


@_query("r10_momentum_top_n", f"WITH {_PANEL}, q AS (SELECT *, round(momentum_20d, 9) AS m FROM panel), k AS (SELECT symbol, date, CASE WHEN m IS NOT NULL THEN rank() OVER (PARTITION BY date, m IS NULL ORDER BY -m) + (count(*) OVER (PARTITION BY date, m) - 1) / 2.0 END AS k FROM q) SELECT symbol, date, CASE WHEN k <= 10 THEN CAST(1 AS DOUBLE) ELSE 0 END AS signal FROM k")
def r10(spark, d):
    p = panel(spark, d).withColumn("m", F.round("momentum_20d", 9))
    return p.select("symbol", "date", F.when(rs.average_rank(-F.col("m"), "date") <= 10, 1.0).otherwise(0.0).alias("signal"))


_Z = lambda c: f"CASE WHEN stddev_samp({c}) OVER (PARTITION BY date) > 1e-12 THEN ({c} - avg({c}) OVER (PARTITION BY date)) / stddev_samp({c}) OVER (PARTITION BY date) ELSE 0 END"


@_query("r11_multi_factor", f"WITH {_PANEL}, k AS (SELECT symbol, date, CASE WHEN momentum_20d IS NOT NULL AND volatility_20d IS NOT NULL THEN {sql_r(f'0.7 * ({_Z('momentum_20d')}) - 0.3 * ({_Z('volatility_20d')})', 6)} END AS composite FROM panel) SELECT symbol, date, composite, CASE WHEN composite IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY composite DESC NULLS LAST, symbol) <= 10 THEN CAST(1 AS DOUBLE) ELSE 0 END AS signal FROM k")
def r11(spark, d):
    p = panel(spark, d).withColumn("composite", r(0.7 * rs.zscore("momentum_20d", "date") - 0.3 * rs.zscore("volatility_20d", "date"), 6))
    top = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("composite"), "symbol"))
    return p.select("symbol", "date", "composite", F.when(F.col("composite").isNotNull() & (top <= 10), 1.0).otherwise(0.0).alias("signal"))


@_query("r12_ensemble", f"WITH {TRADES} SELECT symbol, {sql_r('avg(prediction)', 6)} AS prediction, max(CASE WHEN prediction > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS signal FROM trades GROUP BY symbol")
def r12(spark, d):
    return trades(spark, d).groupBy("symbol").agg(r(F.avg("prediction"), 6).alias("prediction"), F.max(F.when(F.col("prediction") > 0, 1.0).otherwise(0.0)).alias("signal"))


_FOLDS = """days AS (SELECT date, row_number() OVER (ORDER BY date) AS day, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
folds AS (SELECT k + 1 AS fold, n - 4 * 300 + k * 300 + 1 AS test_start, CASE WHEN k < 3 THEN n - 4 * 300 + k * 300 + 300 ELSE n END AS test_end FROM (SELECT DISTINCT n FROM days), (SELECT unnest(range(4)) AS k))"""


def _folded(spark, d):
    p = panel(spark, d)
    days = written(p.select("date").distinct(), "days")  # one row a date
    return rs.with_folds(p, rs.fold_table(days.count(), 4, 300, purge=5), days)


@_query("r14_fold_table", f"WITH {_PANEL}, {_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN day >= test_start THEN 'test' ELSE 'train' END AS role, count(*) AS n, min(panel.date) AS first_date, max(panel.date) AS last_date FROM panel JOIN days USING (date) JOIN folds ON day BETWEEN test_start AND test_end OR day BETWEEN 1 AND test_start - 6 GROUP BY ALL")
def r14(spark, d):
    return _folded(spark, d).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_METRICS = f"""WITH {_PANEL}, {_FOLDS}, t AS (SELECT CAST(fold AS INTEGER) AS fold, f5 AS y, momentum_20d * 0.1 AS p FROM panel JOIN days USING (date) JOIN folds ON day BETWEEN test_start AND test_end WHERE f5 IS NOT NULL AND momentum_20d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fold ORDER BY date, symbol) > 10 OR count(*) OVER (PARTITION BY fold) <= 10),
k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY y) + (count(*) OVER (PARTITION BY fold, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rp FROM t),
m AS (SELECT fold, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, corr(ry, rp) AS ic, count(*) AS n FROM k GROUP BY fold)"""


def _metrics(spark, d):
    t = _folded(spark, d).where("role = 'test' and f5 is not null and momentum_20d is not null").withColumn("p", F.col("momentum_20d") * 0.1)
    t = written(t.select("fold", "date", "symbol", "f5", "p"), "test_rows")  # read by range, counted and scanned
    return rs.fold_metrics(rs.after_embargo(t, 10, "fold"), "f5", "p", "fold")


@_query("r15_fold_metrics", _METRICS + f" SELECT fold, {sql_r('mse')} AS mse, {sql_r('mae')} AS mae, {sql_r('r2')} AS r2, {sql_r('ic')} AS ic, n FROM m")
def r15(spark, d):
    return _metrics(spark, d).select("fold", *[r(c).alias(c) for c in ("mse", "mae", "r2", "ic")], "n")


@_query("r16_fold_stability", _METRICS + f" SELECT {sql_r('avg(mse)')} AS mean_mse, {sql_r('stddev_pop(mse)')} AS std_mse, {sql_r('stddev_pop(mse) / avg(mse)')} AS stability, stddev_pop(mse) / avg(mse) <= 1 AS stable FROM m")
def r16(spark, d):
    s = F.stddev_pop("mse") / F.avg("mse")
    return _metrics(spark, d).agg(r(F.avg("mse")).alias("mean_mse"), r(F.stddev_pop("mse")).alias("std_mse"), r(s).alias("stability"), (s <= 1).alias("stable"))


@_query("r17_training_set", f"WITH {_PANEL} SELECT symbol, date, {sql_r('momentum_20d')} AS momentum_20d, {sql_r('volatility_20d')} AS volatility_20d, {sql_r('f5')} AS target, CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-01-01' THEN 'validation' ELSE 'test' END AS split FROM panel WHERE momentum_20d IS NOT NULL AND volatility_20d IS NOT NULL AND f5 IS NOT NULL")
def r17(spark, d):
    p = panel(spark, d).dropna(subset=["momentum_20d", "volatility_20d", "f5"])
    split = F.when(F.col("date") < "1999-01-01", "train").when(F.col("date") < "2000-01-01", "validation").otherwise("test")
    return p.select("symbol", "date", r("momentum_20d").alias("momentum_20d"), r("volatility_20d").alias("volatility_20d"), r("f5").alias("target"), split.alias("split"))


@_query("r18_linear_model_per_fold", f"WITH {_PANEL}, {_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, {sql_r('regr_slope(f5, momentum_20d)', 3)} AS slope, {sql_r('regr_intercept(f5, momentum_20d)', 3)} AS intercept FROM panel JOIN days USING (date) JOIN folds ON day BETWEEN 1 AND test_start - 6 WHERE f5 IS NOT NULL AND momentum_20d IS NOT NULL GROUP BY ALL")
def r18(spark, d):
    """Least squares of the 5-row return on momentum, on each fold's training rows: all folds in one aggregation."""
    t = _folded(spark, d).where("role = 'train' and f5 is not null and momentum_20d is not null")
    return t.groupBy("fold").agg(r(F.regr_slope("f5", "momentum_20d"), 3).alias("slope"), r(F.regr_intercept("f5", "momentum_20d"), 3).alias("intercept"))


_REFIT = f"""WITH {_PANEL}, g AS (SELECT *, CASE WHEN f5 IS NOT NULL THEN least(greatest(f5, -1), 1) END AS y, CASE WHEN momentum_20d IS NOT NULL THEN least(greatest(momentum_20d, -1), 1) END AS a, CASE WHEN volatility_20d IS NOT NULL THEN least(volatility_20d, 100) / 100 END AS b FROM panel), dly AS (SELECT date, count(*) FILTER (ok) AS n, coalesce(sum(y) FILTER (ok), 0) AS sy, coalesce(sum(a) FILTER (ok), 0) AS sa, coalesce(sum(b) FILTER (ok), 0) AS sb, coalesce(sum(a * y) FILTER (ok), 0) AS say, coalesce(sum(b * y) FILTER (ok), 0) AS sby, coalesce(sum(a * a) FILTER (ok), 0) AS saa, coalesce(sum(a * b) FILTER (ok), 0) AS sab, coalesce(sum(b * b) FILTER (ok), 0) AS sbb FROM (SELECT *, y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AS ok FROM g) GROUP BY date),
nd AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS day FROM dly), rl AS (SELECT date, day, sum(n) OVER w AS n, sum(sy) OVER w AS sy, sum(sa) OVER w AS sa, sum(sb) OVER w AS sb, sum(say) OVER w AS say, sum(sby) OVER w AS sby, sum(saa) OVER w AS saa, sum(sab) OVER w AS sab, sum(sbb) OVER w AS sbb FROM nd WINDOW w AS (ORDER BY date ROWS BETWEEN 400 PRECEDING AND 6 PRECEDING)),
c AS (SELECT *, saa - sa * sa / n + 1 AS qa, sab - sa * sb / n AS qb, sbb - sb * sb / n + 1 AS qc, say - sa * sy / n AS pa, sby - sb * sy / n AS pb FROM rl WHERE day >= 400 AND (day - 400) % 40 = 0 AND n >= 50), f AS (SELECT date AS refit_date, sy, sa, sb, n, (pa * qc - pb * qb) / (qa * qc - qb * qb) AS ba, (qa * pb - qb * pa) / (qa * qc - qb * qb) AS bb FROM c),
o AS (SELECT symbol, refit_date, (sy - ba * sa - bb * sb) / n + ba * a + bb * b AS prediction FROM g JOIN f ON date = refit_date WHERE a IS NOT NULL AND b IS NOT NULL),
pl AS (SELECT date, last_value(CASE WHEN day >= 400 AND (day - 400) % 40 = 0 THEN date END IGNORE NULLS) OVER (ORDER BY date) AS refit_date FROM nd)"""


@_query("r18_refit_and_carry", _REFIT + f" SELECT g.symbol, g.date, pl.refit_date, {sql_r('o.prediction')} AS prediction FROM g JOIN pl USING (date) JOIN o ON o.symbol = g.symbol AND o.refit_date = pl.refit_date")
def r18_refit(spark, d):
    """Two-feature ridge refitted every 40 dates on 400 before; predictions carried forward. Features and target are bounded first."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(-1.0)), F.lit(1.0))
    both = F.when(F.col("f5").isNotNull(), clip("f5")).alias("y"), F.when(F.col("momentum_20d").isNotNull(), clip("momentum_20d")).alias("a"), F.when(F.col("volatility_20d").isNotNull(), F.least("volatility_20d", F.lit(100.0)) / 100).alias("b")
    p = rs.refit_predictions(panel(spark, d).select("symbol", "date", *both), ["a", "b"], "y", 400, 40, 5, ridge=1.0)
    return p.select("symbol", "date", "refit_date", r("prediction").alias("prediction"))


_PENALTIES = [("lasso", 0.001, 1.0), ("lasso", 0.02, 1.0), ("elastic_net", 0.001, 0.5), ("elastic_net", 0.02, 0.5), ("ridge", 0.02, 0.0)]
_SOFT = lambda pull, q: f"CASE WHEN ({q}) / n + alpha * (1 - ratio) = 0 THEN 0 ELSE sign({pull}) * greatest(abs({pull}) - alpha * ratio, 0) / (({q}) / n + alpha * (1 - ratio)) END"
_NET = f"""WITH RECURSIVE {_PANEL}, {_FOLDS}, g AS (SELECT CAST(fold AS INTEGER) AS fold, least(greatest(f5, -1), 1) AS y, least(greatest(momentum_20d, -1), 1) AS a, least(volatility_20d, 100) / 100 AS b FROM panel JOIN days USING (date) JOIN folds ON day BETWEEN 1 AND test_start - 6 WHERE f5 IS NOT NULL AND momentum_20d IS NOT NULL AND volatility_20d IS NOT NULL),
s AS (SELECT fold, CAST(count(*) AS DOUBLE) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) * count(*) AS qa, covar_pop(a, b) * count(*) AS qab, covar_pop(b, b) * count(*) AS qb, covar_pop(a, y) * count(*) AS pa, covar_pop(b, y) * count(*) AS pb FROM g GROUP BY fold),
p AS (SELECT s.*, v.* FROM s, (VALUES {", ".join(f"('{k}', CAST({a} AS DOUBLE), CAST({q} AS DOUBLE))" for k, a, q in _PENALTIES)}) v(family, alpha, ratio)),
c AS (SELECT *, 0 AS i, CAST(0 AS DOUBLE) AS ba, CAST(0 AS DOUBLE) AS bb FROM p UNION ALL SELECT * EXCLUDE (i, ba, bb, na), i + 1, na, {_SOFT("(pb - qab * na) / n", "qb")} FROM (SELECT *, {_SOFT("(pa - qab * bb) / n", "qa")} AS na FROM c WHERE i < 200))"""


@_query("r18_lasso_elastic_net", f"{_NET} SELECT fold, family, alpha, {sql_r('ba', 6)} AS momentum, {sql_r('bb', 6)} AS volatility, {sql_r('my - ba * ma - bb * mb', 6)} AS intercept FROM c WHERE i = 200")
def r18_penalised(spark, d):
    """Five penalties on every fold's training rows, from one aggregation of cross-products."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(-1.0)), F.lit(1.0))
    t = _folded(spark, d).where("role = 'train' and f5 is not null and momentum_20d is not null and volatility_20d is not null").select("fold", clip("f5").alias("y"), clip("momentum_20d").alias("a"), (F.least("volatility_20d", F.lit(100.0)) / 100).alias("b"))
    kinds = spark.createDataFrame(_PENALTIES, "family string, alpha double, ratio double")
    each = rs.cross_products(t, ["a", "b"], "y", "fold").join(F.broadcast(kinds))  # five rows
    fit = rs.penalised(each, "alpha", "ratio")
    return fit.select("fold", "family", "alpha", r(F.get("beta", F.lit(0)), 6).alias("momentum"), r(F.get("beta", F.lit(1)), 6).alias("volatility"), r("intercept", 6).alias("intercept"))


_LONGSQL = _PANEL + ", long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, symbol, date, round({f}, 9) AS x, round(f5, 9) AS y, {f} AS fx, f5 AS fy FROM panel WHERE {f} IS NOT NULL AND f5 IS NOT NULL" for f in _NAMES) + ")"


def _two(spark, d):
    return _long(spark, d).where("horizon = 5 and x is not null and y is not null")


@_query("r19_binned_information", f"WITH {_LONGSQL}, b AS (SELECT feature, ntile(10) OVER (PARTITION BY feature ORDER BY x, date, symbol) AS bx, ntile(10) OVER (PARTITION BY feature ORDER BY y, date, symbol) AS b2 FROM long), c AS (SELECT feature, bx, b2, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) * ln(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature, bx) * sum(n) OVER (PARTITION BY feature, b2))) AS term FROM c) SELECT feature, {sql_r('sum(term)')} AS information FROM t GROUP BY feature")
def r19(spark, d):
    p = _two(spark, d).withColumn("x", F.round("x", 9)).withColumn("y", F.round("y", 9))
    return rs.binned_information(p, "x", "y", 10, "feature").select("feature", r("information").alias("information"))


@_query("r20_leakage", f"WITH {_LONGSQL}, c AS (SELECT feature, corr(fx, fy) AS c FROM long GROUP BY feature UNION ALL SELECT 'forward_5d', corr(fy, fy) FROM long WHERE feature = 'momentum_20d') SELECT feature, {sql_r('c')} AS corr, CASE WHEN abs(c) >= 0.95 THEN 'critical' WHEN abs(c) >= 0.85 THEN 'warning' WHEN regexp_matches(lower(feature), 'future|next|forward|lead|target|t\\+\\d') THEN 'name' ELSE 'ok' END AS severity FROM c")
def r20(spark, d):
    t = _two(spark, d)
    t = t.select("feature", "x", "y").union(t.where("feature = 'momentum_20d'").select(F.lit("forward_5d"), "y", "y"))
    return t.groupBy("feature").agg(F.corr("x", "y").alias("c")).select("feature", r("c").alias("corr"), rs.leakage(F.col("c"), F.col("feature")).alias("severity"))


@_query("r21_experiment_audits", _METRICS + f" SELECT {sql_r('stddev_pop(ic) / abs(avg(ic))')} AS ic_cv, count(*) FILTER (ic < 0) AS n_negative, CASE WHEN count(*) FILTER (ic < 0) BETWEEN 1 AND count(*) - 1 THEN 'sign_flips' ELSE 'ok' END AS signs, bool_or(ic > 0.5) AS suspicious, {sql_r('sum(n) / 2.0', 2)} AS samples_per_feature FROM m")
def r21(spark, d):
    neg = F.count_if(F.col("ic") < 0)
    return _metrics(spark, d).agg(r(F.stddev_pop("ic") / F.abs(F.avg("ic"))).alias("ic_cv"), neg.alias("n_negative"), F.when(neg.between(1, F.count("*") - 1), "sign_flips").otherwise("ok").alias("signs"), F.bool_or(F.col("ic") > 0.5).alias("suspicious"), r(F.sum("n") / 2.0, 2).alias("samples_per_feature"))


@_query("r22_r24_parameter_sweep", f"""WITH {_PANEL}, c AS (SELECT * FROM (SELECT unnest([5, 10, 25]) AS top) , (SELECT unnest([0.0, 0.05, 0.1]) AS threshold)), k AS (SELECT date, f5, round(momentum_20d, 9) AS m, row_number() OVER (PARTITION BY date ORDER BY round(momentum_20d, 9) DESC NULLS LAST, symbol) AS rn FROM panel),
e AS (SELECT top, threshold, year(date) AS year, avg(f5) AS mean, stddev_samp(f5) AS sd, count(f5) AS n FROM k JOIN c ON rn <= top AND m >= threshold WHERE top * (1 + threshold) <= 27 GROUP BY ALL)
SELECT CAST(top AS DOUBLE) AS top, CAST(threshold AS DOUBLE) AS threshold, {sql_r('median(mean / nullif(sd, 0))')} AS median_sharpe, {sql_r('max(mean / nullif(sd, 0))')} AS best_sharpe, count(*) AS years FROM e GROUP BY ALL""")
def r22(spark, d):
    """Every valid combination of two parameters, evaluated per year in one plan: the sweep is a small table joined to the ranked panel."""
    combos = rs.combinations({"top": [5, 10, 25], "threshold": [0.0, 0.05, 0.1]}, {"size": F.col("top") * (1 + F.col("threshold")) <= 27}, spark).where(F.size("broken") == 0)
    k = panel(spark, d).withColumn("m", F.round("momentum_20d", 9)).withColumn("rn", F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("m"), "symbol"))).where("rn <= 25")
    e = k.join(F.broadcast(combos), (F.col("rn") <= F.col("top")) & (F.col("m") >= F.col("threshold"))).groupBy("top", "threshold", F.year("date").alias("year")).agg(F.avg("f5").alias("mean"), F.stddev_samp("f5").alias("sd"))
    s = F.try_divide("mean", "sd")
    return e.groupBy("top", "threshold").agg(r(F.median(s)).alias("median_sharpe"), r(F.max(s)).alias("best_sharpe"), F.count("*").alias("years"))


@_query("r23_train_test_gap", f"""WITH {_PANEL}, {_FOLDS}, s AS (SELECT CAST(fold AS INTEGER) AS fold, avg(r1) FILTER (day >= test_start) / stddev_samp(r1) FILTER (day >= test_start) - avg(r1) FILTER (day < test_start) / stddev_samp(r1) FILTER (day < test_start) AS gap FROM panel JOIN days USING (date) JOIN folds ON day BETWEEN test_start AND test_end OR day BETWEEN 1 AND test_start - 6 GROUP BY fold)
SELECT {sql_r('avg(gap)')} AS mean_gap, {sql_r('median(gap)')} AS median_gap, {sql_r('avg(CASE WHEN gap >= 0 THEN 1.0 ELSE 0 END)')} AS share_not_worse FROM s""")
def r23(spark, d):
    x = lambda role: F.avg(F.when(F.col("role") == role, F.col("r1"))) / F.stddev_samp(F.when(F.col("role") == role, F.col("r1")))
    gap = _folded(spark, d).groupBy("fold").agg((x("test") - x("train")).alias("gap"))
    return gap.agg(r(F.avg("gap")).alias("mean_gap"), r(F.median("gap")).alias("median_gap"), r(F.avg(F.when(F.col("gap") >= 0, 1.0).otherwise(0.0))).alias("share_not_worse"))


_KINDS = {
    "sum_equals": (["q", "d", "t"], 30, None), "max_total": (["q", "d"], 50, None), "min_total": (["q", "t"], 5, None), "difference_min": (["q", "d"], 3, None), "difference_max": (["q", "t"], 40, None), "ratio_bound": (["q", "d"], 2, 30), "exclusion": (["d", "t"], 0, None),
    "range_bound": (["q"], 10, 45), "product_max": (["q", "d", "t"], 900, None), "product_min": (["q", "t"], 20, None), "same_sign": (["m", "q"], 0, None), "step_multiple": (["q"], 5, None), "monotonic_increasing": (["t", "d", "q"], 0, None), "at_least_n_nonzero": (["q", "d", "t"], 3, None),
}
_KSQL = {
    "sum_equals": "abs(q + d + t - 30) <= 1e-8 + 3e-4", "max_total": "q + d <= 50", "min_total": "q + t >= 5", "difference_min": "q - d >= 3", "difference_max": "q - t <= 40", "ratio_bound": "d = 0 OR q / d BETWEEN 2 AND 30", "exclusion": "d = 0 OR t = 0",
    "range_bound": "q BETWEEN 10 AND 45", "product_max": "q * d * t <= 900", "product_min": "q * t >= 20", "same_sign": "m >= 0", "step_multiple": "q % 5 = 0", "monotonic_increasing": "t < d AND d < q", "at_least_n_nonzero": "q <> 0 AND d <> 0 AND t <> 0",
}


@_query("r22_constraint_kinds", "WITH c AS (SELECT l_quantity AS q, round(l_discount * 100) AS d, round(l_tax * 100) AS t, round(l_discount * 100) - 5 AS m FROM lineitem), v AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {x} AS ok FROM c" for k, x in _KSQL.items()) + ") SELECT kind, count(*) AS n, count(*) FILTER (NOT ok) AS violations FROM v GROUP BY kind UNION ALL SELECT 'all', count(*), count(*) FILTER (NOT (" + " AND ".join(f"({x})" for x in _KSQL.values()) + ")) FROM c")
def r22_kinds(spark, d):
    """Violations of each kind of constraint, and of any, by a table of combinations: the line items' quantity, discount and tax."""
    li = read(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.round(F.col("l_discount") * 100).alias("d"), F.round(F.col("l_tax") * 100).alias("t"), (F.round(F.col("l_discount") * 100) - 5).alias("m"))
    c = rs.checked(li, {k: rs.holds(k, *at) for k, at in _KINDS.items()})
    each = c.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("broken", k)).alias(k) for k in _KINDS], F.count_if(F.size("broken") > 0).alias("all"))
    return each.unpivot(["n"], [*_KINDS, "all"], "kind", "violations").select("kind", "n", "violations")


@_query("r21_sharpe_decay", f"""WITH {_PANEL}, {_FOLDS}, s AS (SELECT CAST(fold AS INTEGER) AS fold, avg(r1) FILTER (day < test_start) / stddev_samp(r1) FILTER (day < test_start) AS train, avg(r1) FILTER (day >= test_start) / stddev_samp(r1) FILTER (day >= test_start) AS test FROM panel JOIN days USING (date) JOIN folds ON day BETWEEN test_start AND test_end OR day BETWEEN 1 AND test_start - 6 GROUP BY fold),
e AS (SELECT *, CASE WHEN test < 0 THEN 1 WHEN train <= 0 THEN 0 ELSE greatest(0, (train - test) / train) END AS decay FROM s) SELECT fold, {sql_r('train')} AS train_sharpe, {sql_r('test')} AS test_sharpe, {sql_r('decay')} AS decay, CASE WHEN decay > 0.5 THEN 'critical' WHEN decay > 0.3 THEN 'warning' ELSE 'ok' END AS level FROM e""")
def r21_decay(spark, d):
    x = lambda role: F.avg(F.when(F.col("role") == role, F.col("r1"))) / F.stddev_samp(F.when(F.col("role") == role, F.col("r1")))
    s = _folded(spark, d).groupBy("fold").agg(x("train").alias("train"), x("test").alias("test")).withColumn("decay", rs.sharpe_decay(F.col("train"), F.col("test")))
    level = F.when(F.col("decay") > 0.5, "critical").when(F.col("decay") > 0.3, "warning").otherwise("ok")
    return s.select("fold", r("train").alias("train_sharpe"), r("test").alias("test_sharpe"), r("decay").alias("decay"), level.alias("level"))


@_query("r25_multiple_testing", f"""WITH {TRADES}, t AS (SELECT symbol, round(1 / (1 + abs(avg(prediction)) * sqrt(count(*))), 9) AS p FROM trades GROUP BY symbol), k AS (SELECT *, row_number() OVER (ORDER BY p, symbol) AS rank, count(*) OVER () AS n FROM t)
SELECT symbol, {sql_r('p', 6)} AS p, CAST(rank AS INTEGER) AS rank, p <= 0.1 / n AS bonferroni, rank <= coalesce(max(CASE WHEN p <= rank * 0.1 / n THEN rank END) OVER (), 0) AS bh FROM k""")
def r25(spark, d):
    t = trades(spark, d).groupBy("symbol").agg(F.round(1 / (1 + F.abs(F.avg("prediction")) * F.sqrt(F.count("*"))), 9).alias("p"))
    return rs.corrected(t, "symbol", 0.1).withColumn("p", r("p", 6))


_LABEL = f"{_STAGES}, lab AS (SELECT symbol, date, r1, CASE WHEN v IS NOT NULL AND m IS NOT NULL THEN CASE WHEN v < 9 THEN 'low_vol' ELSE 'high_vol' END || CASE WHEN p > m THEN '_bull' ELSE '_bear' END END AS label FROM (SELECT *, {_SQL['volatility_20d']} AS v, {_SQL['sma_50d']} AS m FROM s3))"


def _labelled(spark, d):
    f = features.window_features(bars(spark, d), ["volatility_20d", "sma_50d", "returns_1d"])
    return f.withColumn("label", rs.regime("volatility_20d", "p", "sma_50d", 9.0))


@_query("r26_r27_regime_runs", f"WITH {_LABEL}, x AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER w AND lag(date) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM lab WINDOW w AS (PARTITION BY symbol ORDER BY date)), y AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY date) AS island FROM x) SELECT symbol, label, min(date) AS start, max(date) AS \"end\", count(*) AS length FROM y GROUP BY symbol, island, label HAVING count(*) >= 5")
def r26(spark, d):
    return rs.runs(_labelled(spark, d), "label").where("length >= 5")


_PERIODS = f"""WITH {_LABEL}, g AS (SELECT 'year:' || year(date) AS period, symbol, date, r1 FROM lab WHERE r1 IS NOT NULL UNION ALL SELECT label, symbol, date, r1 FROM lab WHERE r1 IS NOT NULL AND label IS NOT NULL),
m AS (SELECT period, date, avg(r1) AS r FROM g GROUP BY ALL), c AS (SELECT *, sum(r) OVER (PARTITION BY period ORDER BY date) AS cum FROM m), dd AS (SELECT *, max(cum) OVER (PARTITION BY period ORDER BY date) - cum AS down FROM c),
s AS (SELECT period, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, max(down) AS drawdown FROM dd GROUP BY period)"""


def _periods(spark, d):
    f = _labelled(spark, d).where("returns_1d is not null")
    g = f.select(F.explode(F.array(F.concat(F.lit("year:"), F.year("date").cast("string")), "label")).alias("period"), "date", "returns_1d").where("period is not null")
    m = g.groupBy("period", "date").agg(F.avg("returns_1d").alias("r"))
    w = Window.partitionBy("period").orderBy("date")
    c = m.withColumn("cum", F.sum("r").over(w))
    down = c.withColumn("down", F.max("cum").over(w) - F.col("cum"))
    return down.groupBy("period").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.max("down").alias("drawdown"))


@_query("r28_metrics_by_period", _PERIODS + f" SELECT period, n, {sql_r('mean')} AS mean, {sql_r('sd')} AS sd, {sql_r('drawdown')} AS drawdown, n < 10 AS insufficient FROM s")
def r28(spark, d):
    return _periods(spark, d).select("period", "n", r("mean").alias("mean"), r("sd").alias("sd"), r("drawdown").alias("drawdown"), (F.col("n") < 10).alias("insufficient"))


@_query("r29_stability_verdict", _PERIODS + f" SELECT {sql_r('avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0 END)')} AS profitable, {sql_r('stddev_pop(mean / sd) / abs(avg(mean / sd))')} AS sharpe_cv, avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0 END) >= 0.67 AND stddev_pop(mean / sd) / abs(avg(mean / sd)) <= 1 AS stable FROM s WHERE period LIKE 'year:%'")
def r29(spark, d):
    s = F.col("mean") / F.col("sd")
    good, cv = F.avg(F.when(F.col("mean") > 0, 1.0).otherwise(0.0)), F.stddev_pop(s) / F.abs(F.avg(s))
    return _periods(spark, d).where("period like 'year:%'").agg(r(good).alias("profitable"), r(cv).alias("sharpe_cv"), ((good >= 0.67) & (cv <= 1)).alias("stable"))
