"""Queries of portfolio, risk and trades (K01-K43; K14 is among the feature queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ewm
from ..operators import asof, scans, sketches
from ..operators import portfolio as pf
from ..session import written
from ..sources.views import BARS, SYMBOLS, TRADES, bars, r, read, sql_r, symbols, trades

QUERIES, ORACLE = {}, {}


def _query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_RET = BARS + ", ret AS (SELECT symbol, date, close, high, low, volume, (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 0.001 AS r FROM bars)"
_BENCH = _RET + ", bench AS (SELECT date, avg(r) AS b FROM ret WHERE r IS NOT NULL GROUP BY date)"


def returns(spark, d) -> DataFrame:
    """Daily returns, in thousandths so that the synthetic prices' moves stay above -100 %."""
    lag = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    return bars(spark, d).withColumn("r", (F.col("close") / lag - 1) * 0.001)


def bench(spark, d) -> DataFrame:
    return returns(spark, d).where("r is not null").groupBy("date").agg(F.avg("r").alias("b"))


_COLS = ("total_return", "cagr", "volatility", "downside_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "avg_win", "avg_loss", "profit_factor", "var_5", "cvar_5", "tail_ratio", "stability")


@_query("k01_performance", f"""WITH {_RET}, c AS (SELECT *, sum(ln(1 + r)) OVER w AS cum, CAST(row_number() OVER w AS DOUBLE) AS i FROM ret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date)), c2 AS (SELECT *, greatest(max(cum) OVER (PARTITION BY symbol ORDER BY date), 0) AS peak FROM c),
b AS (SELECT symbol, count(*) AS n, exp(sum(ln(1 + r))) AS growth, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS dsd, avg(r) AS mean, min(exp(cum - peak) - 1) AS dd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win, avg(r) FILTER (r > 0) AS aw, avg(r) FILTER (r < 0) AS al, sum(r) FILTER (r > 0) AS gain, -sum(r) FILTER (r < 0) AS loss, quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.95) AS q95, regr_r2(cum, i) AS st FROM c2 GROUP BY symbol),
l AS (SELECT symbol, avg(r) AS cv FROM ret JOIN b USING (symbol) WHERE r <= q05 GROUP BY symbol)
SELECT symbol, n, """ + ", ".join(f"{sql_r(e)} AS {c}" for c, e in zip(_COLS, ("growth - 1", "pow(growth, 252.0 / n) - 1", "sd * sqrt(252)", "dsd * sqrt(252)", "mean / sd * sqrt(252)", "mean / dsd * sqrt(252)", "dd", "(pow(growth, 252.0 / n) - 1) / abs(dd)", "win", "aw", "al", "gain / loss", "q05", "cv", "abs(q95) / abs(q05)", "st"), strict=True)) + " FROM b JOIN l USING (symbol)")
def k01(spark, d):
    m = pf.performance(returns(spark, d).select("symbol", "date", "r"), "symbol")
    return m.select("symbol", "n", *[r(c).alias(c) for c in _COLS])


_MODELS = ORACLE["k01_performance"].split("SELECT symbol, n, ")[1].replace("FROM b JOIN l USING (symbol)", "FROM b JOIN l USING (model)")


@_query("k01_model_performance", f"""WITH {TRADES}, ret AS (SELECT model, id, close_date, close_price / entry_price - 1 AS r FROM trades WHERE status <> 'open' AND entry_price > 0), c AS (SELECT *, sum(ln(1 + r)) OVER w AS cum, CAST(row_number() OVER w AS DOUBLE) AS i FROM ret WINDOW w AS (PARTITION BY model ORDER BY close_date, id)), c2 AS (SELECT *, greatest(max(cum) OVER (PARTITION BY model ORDER BY close_date, id), 0) AS peak FROM c),
b AS (SELECT model, count(*) AS n, exp(sum(ln(1 + r))) AS growth, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS dsd, avg(r) AS mean, min(exp(cum - peak) - 1) AS dd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win, avg(r) FILTER (r > 0) AS aw, avg(r) FILTER (r < 0) AS al, sum(r) FILTER (r > 0) AS gain, -sum(r) FILTER (r < 0) AS loss, quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.95) AS q95, regr_r2(cum, i) AS st FROM c2 GROUP BY model),
l AS (SELECT model, avg(r) AS cv FROM ret JOIN b USING (model) WHERE round(r, 12) <= round(q05, 12) GROUP BY model)
SELECT model, n, {_MODELS}""")
def k01_models(spark, d):
    """The same for each model's trades in order of closing: few keys of many rows, so the curve is scanned in blocks."""
    t = done(spark, d).select("model", "id", "close_date", F.round("r", 12).alias("r"))
    m = pf.performance(t, "model", ["close_date", "id"], few_keys=True)
    return m.select("model", "n", *[r(c).alias(c) for c in _COLS])


@_query("k02_k03_benchmark_relative", f"WITH {_BENCH}, j AS (SELECT symbol, r, b FROM ret JOIN bench USING (date) WHERE r IS NOT NULL), g AS (SELECT symbol, count(*) AS n, covar_samp(r, b) / var_samp(b) AS beta, avg(r) AS mr, avg(b) AS mb, stddev_samp(r - b) AS te, avg(r - b) AS mx FROM j GROUP BY symbol HAVING count(*) > 10) SELECT symbol, n, {sql_r('beta')} AS beta, {sql_r('(mr - beta * mb) * 252')} AS alpha, {sql_r('te * sqrt(252)')} AS tracking_error, {sql_r('mx / te * sqrt(252)')} AS information_ratio FROM g")
def k02(spark, d):
    m = pf.relative(returns(spark, d).select("symbol", "date", "r"), bench(spark, d), "symbol")
    return m.select("symbol", "n", *[r(c).alias(c) for c in ("beta", "alpha", "tracking_error", "information_ratio")])


@_query("k04_signal_portfolio", f"""WITH {_RET}, w AS (SELECT *, coalesce(lag(CASE WHEN r > 0 THEN 1.0 / 20 ELSE 0.0 END) OVER (PARTITION BY symbol ORDER BY date), 0.0) AS weight FROM ret), t AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY date), 0.0)) AS traded FROM w),
d AS (SELECT date, sum(CAST(weight AS DOUBLE) * coalesce(r, 0)) - CAST(0.0001 AS DOUBLE) * sum(CAST(traded AS DOUBLE)) AS r FROM t GROUP BY date) SELECT date, {sql_r('r')} AS r, {sql_r('exp(sum(ln(1 + r)) OVER (ORDER BY date))', 3)} AS equity FROM d""")
def k04(spark, d):
    p = pf.signal_portfolio(returns(spark, d).withColumn("signal", F.col("r")).withColumn("r1", F.col("r")), "signal", 20, 0.0001)
    return p.select("date", r("r").alias("r"), r("equity", 3).alias("equity"))


_STOP = f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, date, close, low, high, row_number() OVER w AS i, close / lag(close) OVER w - 1 AS ret, coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
v AS (SELECT *, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS vol20, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS sig FROM n WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
e AS (SELECT symbol, i, tr AS atr FROM v WHERE i = 1 UNION ALL SELECT v.symbol, v.i, {2 / 15!r} * v.tr + (1 - {2 / 15!r}) * e.atr FROM e JOIN v ON v.symbol = e.symbol AND v.i = e.i + 1),
lv AS (SELECT 'atr_trailing' AS kind, symbol, i, date, low, sig, close - 0.1 * atr AS lev FROM v JOIN e USING (symbol, i) UNION ALL SELECT 'fixed_pct', symbol, i, date, low, sig, close * (1 - CAST(0.05 AS DOUBLE)) FROM v UNION ALL SELECT 'volatility_scaled', symbol, i, date, low, sig, close * (1 - 0.05 * vol20) FROM v),
st AS (SELECT kind, symbol, i, date, low, lev, sig > 0 AS pos, false AS stop, low AS ep, date AS ed, low AS th FROM lv WHERE i = 1
 UNION ALL SELECT l.kind, l.symbol, l.i, l.date, l.low, l.lev, l.sig > 0 AND NOT (s.pos AND coalesce(l.low <= l.lev, false)), s.pos AND coalesce(l.low <= l.lev, false), CASE WHEN s.pos THEN s.ep ELSE l.low END, CASE WHEN s.pos THEN s.ed ELSE l.date END, CASE WHEN s.pos THEN greatest(s.th, l.low) ELSE l.low END FROM st s JOIN lv l ON l.kind = s.kind AND l.symbol = s.symbol AND l.i = s.i + 1)"""


def _stops(spark, d) -> DataFrame:
    """Bars with the three kinds of stop; on while the last return is positive."""
    b = bars(spark, d)
    w = Window.partitionBy("symbol").orderBy("date")
    back = w.rowsBetween(-19, 0)
    x = b.withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1)
    x = x.withColumn("vol20", F.when(F.count("ret").over(back) == 20, F.stddev_samp("ret").over(back))).withColumn("signal", F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    x = ewm.ewm_features(x, ("atr_14d",), ("close", "low", "vol20", "signal")).withColumnRenamed("atr_14d", "atr").repartition("symbol")  # kinds share one exchange
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), pf.stop_level(k, 0.1, 0.05, 0.05).alias("stop_level")) for k in pf.STOPS])
    return pf.stop_scan(x.select("symbol", "date", "low", "signal", F.explode(kinds).alias("k")).select("symbol", "date", "low", "signal", "k.*"), by=("kind", "symbol"))


@_query("k05_stop_exits", _STOP + f" SELECT kind, symbol, ed AS entry_date, date AS exit_date, {sql_r('ep', 2)} AS entry_price, {sql_r('low', 2)} AS exit_price, {sql_r('lev', 2)} AS stop_level, {sql_r('th', 2)} AS trailing_high, {sql_r('low / ep - 1')} AS pnl FROM st WHERE stop")
def k05(spark, d):
    e = pf.stop_exits(_stops(spark, d), by=("kind", "symbol"))
    return e.select("kind", "symbol", "entry_date", "exit_date", *[r(c, 2).alias(c) for c in ("entry_price", "exit_price", "stop_level", "trailing_high")], r("pnl").alias("pnl"))


@_query("k06_stop_statistics", _STOP + f", x AS (SELECT *, pos AND NOT coalesce(lag(pos) OVER (PARTITION BY kind, symbol ORDER BY i), false) AS entry FROM st) SELECT kind, symbol, count(*) FILTER (stop) AS n_stops, count(*) FILTER (entry) AS n_trades, {sql_r('coalesce(count(*) FILTER (stop) / nullif(count(*) FILTER (entry), 0), 0)')} AS stop_rate, {sql_r('coalesce(avg(low / ep - 1) FILTER (stop), 0)')} AS mean_pnl, {sql_r('coalesce(sum(low / ep - 1) FILTER (stop), 0)')} AS sum_pnl, {sql_r('coalesce(avg(date - ed) FILTER (stop), 0)')} AS mean_days FROM x GROUP BY ALL")
def k06(spark, d):
    s = pf.stop_statistics(_stops(spark, d), by=("kind", "symbol"))
    return s.select("kind", "symbol", "n_stops", "n_trades", *[r(c).alias(c) for c in ("stop_rate", "mean_pnl", "sum_pnl", "mean_days")])


_W = BARS + f", {SYMBOLS}, wt AS (SELECT b.date, b.symbol, CASE WHEN b.symbol % 11 <> 0 THEN sector END AS sector, volume / sum(volume) OVER (PARTITION BY b.date) * 1.2 AS weight, volume * close AS value_traded FROM bars b JOIN symbols s ON s.symbol = b.symbol)"
_LIM = f"""WITH {_W}, l0 AS (SELECT *, CASE WHEN value_traded < 50000 THEN 0 ELSE weight END AS w0 FROM wt), l1 AS (SELECT *, least(w0, 0.05) AS w1 FROM l0), l2 AS (SELECT *, CASE WHEN w1 > 0 AND w1 < 0.01 THEN 0 ELSE w1 END AS w2 FROM l1),
l3 AS (SELECT *, CASE WHEN e > lim THEN w2 * lim / e ELSE w2 END AS w3 FROM (SELECT *, sum(w2) OVER (PARTITION BY date, coalesce(sector, 'Unknown')) AS e, CASE WHEN sector IS NULL THEN CAST(0.1 AS DOUBLE) ELSE 0.25 END AS lim FROM l2)),
l4 AS (SELECT *, CASE WHEN rn <= 5 AND held > 0.4 THEN w3 * 0.4 / held ELSE w3 END AS w4 FROM (SELECT *, sum(CASE WHEN rn <= 5 THEN w3 END) OVER (PARTITION BY date) AS held FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(w3, 12) DESC, symbol) AS rn FROM l3))),
l5 AS (SELECT *, CASE WHEN total > 1 THEN w4 / total ELSE w4 END AS w5 FROM (SELECT *, sum(w4) OVER (PARTITION BY date) AS total FROM l4))"""


def _weights(spark, d):
    b = bars(spark, d).join(symbols(spark, d).select("symbol", "sector"), "symbol")
    return b.select("date", "symbol", F.when(F.col("symbol") % 11 != 0, F.col("sector")).alias("sector"), (F.col("volume") / F.sum("volume").over(Window.partitionBy("date")) * 1.2).alias("weight"), (F.col("volume") * F.col("close")).alias("value_traded"))


@_query("k07_k11_risk_limits", _LIM + f" SELECT date, symbol, {sql_r('weight', 6)} AS weight, {sql_r('w2', 6)} AS after_position, {sql_r('w3', 6)} AS after_sector, {sql_r('w5', 6)} AS final FROM l5")
def k07(spark, d):
    x = pf.limited(_weights(spark, d), min_value=50_000)
    return x.select("date", "symbol", r("weight", 6).alias("weight"), r("w2", 6).alias("after_position"), r("w3", 6).alias("after_sector"), r("w5", 6).alias("final"))


_WARN = """, raw AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(weight, 12) DESC, symbol) AS rn, sum(weight) OVER (PARTITION BY date, coalesce(sector, 'Unknown')) AS es, sum(weight) OVER (PARTITION BY date) AS g, CASE WHEN sector IS NULL THEN CAST(0.1 AS DOUBLE) ELSE 0.25 END AS lim FROM wt),
raw2 AS (SELECT *, sum(CASE WHEN rn <= 5 THEN weight END) OVER (PARTITION BY date) AS t5 FROM raw), wv AS (SELECT 'liquidity' AS "limit", value_traded AS actual FROM raw2 WHERE value_traded < 50000 AND weight <> 0 UNION ALL SELECT 'max_position', weight FROM raw2 WHERE weight > 0.05 UNION ALL SELECT 'min_position', weight FROM raw2 WHERE weight > 0 AND weight < 0.01 UNION ALL SELECT 'sector', es FROM raw2 WHERE es > lim UNION ALL SELECT 'concentration', t5 FROM raw2 WHERE rn <= 5 AND t5 > 0.4 UNION ALL SELECT 'gross', g FROM raw2 WHERE g > 1)"""


@_query("k12_limit_violations", _LIM + _WARN + ", v AS (" + " UNION ALL ".join(f"SELECT date, symbol, '{k}' AS \"limit\", {a} AS a, {b} AS b FROM l5" for k, (a, b) in pf.LIMITS.items()) + f") SELECT 'clipped' AS action, \"limit\", count(*) AS n, {sql_r('sum(abs(a - b))')} AS amount FROM v WHERE abs(a - b) > 1e-9 GROUP BY ALL UNION ALL SELECT 'warned', \"limit\", count(*), {sql_r('avg(actual)', 3)} FROM wv GROUP BY ALL")
def k12(spark, d):
    """Both modes: weights clipped, with what was moved, and weights left, with what exceeds a limit."""
    w = _weights(spark, d)
    clipped = pf.violations(pf.limited(w, min_value=50_000)).groupBy("limit").agg(F.count("*").alias("n"), r(F.sum(F.abs(F.col("before") - F.col("after")))).alias("amount"))
    warned = pf.warned(w, min_value=50_000).groupBy("limit").agg(F.count("*").alias("n"), r(F.avg("actual"), 3).alias("amount"))
    return clipped.select(F.lit("clipped").alias("action"), "limit", "n", "amount").unionByName(warned.select(F.lit("warned").alias("action"), "limit", "n", "amount"))


@_query("k13_impact_cost", f"WITH {TRADES} SELECT id, {sql_r('greatest(1.0, least(quantity * 0.005, quantity * entry_price * 0.005)) + quantity * entry_price * 5 / 10000 + CASE WHEN id % 7 > 0 THEN 0.1 * (id % 11 * 0.1) * sqrt(quantity / (id % 7 * 100.0)) * quantity * entry_price ELSE least(0.05 * quantity * entry_price, 0.1 * (id % 11 * 0.1) * quantity * entry_price) END', 2)} AS cost FROM trades")
def k13(spark, d):
    """One trade in seven has no volume; of these, the wilder half meet the bound of 5 %."""
    t = trades(spark, d)
    return t.select("id", r(pf.impact_cost(F.col("quantity"), F.col("entry_price"), F.col("id") % 7 * 100.0, F.col("id") % 11 * 0.1), 2).alias("cost"))


_HVAR = ", h AS (SELECT symbol, 1 AS days, -r AS loss FROM ret WHERE r IS NOT NULL UNION ALL SELECT symbol, 5, -s FROM (SELECT symbol, sum(r) OVER w AS s, count(*) OVER w AS c FROM ret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE c = 5), q AS (SELECT symbol, days, quantile_cont(loss, 0.95) AS v, count(*) AS n FROM h GROUP BY ALL HAVING count(*) >= 31 OR days = 1 AND count(*) >= 30)"


@_query("k15_historical_var", f"WITH {_RET}{_HVAR} SELECT symbol, days, any_value(n) AS n, {sql_r('any_value(v)')} AS var, {sql_r('avg(loss)')} AS cvar FROM h JOIN q USING (symbol, days) WHERE {sql_r('loss', 12)} >= {sql_r('v', 12)} GROUP BY ALL")
def k15(spark, d):
    x = returns(spark, d).select("symbol", "date", "r")
    each = [pf.historical_var(x, "symbol", days=h).select("symbol", F.lit(h).alias("days"), "n", r("var").alias("var"), r("cvar").alias("cvar")) for h in (1, 5)]
    return each[0].unionByName(each[1])


@_query("k15_k17_sketched_quantiles", f"WITH {_RET}, m AS (SELECT symbol, r FROM ret WHERE r IS NOT NULL AND date BETWEEN DATE '1997-03-01' AND DATE '1999-10-31') SELECT symbol, count(*) AS n, {sql_r('min(r)')} AS lo, {sql_r('max(r)')} AS hi, {sql_r('avg(r)')} AS mean, true AS q05_within, true AS q50_within, true AS q95_within FROM m GROUP BY symbol")
def k15_sketched(spark, d):
    """Quantiles of a range of months from monthly sketches: counts and extremes are exact, and each quantile's true rank is within the bound of its error."""
    x = returns(spark, d).select("symbol", "date", "r")
    months = written(sketches.monthly(x, ["symbol"], "date", "r"), "sketches")
    at = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    q = sketches.with_quantiles(sketches.merged(months, ["symbol"], "1997-03-01", "1999-10-01"), **at).drop("sketch")
    rows = x.where("r is not null and date between date'1997-03-01' and date'1999-10-31'").join(q.select("symbol", "n", *at), "symbol")
    share = lambda c, below: F.count_if(F.col("r") < F.col(c) if below else F.col("r") <= F.col(c)) / F.first("n")
    within = rows.groupBy("symbol").agg(*[((share(c, True) <= p + sketches.ERROR) & (share(c, False) >= p - sketches.ERROR)).alias(f"{c}_within") for c, p in at.items()])
    return q.join(within, "symbol").select("symbol", "n", r("lo").alias("lo"), r("hi").alias("hi"), r(F.col("total") / F.col("n")).alias("mean"), *[f"{c}_within" for c in at])


@_query("k16_simulated_var")
def k16(spark, d):
    """Normal and heavy-tailed draws; tested against the fitted quantiles."""
    x = returns(spark, d).select("symbol", "r")
    each = [pf.simulated_var(x, "symbol", heavy=h).withColumn("draws", F.lit("t" if h else "normal")) for h in (False, True)]
    return each[0].unionByName(each[1])


_TAIL = ("var_95", "cvar_95", "var_99", "cvar_99", "skewness", "kurtosis", "worst", "positive_pct")


@_query("k17_tail_risk", f"WITH {_RET}, x AS (SELECT symbol, r, quantile_cont(r, 0.05) OVER (PARTITION BY symbol) AS q5, quantile_cont(r, 0.01) OVER (PARTITION BY symbol) AS q1 FROM ret WHERE r IS NOT NULL), m AS (SELECT symbol, avg(r) AS mu, stddev_pop(r) AS sd FROM ret GROUP BY symbol), g AS (SELECT symbol, count(*) AS n, any_value(q5) AS var_95, avg(r) FILTER (r <= q5) AS cvar_95, any_value(q1) AS var_99, avg(r) FILTER (r <= q1) AS cvar_99, avg(pow((r - mu) / sd, 3)) AS skewness, avg(pow((r - mu) / sd, 4)) - 3 AS kurtosis, min(r) AS worst, 100 * avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS positive_pct FROM x JOIN m USING (symbol) GROUP BY symbol) SELECT symbol, n, " + ", ".join(f"CASE WHEN n >= 520 THEN {sql_r(c, 3)} END AS {c}" for c in _TAIL) + " FROM g")
def k17(spark, d):
    t = pf.tail_risk(returns(spark, d).select("symbol", "r"), "symbol", least=520)  # so that some symbols have too few days
    return t.select("symbol", "n", *[r(c, 3).alias(c) for c in _TAIL])


@_query("k18_k19_sharpe_significance", f"WITH {_RET}, s AS (SELECT symbol, avg(r) / stddev_samp(r) AS sharpe, count(r) AS n FROM ret GROUP BY symbol), e AS (SELECT *, sqrt((1 + sharpe * sharpe / 2) / n) AS se FROM s) SELECT symbol, {sql_r('sharpe')} AS sharpe, {sql_r('se')} AS se, {sql_r('sharpe * sqrt(n)')} AS t, {sql_r('se * 2.3263478740408408')} AS expected_best, sharpe > se * 2.3263478740408408 AS deflated FROM e")
def k18(spark, d):
    s = returns(spark, d).groupBy("symbol").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.count("r").alias("n"))
    return pf.significance(s, 100).select("symbol", r("sharpe").alias("sharpe"), r("se").alias("se"), r("t").alias("t"), r("expected_best").alias("expected_best"), "deflated")


@_query("k19_excess_return_test", f"""WITH {_RET}, s AS (SELECT symbol, avg(r) / stddev_samp(r) * sqrt(count(r)) AS t, count(r) AS n FROM ret GROUP BY symbol), g AS (SELECT *, atan(t / sqrt(n - 1)) AS a, exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt(pi()) AS c, unnest(range(4001)) AS k FROM s),
p AS (SELECT symbol, t, n, c * (pi() / 2 - a) / 12000 * sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos(a + (pi() / 2 - a) * k / 4000), 0), n - 2)) AS p FROM g GROUP BY symbol, t, n, a, c) SELECT symbol, {sql_r('t')} AS t, n, {sql_r('p', 6)} AS p_value FROM p""")
def k19(spark, d):
    """One-sided p of a positive mean, by the finite series of Student's distribution; its SQL integrates the density."""
    s = returns(spark, d).groupBy("symbol").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.count("r").alias("n"))
    return pf.significance(s, 100).select("symbol", r("t").alias("t"), "n", r("p_value", 6).alias("p_value"))


@_query("k20_bootstrap")
def k20(spark, d):
    """Intervals of mean, Sharpe ratio and deviation; tested against the normal intervals."""
    return pf.bootstrap(returns(spark, d).select("symbol", "date", "r"), "symbol")


_TR = TRADES + ", done AS (SELECT *, close_price / entry_price - 1 AS r FROM trades WHERE status <> 'open' AND entry_price > 0)"


def done(spark, d) -> DataFrame:
    return trades(spark, d).where("status <> 'open' and entry_price > 0").withColumn("r", F.col("close_price") / F.col("entry_price") - 1)


_MEAS = f"""{_TR}, o AS (SELECT model, id, r, close_date, sum(r) OVER (PARTITION BY model ORDER BY close_date, id) AS cum FROM done), dd AS (SELECT *, greatest(max(cum) OVER (PARTITION BY model ORDER BY close_date, id), 0) - cum AS down, quantile_cont(r, 0.05) OVER (PARTITION BY model) AS q5 FROM o),
m AS (SELECT model, count(*) AS trades, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, max(down) AS max_drawdown, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS profit_factor, max(close_date) - min(close_date) AS oos_days, any_value(q5) AS var, avg(r) FILTER (round(r, 12) <= round(q5, 12)) AS cvar FROM dd GROUP BY model)"""


def _measures(spark, d) -> DataFrame:
    """What a verdict on each model rests on; drawdown of summed results."""
    o = pf.curve(done(spark, d), "model", ["close_date", "id"], F.col("r"), few_keys=True).withColumn("down", F.col("peak") - F.col("cum"))
    g = o.groupBy("model").agg(
        F.count("*").alias("trades"), (F.avg("r") / F.stddev_samp("r") * 252**0.5).alias("sharpe"), F.max("down").alias("max_drawdown"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.try_divide(F.sum(F.when(F.col("r") > 0, F.col("r"))), -F.sum(F.when(F.col("r") < 0, F.col("r")))).alias("profit_factor"), F.date_diff(F.max("close_date"), F.min("close_date")).alias("oos_days"),
    )
    g = g.join(scans.quantiles(done(spark, d), ["model"], "r", var=0.05), "model")
    low = done(spark, d).join(g.select("model", "var"), "model").where(F.round(F.col("r"), 12) <= F.round("var", 12)).groupBy("model").agg(F.avg("r").alias("cvar"))
    return g.join(low, "model", "left")


_FAILS = ", ".join(f"CASE WHEN {'abs(' + k + ')' if k in ('var', 'cvar') else k} {'<' if least else '>'} {bound!r} THEN '{k}' END" for k, (bound, least) in pf.CRITERIA.items())


@_query("k21_validation_verdict", f"WITH {_MEAS}, f AS (SELECT *, list_filter([{_FAILS}], lambda x: x IS NOT NULL) AS failed FROM m) SELECT model, trades, {sql_r('sharpe')} AS sharpe, {sql_r('max_drawdown', 3)} AS max_drawdown, {sql_r('win_rate')} AS win_rate, {sql_r('profit_factor')} AS profit_factor, CAST(oos_days AS INTEGER) AS oos_days, {sql_r('var')} AS var, {sql_r('cvar')} AS cvar, failed, len(failed) = 0 AS passed, {sql_r('(least(1, sharpe / 1.0) + least(1, trades / 200.0) + greatest(0, least(1, 1.5 - abs(var) / CAST(0.05 AS DOUBLE))) + greatest(0, least(1, 1.5 - abs(cvar) / CAST(0.08 AS DOUBLE)))) / 4')} AS confidence FROM f")
def k21(spark, d):
    v = pf.validated(_measures(spark, d))
    return v.select("model", "trades", r("sharpe").alias("sharpe"), r("max_drawdown", 3).alias("max_drawdown"), *[r(c).alias(c) for c in ("win_rate", "profit_factor")], "oos_days", r("var").alias("var"), r("cvar").alias("cvar"), "failed", "passed", r("confidence").alias("confidence"))


_PAIR = f"WITH RECURSIVE {_RET}, {SYMBOLS}, x AS (SELECT symbol, date, r FROM ret WHERE r IS NOT NULL), e AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, corr(a.r, b.r) AS corr, covar_samp(a.r, b.r) AS cov FROM x a JOIN x b ON a.date = b.date AND a.symbol < b.symbol GROUP BY ALL)"
_AGED = f"""WITH {_RET}, x AS (SELECT symbol, date, r FROM ret WHERE r IS NOT NULL), g AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM x)), y AS (SELECT x.*, pow(CAST(0.5 AS DOUBLE), age / CAST(60 AS DOUBLE)) AS w FROM x JOIN g USING (date)),
c AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, sum(a.w) AS w, sum(a.w * a.w) AS w2, sum(a.w * a.r) / sum(a.w) AS ma, sum(a.w * b.r) / sum(a.w) AS mb FROM y a JOIN y b ON a.date = b.date AND a.symbol < b.symbol GROUP BY ALL),
k AS (SELECT c.a, c.b, any_value(c.n) AS n, any_value(c.w) AS w, any_value(c.w2) AS w2, sum(p.w * (p.r - c.ma) * (q.r - c.mb)) / any_value(c.w) AS cv, sum(p.w * pow(p.r - c.ma, 2)) / any_value(c.w) AS va, sum(p.w * pow(q.r - c.mb, 2)) / any_value(c.w) AS vb FROM c JOIN y p ON p.symbol = c.a JOIN y q ON q.symbol = c.b AND q.date = p.date GROUP BY ALL)"""


@_query("k22_correlation_matrix", _PAIR + f" SELECT a, b, n, {sql_r('corr')} AS corr, {sql_r('cov * 1000')} AS cov FROM e")
def k22(spark, d):
    """All pairs of names over the days that both have."""
    return pf.correlations(returns(spark, d)).select("a", "b", "n", r("corr").alias("corr"), r(F.col("cov") * 1000).alias("cov"))


@_query("k22_exponential_covariance", _AGED + f" SELECT a, b, n, {sql_r('cv / sqrt(va * vb)', 3)} AS corr, {sql_r('cv * w * w / (w * w - w2) * 1000', 3)} AS cov FROM k WHERE n >= 30")
def k22_aged(spark, d):
    """The same with days weighed by age, half as much every 60 sessions; of pairs with 30 common days."""
    c = pf.correlations(returns(spark, d), halflife=60).where("n >= 30")
    return c.select("a", "b", "n", r("corr", 3).alias("corr"), r(F.col("cov") * 1000, 3).alias("cov"))


@_query("k23_correlation_filter", _PAIR + """, near AS (SELECT a, b FROM e WHERE abs(corr) > 0.2 UNION ALL SELECT b, a FROM e WHERE abs(corr) > 0.2), o AS (SELECT symbol, sector, market_cap, row_number() OVER (ORDER BY market_cap DESC, symbol) AS k FROM symbols WHERE market_cap IS NOT NULL), l AS (SELECT o.symbol, k, list(b) AS others FROM o LEFT JOIN near ON near.a = o.symbol GROUP BY ALL),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT l.k, CASE WHEN list_has_any(g.kept, coalesce(l.others, [])) THEN g.kept ELSE list_append(g.kept, l.symbol) END FROM g JOIN l ON l.k = g.k + 1), f AS (SELECT unnest(kept) AS symbol FROM g WHERE k = (SELECT max(k) FROM g)),
t AS (SELECT o.symbol, o.sector, row_number() OVER (PARTITION BY sector ORDER BY k) AS rn FROM f JOIN o USING (symbol)) SELECT symbol, sector FROM t WHERE rn <= 6""")
def k23(spark, d):
    """Of all names, those without a stronger correlated one; of each sector the strongest six."""
    s = symbols(spark, d).where("market_cap is not null").select("symbol", "sector", F.col("market_cap").alias("strength"))
    return pf.top_of_sector(pf.uncorrelated(s, returns(spark, d), 0.2)).select("symbol", "sector")


_IV = f"""WITH {_RET}, {SYMBOLS}, v AS (SELECT symbol, stddev_samp(r) AS sd FROM ret GROUP BY symbol), raw AS (SELECT symbol, abs(market_cap) / sd AS x FROM v JOIN symbols USING (symbol) WHERE sd > 0), n AS (SELECT symbol, x / sum(x) OVER () AS w FROM raw),
c AS (SELECT symbol, w, least(w, 0.02) AS c FROM n), e AS (SELECT *, sum(w - c) OVER () AS over_, sum(CASE WHEN c < 0.02 THEN c END) OVER () AS free FROM c), f AS (SELECT symbol, w, CASE WHEN c < 0.02 THEN least(c + over_ * c / free, 0.02) ELSE c END AS f FROM e), g AS (SELECT symbol, w, f / sum(f) OVER () AS f FROM f),
old AS (SELECT symbol, sum(volume) / sum(sum(volume)) OVER () AS o FROM ret WHERE symbol % 2 = 0 GROUP BY symbol), j AS (SELECT coalesce(g.symbol, old.symbol) AS symbol, coalesce(w, 0) AS w, coalesce(f, 0) AS f, coalesce(o, 0) AS o FROM g FULL JOIN old ON g.symbol = old.symbol), t AS (SELECT *, 0.5 * sum(abs(f - o)) OVER () AS turnover FROM j),
b AS (SELECT *, CASE WHEN turnover > 0.2 THEN CAST(0.2 AS DOUBLE) / turnover ELSE 1 END AS x FROM t), k AS (SELECT *, CASE WHEN x * f + (1 - x) * o > 0.001 THEN x * f + (1 - x) * o ELSE 0 END AS kept FROM b)"""


@_query("k24_inverse_volatility_weights", _IV + f" SELECT symbol, {sql_r('w', 6)} AS raw, {sql_r('f', 6)} AS capped, {sql_r('turnover', 6)} AS turnover, {sql_r('kept / sum(kept) OVER ()', 6)} AS weight FROM k")
def k24(spark, d):
    x = returns(spark, d)
    names = x.groupBy("symbol").agg(F.stddev_samp("r").alias("sd")).join(symbols(spark, d), "symbol").where("sd > 0").select("symbol", F.col("market_cap").alias("signal"), "sd")
    old = x.where("symbol % 2 = 0").groupBy("symbol").agg(F.sum("volume").alias("v")).select("symbol", (F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(1)))).alias("old"))
    w = pf.inverse_volatility(names, old, most=0.02)
    return w.select("symbol", *[r(c, 6).alias(c) for c in ("raw", "capped", "turnover", "weight")])


@_query("k25_var_position_sizing", f"""WITH {_TR}, t AS (SELECT id, model, entry_price, prediction, (prediction - min(prediction) OVER (PARTITION BY model)) / nullif(max(prediction) OVER (PARTITION BY model) - min(prediction) OVER (PARTITION BY model), 0) AS s FROM done),
z AS (SELECT *, least(0.02 / 0.05, 0.1) * s AS pct, CAST(floor(least(0.02 / 0.05, 0.1) * s * 1e8 / entry_price) AS BIGINT) AS q FROM t), c AS (SELECT *, sum(pct * 0.05) OVER (PARTITION BY model ORDER BY prediction DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM z) SELECT id, model, {sql_r('pct', 6)} AS pct, q AS quantity FROM c WHERE used <= 5.0 + 1e-9""")
def k25(spark, d):
    """Strengths between each model's extremes, one aggregate; the budget's running sum is scanned in blocks of (model, prediction)."""
    t = done(spark, d)
    t = t.join(t.groupBy("model").agg(F.min("prediction").alias("lo"), F.max("prediction").alias("hi")), "model")
    s = F.try_divide(F.col("prediction") - F.col("lo"), F.col("hi") - F.col("lo"))
    t = t.withColumn("pct", F.least(F.lit(0.02 / 0.05), F.lit(0.1)) * s).withColumn("quantity", F.floor(F.col("pct") * 1e8 / F.col("entry_price")).cast("long"))
    order = [F.desc("prediction"), "id"]
    t = scans.running(scans.blocks(t.select("id", "model", "prediction", "pct", "quantity"), ["model"], order), ["model"], order, used=F.col("pct") * 0.05)
    return t.where("used <= 5.0 + 1e-9").select("id", "model", r("pct", 6).alias("pct"), "quantity")


@_query("k26_orders_from_signals", f"""WITH {_TR}, h AS (SELECT symbol, sum(quantity) AS q FROM done WHERE status = 'stopped' GROUP BY symbol), w AS (SELECT symbol, CAST(floor(1e6 / avg(entry_price)) AS BIGINT) AS q FROM done WHERE status = 'closed' AND prediction > 0 GROUP BY symbol QUALIFY row_number() OVER (ORDER BY sum(prediction) DESC, symbol) <= 40)
SELECT coalesce(w.symbol, h.symbol) AS symbol, CASE WHEN coalesce(w.q, 0) > coalesce(h.q, 0) THEN 'buy' ELSE 'sell' END AS side, CAST(abs(coalesce(w.q, 0) - coalesce(h.q, 0)) AS BIGINT) AS quantity FROM w FULL JOIN h ON w.symbol = h.symbol WHERE coalesce(w.q, 0) <> coalesce(h.q, 0)""")
def k26(spark, d):
    t = done(spark, d)
    held = t.where("status = 'stopped'").groupBy("symbol").agg(F.sum("quantity").alias("h"))
    want = t.where("status = 'closed' and prediction > 0").groupBy("symbol").agg(F.floor(1e6 / F.avg("entry_price")).cast("long").alias("w"), F.sum("prediction").alias("s")).orderBy(F.desc("s"), "symbol").limit(40).drop("s")
    move = F.coalesce("w", F.lit(0)) - F.coalesce("h", F.lit(0))
    return want.join(held, "symbol", "full_outer").withColumn("m", move).where("m <> 0").select("symbol", F.when(F.col("m") > 0, "buy").otherwise("sell").alias("side"), F.abs("m").cast("long").alias("quantity"))


_SECT = f"WITH {_RET}, {SYMBOLS}, p AS (SELECT sector, sum(volume) AS v, sum(volume * r) / sum(volume) AS rp FROM ret JOIN symbols USING (symbol) WHERE r IS NOT NULL AND symbol % 2 = 0 GROUP BY sector), q AS (SELECT sector, sum(volume) AS v, sum(volume * r) / sum(volume) AS rb FROM ret JOIN symbols USING (symbol) WHERE r IS NOT NULL GROUP BY sector), j AS (SELECT coalesce(p.sector, q.sector) AS sector, coalesce(p.v / sum(p.v) OVER (), 0) AS wp, coalesce(q.v / sum(q.v) OVER (), 0) AS wb, coalesce(rp, 0) AS rp, coalesce(rb, 0) AS rb FROM p FULL JOIN q ON p.sector = q.sector), t AS (SELECT *, sum(wb * rb) OVER () AS total FROM j)"


@_query("k27_brinson_attribution", _SECT + f" SELECT sector, {sql_r('1e4 * (wp - wb) * (rb - total)')} AS allocation, {sql_r('1e4 * wb * (rp - rb)')} AS selection, {sql_r('1e4 * (wp - wb) * (rp - rb)')} AS interaction FROM t")
def k27(spark, d):
    x = returns(spark, d).join(symbols(spark, d), "symbol").where("r is not null")
    side = lambda df, w, ret: df.groupBy("sector").agg(F.sum("volume").alias(f"{w}_v"), (F.sum(F.col("volume") * F.col("r")) / F.sum("volume")).alias(ret))
    every = Window.partitionBy()  # one row a sector
    j = side(x.where("symbol % 2 = 0"), "wp", "rp").join(side(x, "wb", "rb"), "sector", "full_outer").fillna(0)
    j = j.withColumn("wp", F.col("wp_v") / F.sum("wp_v").over(every)).withColumn("wb", F.col("wb_v") / F.sum("wb_v").over(every))
    j = j.withColumn("total", F.sum(F.col("wb") * F.col("rb")).over(every))
    dw, dr = F.col("wp") - F.col("wb"), F.col("rp") - F.col("rb")
    return j.select("sector", r(1e4 * dw * (F.col("rb") - F.col("total"))).alias("allocation"), r(1e4 * F.col("wb") * dr).alias("selection"), r(1e4 * dw * dr).alias("interaction"))


@_query("k28_factor_attribution", f"WITH {_BENCH}, j AS (SELECT symbol, r, b FROM ret JOIN bench USING (date) WHERE r IS NOT NULL) SELECT symbol, {sql_r('regr_slope(r, b)')} AS beta, {sql_r('regr_slope(r, b) * avg(b) * 1e4', 3)} AS contribution, {sql_r('(avg(r) - regr_slope(r, b) * avg(b)) * 1e4', 3)} AS alpha, {sql_r('regr_r2(r, b)')} AS r2 FROM j GROUP BY symbol")
def k28(spark, d):
    a = pf.factor_attribution(returns(spark, d).join(bench(spark, d), "date"), "r", ["b"], "symbol")
    return a.select("symbol", r("beta_b").alias("beta"), r(F.col("contribution_b") * 1e4, 3).alias("contribution"), r(F.col("alpha") * 1e4, 3).alias("alpha"), r("r2").alias("r2"))


_FACT = f"""WITH {_RET}, fac AS (SELECT date, avg(r) AS m, avg(r) FILTER (symbol % 2 = 0) - avg(r) FILTER (symbol % 2 = 1) AS s, sum(volume * r) / sum(volume) AS v FROM ret WHERE r IS NOT NULL GROUP BY date), j AS (SELECT symbol, r, m, s, v FROM ret JOIN fac USING (date) WHERE r IS NOT NULL AND s IS NOT NULL),
g AS (SELECT symbol, avg(r) AS y, avg(m) AS mm, avg(s) AS ms, avg(v) AS mv, sum(m * m) AS a, sum(m * s) AS b, sum(m * v) AS c, sum(s * s) AS d, sum(s * v) AS e, sum(v * v) AS f, sum(m * r) AS p, sum(s * r) AS q, sum(v * r) AS t, sum(r * r) AS yy, var_pop(r) * count(*) AS tss FROM j GROUP BY symbol),
k AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM g), x AS (SELECT *, (p * (d * f - e * e) - b * (q * f - e * t) + c * (q * e - d * t)) / det AS b1, (a * (q * f - t * e) - p * (b * f - e * c) + c * (b * t - q * c)) / det AS b2, (a * (d * t - q * e) - b * (b * t - q * c) + p * (b * e - d * c)) / det AS b3 FROM k)"""


@_query("k28_many_factors", _FACT + f" SELECT symbol, {sql_r('b1', 3)} AS market, {sql_r('b2', 3)} AS spread, {sql_r('b3', 3)} AS volume, {sql_r('(y - b1 * mm - b2 * ms - b3 * mv) * 1e4', 2)} AS alpha, {sql_r('1 - (yy - b1 * p - b2 * q - b3 * t) / tss', 3)} AS r2 FROM x")
def k28_many(spark, d):
    """Three factors: the market, even against odd names, and the market by volume."""
    x = returns(spark, d).where("r is not null")
    side = lambda k: F.avg(F.when(F.col("symbol") % 2 == k, F.col("r")))
    f = x.groupBy("date").agg(F.avg("r").alias("m"), (side(0) - side(1)).alias("s"), (F.sum(F.col("volume") * F.col("r")) / F.sum("volume")).alias("v"))
    a = pf.factor_attribution(x.select("symbol", "date", "r").join(f, "date"), "r", ["m", "s", "v"], "symbol")
    return a.select("symbol", r("beta_m", 3).alias("market"), r("beta_s", 3).alias("spread"), r("beta_v", 3).alias("volume"), r(F.col("alpha") * 1e4, 2).alias("alpha"), r("r2", 3).alias("r2"))


_AT = f"WITH {_TR}, {BARS}, a AS (SELECT t.*, b.close AS be FROM done t ASOF JOIN bars b ON t.symbol = b.symbol AND t.entry_date >= b.date), x AS (SELECT a.*, b.close AS bx FROM a ASOF JOIN bars b ON a.symbol = b.symbol AND a.close_date >= b.date)"


def _priced(spark, d):
    b = bars(spark, d).select("symbol", "date", "close")
    one = asof.asof_join(done(spark, d), b.withColumnRenamed("close", "be"), ["symbol"], "entry_date", "date", ["be"])
    return asof.asof_join(one, b.withColumnRenamed("close", "bx"), ["symbol"], "close_date", "date", ["bx"]).where("be is not null and bx is not null")


@_query("k29_decision_attribution", _AT + f" SELECT id, {sql_r('(be - entry_price) * quantity + (close_price - bx) * quantity', 2)} AS timing, {sql_r('(quantity - 5) * (bx - be)', 2)} AS sizing, {sql_r('(close_price - entry_price) * quantity', 2)} AS total FROM x")
def k29(spark, d):
    p, q = _priced(spark, d), F.col("quantity")
    return p.select("id", r((F.col("be") - F.col("entry_price")) * q + (F.col("close_price") - F.col("bx")) * q, 2).alias("timing"), r((q - 5) * (F.col("bx") - F.col("be")), 2).alias("sizing"), r((F.col("close_price") - F.col("entry_price")) * q, 2).alias("total"))


@_query("k30_rebalance_analysis", f"WITH {_RET}, m AS (SELECT symbol, date_trunc('quarter', date) AS q, sum(volume) AS v, sum(r) AS r FROM ret WHERE r IS NOT NULL GROUP BY ALL), w AS (SELECT *, v / sum(v) OVER (PARTITION BY q) AS w FROM m), l AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY q), 0) AS before FROM w) SELECT CAST(q AS DATE) AS quarter, {sql_r('0.5 * sum(abs(w - before))')} AS turnover, {sql_r('1e4 * sum((w - before) * r)', 3)} AS value_add, {sql_r('1e4 * max(r)', 3)} AS best FROM l GROUP BY q")
def k30(spark, d):
    m = returns(spark, d).where("r is not null").groupBy("symbol", F.trunc("date", "quarter").alias("quarter")).agg(F.sum("volume").alias("v"), F.sum("r").alias("r"))
    w = m.withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("quarter")))
    w = w.withColumn("dw", F.col("w") - F.coalesce(F.lag("w").over(Window.partitionBy("symbol").orderBy("quarter")), F.lit(0.0)))
    return w.groupBy("quarter").agg(r(0.5 * F.sum(F.abs("dw"))).alias("turnover"), r(1e4 * F.sum(F.col("dw") * F.col("r")), 3).alias("value_add"), r(1e4 * F.max("r"), 3).alias("best"))


_IDX = _BENCH.replace(BARS + ", ", "") + ", idx AS (SELECT date, sum(ln(1 + b)) OVER (ORDER BY date) AS x FROM bench)"
_POST = f"""WITH {_TR}, {BARS}, {_IDX}, p AS (SELECT id, avg(close) AS avg_price, count(*) AS days FROM done t JOIN bars b ON t.symbol = b.symbol AND b.date BETWEEN t.entry_date AND t.close_date GROUP BY id),
q AS (SELECT t.*, p.avg_price, p.days, a.x AS x0 FROM done t JOIN p USING (id) ASOF LEFT JOIN idx a ON t.entry_date >= a.date), z AS (SELECT q.*, b.x AS x1 FROM q ASOF LEFT JOIN idx b ON q.close_date >= b.date),
w AS (SELECT *, exp(coalesce(x1, 0) - coalesce(x0, 0)) - 1 AS benchmark, (avg_price - entry_price) / entry_price AS timing, r * (quantity / 100.0 - 0.05) AS sizing, CASE WHEN prediction > 0 THEN close_price > entry_price ELSE close_price < entry_price END AS correct FROM z)"""


def _index(spark, d) -> DataFrame:
    """The benchmark's cumulative log return."""
    return bench(spark, d).select("date", F.sum(F.log1p("b")).over(Window.orderBy("date")).alias("x"))  # one row a date


def _over(spark, d, t: DataFrame, start: str, end: str) -> DataFrame:
    """t with `benchmark`, its return from one date to another: both are looked up as of their dates, distinct dates only."""
    i = _index(spark, d)
    days = t.select(F.explode(F.array(start, end)).alias("__d")).where("__d is not null").distinct()
    at = asof.asof_join(days.withColumn("k", F.lit(1)), i.withColumn("k", F.lit(1)), ["k"], "__d", "date", ["x"]).drop("k")  # a row a date
    for c, name in ((start, "__x0"), (end, "__x1")):
        t = t.join(at.select(F.col("__d").alias(c), F.coalesce("x", F.lit(0.0)).alias(name)), c, "left")
    return t.withColumn("benchmark", F.coalesce(F.exp(F.col("__x1") - F.col("__x0")) - 1, F.lit(0.0))).drop("__x0", "__x1")


def _attributed(spark, d) -> DataFrame:
    """Average price over each holding window, from prefix sums as-of joined at both ends: no trade x day rows."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    b = bars(spark, d).select("symbol", "date", F.sum(F.col("close").cast("decimal(38,12)")).over(w).alias("s"), F.count("*").over(w).alias("n"))
    t = done(spark, d).withColumn("day_before", F.date_sub("entry_date", 1))
    t = asof.asof_join(t, b.select("symbol", "date", F.col("s").alias("s0"), F.col("n").alias("n0")), ["symbol"], "day_before", "date", ["s0", "n0"])
    t = asof.asof_join(t, b.select("symbol", "date", F.col("s").alias("s1"), F.col("n").alias("n1")), ["symbol"], "close_date", "date", ["s1", "n1"])
    days = F.coalesce("n1", F.lit(0)) - F.coalesce("n0", F.lit(0))
    mean = (F.col("s1") - F.coalesce("s0", F.lit(0))).cast("double") / days
    t = t.where(days > 0).withColumn("days", days).withColumn("avg_price", mean).withColumn("weight", F.col("quantity") / 100.0)
    return pf.attributed(_over(spark, d, t, "entry_date", "close_date"))


@_query("k31_post_trade_attribution", f"{_POST} SELECT id, days, {sql_r('avg_price', 2)} AS avg_price, {sql_r('timing')} AS timing, {sql_r('sizing', 6)} AS sizing, {sql_r('r - timing - sizing')} AS signal, correct, {sql_r('benchmark')} AS benchmark FROM w")
def k31(spark, d):
    a = _attributed(spark, d)
    return a.select("id", "days", r("avg_price", 2).alias("avg_price"), r("timing").alias("timing"), r("sizing", 6).alias("sizing"), r("signal").alias("signal"), "correct", r("benchmark").alias("benchmark"))


@_query("k31_attribution_by_model", f"{_POST} SELECT model, count(*) AS n, {sql_r('avg(CASE WHEN correct THEN 1.0 ELSE 0 END)')} AS hit_rate, {sql_r('avg(r - timing - sizing)')} AS signal, {sql_r('avg(timing)')} AS timing, {sql_r('avg(sizing)', 6)} AS sizing, {sql_r('avg(benchmark)')} AS benchmark, {sql_r('avg(r - benchmark) / stddev_pop(r - benchmark)')} AS information_ratio FROM w GROUP BY model")
def k31_models(spark, d):
    a = pf.attribution_summary(_attributed(spark, d), "model")
    return a.select("model", "n", *[r(c, 6 if c == "sizing" else 4).alias(c) for c in ("hit_rate", "signal", "timing", "sizing", "benchmark", "information_ratio")])


_RECORD = f"""WITH {_TR}, {BARS}, {_IDX}, g AS (SELECT model, count(*) AS n, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(r) AS mean, avg(r) FILTER (r > 0) AS avg_win, avg(r) FILTER (r <= 0) AS avg_loss, first(id ORDER BY round(r, 9) DESC, id) AS best, first(id ORDER BY round(r, 9), id) AS worst, CASE WHEN count(*) >= 5 THEN avg(r) / stddev_samp(r) * sqrt(52) END AS sharpe, min(entry_date) AS a, max(close_date) AS z FROM done GROUP BY model),
h AS (SELECT g.*, i.x AS x0 FROM g ASOF LEFT JOIN idx i ON g.a >= i.date), k AS (SELECT h.*, exp(coalesce(i.x, 0) - coalesce(x0, 0)) - 1 AS benchmark FROM h ASOF LEFT JOIN idx i ON h.z >= i.date)"""


@_query("k32_track_record", f"{_RECORD} SELECT model, n, {sql_r('win_rate')} AS win_rate, {sql_r('mean')} AS avg_return, {sql_r('avg_win')} AS avg_win, {sql_r('avg_loss')} AS avg_loss, best, worst, {sql_r('sharpe')} AS sharpe, {sql_r('benchmark')} AS benchmark, {sql_r('mean - benchmark')} AS excess FROM k")
def k32(spark, d):
    """Per model, against the benchmark from its first entry to its last close."""
    k = F.round("r", 9)
    s = F.when(F.count("*") >= 5, F.avg("r") / F.stddev_samp("r") * 52**0.5)
    g = done(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("r").alias("avg_return"), F.avg(F.when(F.col("r") > 0, F.col("r"))).alias("avg_win"), F.avg(F.when(F.col("r") <= 0, F.col("r"))).alias("avg_loss"), F.min_by("id", F.struct(-k, "id")).alias("best"), F.min_by("id", F.struct(k, "id")).alias("worst"), s.alias("sharpe"), F.min("entry_date").alias("a"), F.max("close_date").alias("z"))
    g = _over(spark, d, g, "a", "z").withColumn("excess", F.col("avg_return") - F.col("benchmark"))
    return g.select("model", "n", "best", "worst", *[r(c).alias(c) for c in ("win_rate", "avg_return", "avg_win", "avg_loss", "sharpe", "benchmark", "excess")])


@_query("k33_rolling_90_days", f"WITH {_TR} SELECT id, model, close_date, CASE WHEN count(*) OVER w >= 5 THEN {sql_r('avg(r) OVER w')} END AS mean, CASE WHEN count(*) OVER w >= 5 THEN {sql_r('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) OVER w')} END AS win_rate, count(*) OVER w AS n FROM done WINDOW w AS (PARTITION BY model ORDER BY close_date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW)")
def k33(spark, d):
    """The window is (t - 90 days, t]: its start is exclusive. Sums per model and day first, then over days; each trade takes its day's."""
    t = done(spark, d)
    daily = t.groupBy("model", "close_date").agg(F.count("*").alias("dn"), F.sum("r").alias("ds"), F.count_if(F.col("r") > 0).alias("dw"))
    daily = scans.trailing(daily, ["model"], F.unix_date("close_date"), 90, n=F.col("dn"), s=F.col("ds"), wins=F.col("dw")).select("model", "close_date", "n", "s", "wins")
    share = lambda c: F.when(F.col("n") >= 5, r(F.col(c) / F.col("n")))
    return t.join(daily, ["model", "close_date"]).select("id", "model", "close_date", share("s").alias("mean"), share("wins").alias("win_rate"), "n")


@_query("k34_weekly_report", f"WITH {TRADES} SELECT 'new' AS section, id FROM trades WHERE entry_date BETWEEN DATE '1998-06-01' AND DATE '1998-06-08' UNION ALL SELECT 'open', id FROM trades WHERE status = 'open' AND entry_date <= DATE '1998-06-08' UNION ALL SELECT 'closed', id FROM trades WHERE status <> 'open' AND close_date BETWEEN DATE '1998-06-01' AND DATE '1998-06-08'")
def k34(spark, d):
    week = "between date'1998-06-01' and date'1998-06-08'"
    kinds = {"new": f"entry_date {week}", "open": "status = 'open' and entry_date <= date'1998-06-08'", "closed": f"status <> 'open' and close_date {week}"}
    each = F.array_compact(F.array(*[F.when(F.expr(c), k) for k, c in kinds.items()]))
    return trades(spark, d).select(F.explode(each).alias("section"), "id")


@_query("k35_open_trade_review", f"WITH {TRADES}, {BARS}, o AS (SELECT * FROM trades WHERE status = 'open'), x AS (SELECT o.*, b.close AS price FROM o ASOF LEFT JOIN bars b ON o.symbol = b.symbol AND o.close_date >= b.date) SELECT id, CASE WHEN price >= entry_price * 1.1 THEN 'target' WHEN price <= entry_price * 0.95 THEN 'stop' WHEN close_date - entry_date >= 30 THEN 'expired' WHEN price IS NULL THEN 'no_price' ELSE 'hold' END AS review, CAST(close_date - entry_date AS INTEGER) AS days, {sql_r('price / entry_price - 1')} AS unrealized FROM x")
def k35(spark, d):
    o = asof.asof_join(trades(spark, d).where("status = 'open'"), bars(spark, d).select("symbol", "date", F.col("close").alias("price")), ["symbol"], "close_date", "date", ["price"])
    p, e, days = F.col("price"), F.col("entry_price"), F.date_diff("close_date", "entry_date")
    return o.select("id", F.when(p >= e * 1.1, "target").when(p <= e * 0.95, "stop").when(days >= 30, "expired").when(p.isNull(), "no_price").otherwise("hold").alias("review"), days.alias("days"), r(F.try_divide(p, e) - 1).alias("unrealized"))


_TOL = lambda values: "CASE id % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {values[3]} END"


@_query("k36_recommendations", f"WITH {TRADES}, k AS (SELECT *, (prediction - 0.5) / 11 AS s, row_number() OVER (PARTITION BY model ORDER BY prediction DESC, id) AS rn FROM trades WHERE prediction > 0.5) SELECT id, model, {sql_r('entry_price * (1 + s * 0.5)', 2)} AS target, {sql_r(f'entry_price * (1 - {_TOL(pf.STOP_LOSS)})', 2)} AS stop, {sql_r(f'least({_TOL(pf.BASE_SIZE)} * (1 + s), 0.10)')} AS size, CAST(CASE WHEN s > 0.5 THEN 20 ELSE 60 END AS INTEGER) AS horizon, CASE WHEN s >= 0.7 THEN 'HIGH' WHEN s >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM k WHERE rn <= 1000 AND s >= 0.4 AND entry_price > 0")
def k36(spark, d):
    """Each model's 1000 strongest, of at least medium confidence; tolerances from 1 to 5, and others that count as 3."""
    t = trades(spark, d).withColumn("s", (F.col("prediction") - 0.5) / 11).withColumn("tolerance", (F.col("id") % 7).cast("int"))
    k = pf.recommended(t, "s", "entry_price", "tolerance", 1000, "MEDIUM", by=("model",), order=("id",))
    return k.select("id", "model", r("target", 2).alias("target"), r("stop", 2).alias("stop"), r("size").alias("size"), "horizon", "confidence")


_ACTIVE = f"""WITH {TRADES}, {BARS}, act AS (SELECT symbol, sum(quantity) / CAST(sum(sum(quantity)) OVER () AS DOUBLE) AS weight FROM trades WHERE status = 'open' GROUP BY symbol), days AS (SELECT DISTINCT date AS day FROM bars WHERE isodow(date) = 1),
l AS (SELECT day, symbol, weight, date, close, date >= day - 1 AS near FROM days JOIN bars ON date BETWEEN day - 7 AND day JOIN act USING (symbol)),
p AS (SELECT day, symbol, any_value(weight) AS weight, count(*) AS n, first(close ORDER BY date) AS f, last(close ORDER BY date) AS l, count(*) FILTER (near) AS nn, first(close ORDER BY date) FILTER (near) AS nf, last(close ORDER BY date) FILTER (near) AS nl FROM l GROUP BY day, symbol),
x AS (SELECT day, coalesce(sum(CASE WHEN nn >= 2 THEN weight * (nl / nf - 1) END), 0) AS d, coalesce(sum(CASE WHEN n >= 2 THEN weight * (l / f - 1) END), 0) AS w FROM days LEFT JOIN p USING (day) GROUP BY day)"""


@_query("k37_portfolio_breaker", f"{_ACTIVE} SELECT day, {sql_r('d')} AS day_return, {sql_r('w')} AS week_return, CASE WHEN d < -0.03 THEN 'daily_loss' WHEN w < -0.05 THEN 'weekly_loss' END AS halt, {sql_r('CASE WHEN w > -0.05 AND w < -0.03 THEN greatest(0.5, 1 - 0.5 * (w + 0.03) / (-0.02)) ELSE 1.0 END')} AS size FROM x")
def k37_portfolio(spark, d):
    """The open trades' portfolio on every Monday with prices: its returns of a day and a week, whether to halt, and the size multiplier."""
    held = trades(spark, d).where("status = 'open'").groupBy("symbol").agg(F.sum("quantity").alias("q"))
    held = held.select("symbol", (F.col("q") / F.sum("q").over(Window.partitionBy())).alias("weight"))  # one row a symbol
    b = bars(spark, d).select("symbol", "date", "close")
    days = b.where("weekday(date) = 0").select(F.col("date").alias("day")).distinct()
    halt, size = pf.breaker(F.col("day_return"), F.col("week_return"))
    return pf.held_returns(held, b, days).select("day", r("day_return").alias("day_return"), r("week_return").alias("week_return"), halt.alias("halt"), r(size).alias("size"))


@_query("k37_k38_circuit_breaker", f"WITH {_BENCH}, x AS (SELECT date, b, sum(b) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS week FROM bench) SELECT date, {sql_r('b')} AS day_return, {sql_r('week')} AS week_return, CASE WHEN b < -0.03 OR week < -0.05 THEN 'halt' WHEN b < -0.01 THEN 'reduce' ELSE 'normal' END AS mode FROM x")
def k37(spark, d):
    week = F.sum("b").over(Window.orderBy("date").rowsBetween(-4, 0))  # one row a date
    return bench(spark, d).withColumn("week", week).select("date", r("b").alias("day_return"), r("week").alias("week_return"), F.when((F.col("b") < -0.03) | (F.col("week") < -0.05), "halt").when(F.col("b") < -0.01, "reduce").otherwise("normal").alias("mode"))


@_query("k38_sector_concentration", f"WITH {_W}, s AS (SELECT date, coalesce(sector, 'Unknown') AS sector, sum(weight) AS w FROM wt GROUP BY ALL) SELECT date, sector, {sql_r('w')} AS weight FROM s WHERE {sql_r('w', 9)} > 0.3")
def k38(spark, d):
    return _weights(spark, d).groupBy("date", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum("weight").alias("w")).where(r("w", 9) > 0.3).select("date", "sector", r("w").alias("weight"))


@_query("k39_model_accuracy", f"WITH {_TR} SELECT model, count(*) AS n, {sql_r('avg(CASE WHEN sign(prediction) = sign(round(r, 9)) THEN 1.0 ELSE 0 END)')} AS directional, {sql_r('avg(abs(prediction / 100 - r))')} AS mean_error, {sql_r('corr(prediction, r)')} AS corr, avg(CASE WHEN sign(prediction) = sign(round(r, 9)) THEN 1.0 ELSE 0 END) < 0.5 AS degraded FROM done GROUP BY model HAVING count(*) >= 5")
def k39(spark, d):
    hit = F.avg(F.when(F.signum("prediction") == F.signum(F.round("r", 9)), 1.0).otherwise(0.0))
    return done(spark, d).groupBy("model").agg(F.count("*").alias("n"), r(hit).alias("directional"), r(F.avg(F.abs(F.col("prediction") / 100 - F.col("r")))).alias("mean_error"), r(F.corr("prediction", "r")).alias("corr"), (hit < 0.5).alias("degraded")).where("n >= 5")


#: Kinds of events in the order of the event stream's names; a hypothesis is a user's event number modulo 7.
_GATES = f"""WITH {_TR}, kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS kind FROM (SELECT DISTINCT event_type FROM events)), e AS (SELECT user_id * 7 + event_id % 7 AS h, kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts FROM events JOIN kinds USING (event_type)),
kills AS (SELECT h, ts, 'gate_' || CAST(k % 5 AS VARCHAR) AS reason FROM e WHERE kind = 1), passes AS (SELECT h, ts FROM e WHERE kind = 2), updates AS (SELECT h, ts FROM e WHERE kind = 3 AND k < 30),
st AS (SELECT h, CASE h % 11 WHEN 0 THEN 'testing' WHEN 1 THEN 'validated' WHEN 2 THEN 'rejected' WHEN 3 THEN 'deployed' ELSE 'draft' END AS status FROM (SELECT DISTINCT h FROM e)), n AS (SELECT max(h) + 1 AS n FROM e), o AS (SELECT id % (SELECT n FROM n) AS h, avg(r) AS mean FROM done GROUP BY 1),
kk AS (SELECT k.*, st.status, (SELECT min(u.ts) FROM updates u WHERE u.h = k.h AND u.ts > k.ts) AS up FROM kills k JOIN st ON st.h = k.h),
g AS (SELECT reason, count(*) AS n, count(*) FILTER (status IN ('testing', 'validated', 'deployed') OR up IS NOT NULL) AS wrong, avg((epoch_us(up) - epoch_us(ts)) / CAST(3.6e9 AS DOUBLE)) AS hours FROM kk GROUP BY reason),
p AS (SELECT count(*) AS n, count(*) FILTER (status = 'rejected' OR coalesce(mean, 0) < -0.02) AS wrong FROM passes JOIN st ON st.h = passes.h LEFT JOIN o ON o.h = passes.h)"""


@_query("k40_gate_calibration", f"{_GATES} SELECT 'kill' AS side, reason, n, {sql_r('n / sum(n) OVER ()')} AS share, wrong, {sql_r('wrong / n')} AS rate, {sql_r('hours', 3)} AS hours FROM g UNION ALL SELECT 'pass', NULL, n, NULL, wrong, {sql_r('wrong / n')}, NULL FROM p")
def k40(spark, d):
    """Kills by reason with false positives and the time to the next update; passes with false negatives by status or by the trades that followed."""
    e = read(spark, d, "events")
    kinds = e.select("event_type").distinct().withColumn("kind", F.row_number().over(Window.orderBy("event_type")))  # a few kinds
    e = e.join(F.broadcast(kinds), "event_type").select((F.col("user_id") * 7 + F.col("event_id") % 7).alias("hypothesis_id"), "kind", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts")
    state = F.element_at(F.array(*[F.lit(x) for x in ("testing", "validated", "rejected", "deployed")]), F.least(F.col("hypothesis_id") % 11 + 1, F.lit(4)).cast("int"))
    statuses = e.select("hypothesis_id").distinct().select("hypothesis_id", F.when(F.col("hypothesis_id") % 11 < 4, state).otherwise("draft").alias("status"))
    n = e.agg((F.max("hypothesis_id") + 1).alias("n"))  # one row
    outcomes = done(spark, d).crossJoin(F.broadcast(n)).select((F.col("id") % F.col("n")).alias("hypothesis_id"), "r")
    of = lambda kind: e.where(F.col("kind") == kind)
    g = pf.gate_calibration(of(1).select("hypothesis_id", "ts", F.concat(F.lit("gate_"), (F.col("k") % 5).cast("string")).alias("reason")), of(2).select("hypothesis_id", "ts"), of(3).where("k < 30").select("hypothesis_id", "ts"), statuses, outcomes)
    return g.select("side", "reason", "n", r("share").alias("share"), "wrong", r("rate").alias("rate"), r("hours", 3).alias("hours"))


def _pw(x: str, bad: float, target: float, good: float) -> str:
    """SQL of a piecewise score."""
    up = good > bad
    below = lambda v: f"({x}) {'<=' if up else '>='} {v}"
    return f"CASE WHEN ({x}) IS NULL OR {below(bad)} THEN 0.0 WHEN ({x}) {'>=' if up else '<='} {good} THEN 1.0 WHEN {below(target)} THEN 0.5 * (({x}) - {bad}) / CAST({target} - {bad} AS DOUBLE) ELSE 0.5 + 0.5 * (({x}) - {target}) / CAST({good} - {target} AS DOUBLE) END"


#: Dimension -> (measure, bad, target, good) of its scores.
_SCORES = {"statistical": [("sharpe", 0.5, 1.0, 1.5), ("stability", 2.0, 1.0, 0.5), ("ic", 0.01, 0.03, 0.05), ("cv", 3.0, 2.0, 1.0)], "risk": [("drawdown", 0.3, 0.2, 0.1), ("vol", 0.25, 0.15, 0.10)], "economic": [("win", 0.4, 0.5, 0.6)], "cost": [("turnover", 1.0, 0.5, 0.2), ("net", 0.0, 0.005, 0.01)]}
_DIMS = ", ".join("(" + " + ".join(_pw(*x) for x in v) + f") / {len(v)} AS {k}" for k, v in _SCORES.items())


@_query("k41_score_decisions", f"WITH {_TR}, y AS (SELECT symbol, year(close_date) AS yr, avg(r) AS m FROM done GROUP BY ALL), z AS (SELECT symbol, stddev_samp(m) / abs(avg(m)) AS cv FROM y GROUP BY symbol), m AS (SELECT symbol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, stddev_samp(r) / abs(avg(r)) / 10 AS stability, corr(prediction, r) AS ic, -min(r) AS drawdown, stddev_samp(r) AS vol, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win, count(*) / CAST(200 AS DOUBLE) AS turnover, avg(r) - 0.001 AS net FROM done GROUP BY symbol), d AS (SELECT symbol, {_DIMS}, drawdown > 0.199 AND avg_net < 0 AS critical FROM (SELECT *, net AS avg_net FROM m JOIN z USING (symbol))), s AS (SELECT *, (statistical + risk + economic + cost) / 4 AS score FROM d) SELECT symbol, {sql_r('score', 6)} AS score, CASE WHEN critical THEN 'PIVOT' WHEN {sql_r('score', 6)} >= 0.75 THEN 'CONTINUE' WHEN {sql_r('score', 6)} >= 0.5 THEN 'CONDITIONAL' ELSE 'KILL' END AS decision FROM s")
def k41(spark, d):
    """Four dimensions, each the mean of piecewise scores; a critical failure is a deep drawdown of what loses after costs."""
    t = done(spark, d)
    cv = t.groupBy("symbol", F.year("close_date").alias("yr")).agg(F.avg("r").alias("m")).groupBy("symbol").agg(pf.ratio(F.stddev_samp("m"), F.abs(F.avg("m"))).alias("cv"))
    m = t.groupBy("symbol").agg((pf.ratio(F.avg("r"), F.stddev_samp("r")) * 252**0.5).alias("sharpe"), (pf.ratio(F.stddev_samp("r"), F.abs(F.avg("r"))) / 10).alias("stability"), pf.correlation("prediction", "r").alias("ic"), (-F.min("r")).alias("drawdown"), F.stddev_samp("r").alias("vol"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win"), (F.count("*") / 200.0).alias("turnover"), (F.avg("r") - 0.001).alias("net")).join(cv, "symbol")
    dims = [(sum((pf.piecewise(F.col(c), *at) for c, *at in v), F.lit(0.0)) / len(v)).alias(k) for k, v in _SCORES.items()]
    score, decision = pf.decisions(list(_SCORES), F.col("critical"))
    return m.select("symbol", *dims, ((F.col("drawdown") > 0.199) & (F.col("net") < 0)).alias("critical")).select("symbol", r(score, 6).alias("score"), decision.alias("decision"))


@_query("k41_decision_counts", ORACLE["k41_score_decisions"].replace(f" SELECT symbol, {sql_r('score', 6)} AS score, CASE WHEN critical", " SELECT CASE WHEN critical").replace("AS decision FROM s", "AS decision, count(*) AS n FROM s GROUP BY 1"))
def k41_counts(spark, d):
    return k41(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


@_query("k42_strategy_weights", f"WITH {_TR}, v AS (SELECT model, 0.1 / stddev_samp(r) AS w FROM done GROUP BY model) SELECT model, {sql_r('w * least(1, 0.4 / max(w) OVER ())', 6)} AS weight FROM v")
def k42(spark, d):
    v = done(spark, d).groupBy("model").agg((0.1 / F.stddev_samp("r")).alias("w"))
    return v.select("model", r(F.col("w") * F.least(F.lit(1.0), 0.4 / F.max("w").over(Window.partitionBy())), 6).alias("weight"))  # one row a strategy


@_query("k43_cost_survival", f"WITH {_TR} SELECT model, {sql_r('sum(r)', 3)} AS gross, {sql_r('sum(r) - count(*) * 10 / CAST(10000 AS DOUBLE)', 3)} AS net, sum(r) - count(*) * 10 / CAST(10000 AS DOUBLE) > 0 AS survives FROM done GROUP BY model")
def k43(spark, d):
    net = F.sum("r") - F.count("*") * 10 / 10000.0
    return done(spark, d).groupBy("model").agg(r(F.sum("r"), 3).alias("gross"), r(net, 3).alias("net"), (net > 0).alias("survives"))
