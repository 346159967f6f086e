"""Queries of the feature store: F01-F27, S12-S14, K14, and the flagship momentum screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ewm, features
from ..operators import research
from ..session import written
from ..sources.views import ACTIONS, BARS, STATEMENTS, SYMBOLS, actions, bars, r, sql_r, statements, symbols

_PRICE_SCALE = {"volume_20d", "sma_20d", "sma_50d", "sma_200d", "bb_upper_20d", "bb_lower_20d", "obv", "vwap_20d", "ema_12d", "ema_26d", "macd_line", "macd_signal", "macd_histogram", "atr_14d"}


def _digits(name: str) -> int:
    return 2 if name in _PRICE_SCALE else 4


def _w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {_w(n)} = {n} THEN {agg}({c}) {_w(n)} END"


_L = "OVER (PARTITION BY symbol ORDER BY date)"
_chg = lambda n: f"p / lag(p, {n}) {_L} - 1"
_STAGES = BARS + f""", base AS (SELECT *, coalesce(adj_close, close) AS p FROM bars),
s1 AS (SELECT *, {_chg(1)} AS r1, {_chg(5)} AS r5, p - lag(p) {_L} AS dp, (high + low + p) / 3 AS tp, lag(p) {_L} AS pc FROM base),
s2 AS (SELECT *, ln(p / pc) AS log_r, CASE WHEN r1 < 0 THEN r1 ELSE 0.0 END AS down, lag(r5) {_L} AS r5_before,
  CASE WHEN tp > lag(tp) {_L} THEN tp * volume ELSE 0.0 END AS flow_up, CASE WHEN tp < lag(tp) {_L} THEN tp * volume ELSE 0.0 END AS flow_down,
  {_full('min', 'low', 14)} AS low14, {_full('max', 'high', 14)} AS high14, tp * volume AS tpv FROM s1),
s3 AS (SELECT *, 100 * (p - low14) / nullif(high14 - low14, 0) AS k14 FROM s2)"""
_SQL = {
    **{f"returns_{n}d": _chg(n) for n in (1, 5, 20, 60, 252)},
    **{f"momentum_{n}d": _chg(n) for n in (20, 60, 252)},
    "roc_10d": f"100 * ({_chg(10)})",
    **{f"volatility_{n}d": f"({_full('stddev_samp', 'log_r', n)}) * sqrt(252)" for n in (20, 60)},
    **{f"simple_volatility_{n}d": f"({_full('stddev_samp', 'r1', n)}) * sqrt(252)" for n in (20, 60)},
    "volume_20d": _full("avg", "volume", 20),
    "volume_ratio": f"volume / nullif({_full('avg', 'volume', 20)}, 0)",
    **{f"sma_{n}d": _full("avg", "p", n) for n in (20, 50, 200)},
    **{f"price_to_sma_{n}d": f"p / nullif({_full('avg', 'p', n)}, 0)" for n in (20, 50, 200)},
    "trend": f"CAST(sign(p - ({_full('avg', 'p', 200)})) AS DOUBLE)",
    "bb_upper_20d": f"({_full('avg', 'p', 20)}) + 2 * ({_full('stddev_samp', 'p', 20)})",
    "bb_lower_20d": f"({_full('avg', 'p', 20)}) - 2 * ({_full('stddev_samp', 'p', 20)})",
    "bb_width_20d": f"4 * ({_full('stddev_samp', 'p', 20)}) / nullif({_full('avg', 'p', 20)}, 0)",
    "stoch_k_14d": "k14",
    "stoch_d_14d": _full("avg", "k14", 3),
    "williams_r_14d": "-100 * (high14 - p) / nullif(high14 - low14, 0)",
    "obv": "sum(sign(dp) * volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "vwap_20d": f"({_full('sum', 'tpv', 20)}) / nullif({_full('sum', 'volume', 20)}, 0)",
    "mfi_14d": f"CASE WHEN count(tp) {_w(14)} = 14 THEN CASE WHEN sum(flow_down) {_w(14)} > 0 THEN 100 - 100 / (1 + sum(flow_up) {_w(14)} / sum(flow_down) {_w(14)}) WHEN sum(flow_up) {_w(14)} > 0 THEN 100.0 END END",
    "cci_20d": f"CASE WHEN count(tp) {_w(20)} = 20 THEN (tp - avg(tp) {_w(20)}) / nullif(0.015 * list_sum(list_transform(list(tp) {_w(20)}, lambda x: abs(x - avg(tp) {_w(20)}))) / 20, 0) END",
    "skewness_60d": _full("skewness", "r1", 60),
    "kurtosis_60d": _full("kurtosis", "r1", 60),
    "downside_vol_60d": f"({_full('stddev_samp', 'down', 60)}) * sqrt(252)",
    "autocorrelation_5d": f"CASE WHEN count(r5) {_w(60)} = 60 THEN corr(r5, r5_before) {_w(59)} END",
}
_mu, _sd = _full("avg", "r1", 252), _full("stddev_samp", "r1", 252)
for _name, (_level, _days, _short) in {"var_95_1d": (95, 1, 0), "cvar_95_1d": (95, 1, 1), "var_99_1d": (99, 1, 0), "var_95_10d": (95, 10, 0)}.items():
    _z, _d = features.Z[_level]
    _SQL[_name] = f"-({_mu}) * {_days} + ({_sd}) * sqrt({_days}) * {_d} / {1 - _level / 100!r}" if _short else f"-(({_mu}) * {_days} - {_z} * ({_sd}) * sqrt({_days}))"
_SQL["cci_20d"] = "cci"


def _oracle(names: list[str]) -> str:
    cols = ", ".join(f"{sql_r(_SQL[n], _digits(n))} AS {n}" for n in names)
    cci = ""
    source = "s3"
    if "cci_20d" in names:
        cci = f""", m AS (SELECT *, avg(tp) {_w(20)} AS tm, list(tp) {_w(20)} AS tl FROM s3),
        s4 AS (SELECT *, CASE WHEN len(tl) = 20 THEN (tp - tm) / nullif(0.015 * list_sum(list_transform(tl, lambda x: abs(x - tm))) / 20, 0) END AS cci FROM m)"""
        source = "s4"
    return f"WITH {_STAGES}{cci} SELECT symbol, date, {cols} FROM {source}"


def _group(names: list[str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features.window_features(bars(spark, sf_dir), names).select("symbol", "date", *[r(n, _digits(n)).alias(n) for n in names])

    return query


GROUPS = {
    "f01_f03_returns": [*[f"returns_{n}d" for n in (1, 5, 20, 60, 252)], *[f"momentum_{n}d" for n in (20, 60, 252)], "roc_10d"],
    "f04_f05_volatility_volume": ["volatility_20d", "volatility_60d", "simple_volatility_20d", "simple_volatility_60d", "volume_20d", "volume_ratio"],
    "f06_f09_averages_bands": ["sma_20d", "sma_50d", "sma_200d", "price_to_sma_20d", "price_to_sma_50d", "price_to_sma_200d", "trend", "bb_upper_20d", "bb_lower_20d", "bb_width_20d"],
    "f10_f15_oscillators": ["stoch_k_14d", "stoch_d_14d", "williams_r_14d", "obv", "vwap_20d", "mfi_14d", "cci_20d"],
    "f16_f19_moments": ["skewness_60d", "kurtosis_60d", "downside_vol_60d", "autocorrelation_5d"],
    "k14_parametric_var": ["var_95_1d", "cvar_95_1d", "var_99_1d", "var_95_10d"],
}
QUERIES = {name: _group(names) for name, names in GROUPS.items()}
ORACLE = {name: _oracle(names) for name, names in GROUPS.items()}


def ewm_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ewm.ewm_features(bars(spark, sf_dir)).select("symbol", "date", *[r(n, _digits(n)).alias(n) for n in ewm.OUTPUTS])


QUERIES["f20_f25_exponential"] = ewm_family
_a = lambda span: repr(2 / (span + 1))
_mix = lambda new, old, span: f"({_a(span)}) * ({new}) + (1 - {_a(span)}) * {old}"
_dx = lambda plus, minus, atr: f"100 * abs(100 * ({plus}) / nullif({atr}, 0) - 100 * ({minus}) / nullif({atr}, 0)) / nullif(100 * ({plus}) / nullif({atr}, 0) + 100 * ({minus}) / nullif({atr}, 0), 0)"
ORACLE["f20_f25_exponential"] = f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, date, close AS p, high, low, row_number() {_L} AS i,
  coalesce(greatest(close - lag(close) {_L}, 0), 0) AS g, coalesce(greatest(lag(close) {_L} - close, 0), 0) AS l,
  greatest(high - low, abs(high - lag(close) {_L}), abs(low - lag(close) {_L})) AS tr0, high - low AS hl, high - lag(high) {_L} AS up, lag(low) {_L} - low AS dn FROM bars),
x AS (SELECT *, coalesce(tr0, hl) AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM n),
e AS (SELECT symbol, date, i, p AS e12, p AS e26, CAST(0 AS DOUBLE) AS sig, g AS eg, l AS el, tr AS atr, CAST(pdm AS DOUBLE) AS ep, CAST(mdm AS DOUBLE) AS em, CAST(NULL AS DOUBLE) AS adx FROM x WHERE i = 1
 UNION ALL SELECT symbol, date, i, e12, e26, {_mix('e12 - e26', 'psig', 9)}, eg, el, atr, ep, em, CASE WHEN padx IS NULL THEN dx WHEN dx IS NULL THEN padx ELSE {_mix('dx', 'padx', 14)} END FROM (
 SELECT *, {_dx('ep', 'em', 'atr')} AS dx FROM (SELECT x.symbol, x.date, x.i, {_mix('x.p', 'e.e12', 12)} AS e12, {_mix('x.p', 'e.e26', 26)} AS e26, e.sig AS psig, {_mix('x.g', 'e.eg', 14)} AS eg,
 {_mix('x.l', 'e.el', 14)} AS el, {_mix('x.tr', 'e.atr', 14)} AS atr, {_mix('x.pdm', 'e.ep', 14)} AS ep, {_mix('x.mdm', 'e.em', 14)} AS em, e.adx AS padx FROM e JOIN x ON x.symbol = e.symbol AND x.i = e.i + 1)))
SELECT symbol, date, {sql_r('e12', 2)} AS ema_12d, {sql_r('e26', 2)} AS ema_26d, {sql_r('CAST(sign(e12 - e26) AS DOUBLE)')} AS ema_crossover, {sql_r('e12 - e26', 2)} AS macd_line, {sql_r('sig', 2)} AS macd_signal, {sql_r('e12 - e26 - sig', 2)} AS macd_histogram,
 {sql_r('CASE WHEN el > 0 THEN 100 - 100 / (1 + eg / el) WHEN eg > 0 THEN 100.0 END')} AS rsi_14d, {sql_r('atr', 2)} AS atr_14d, {sql_r('adx')} AS adx_14d FROM e"""

_LONG = ["returns_20d", "sma_20d", "volume_ratio"]
_START, _END = "1996-01-01", "1999-12-31"


def feature_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the daily job over four years, long output."""
    long, _ = features.run(bars(spark, sf_dir), _LONG, _START, _END)
    return long.select("symbol", "date", "feature_name", r("value", 2).alias("value"), "version")


QUERIES["f26_s12_feature_run_long"] = feature_run
ORACLE["f26_s12_feature_run_long"] = f"WITH {_STAGES.replace('FROM bars)', f'FROM bars WHERE date BETWEEN DATE {_START!r} - 400 AND DATE {_END!r})')} " + " UNION ALL ".join(
    f"SELECT symbol, date, '{n}' AS feature_name, {sql_r('v', 2)} AS value, 'v1' AS version FROM (SELECT symbol, date, {_SQL[n]} AS v FROM s3 QUALIFY count(*) OVER (PARTITION BY symbol) >= 60) WHERE v IS NOT NULL AND date BETWEEN DATE '{_START}' AND DATE '{_END}'" for n in _LONG
)


def partial_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """three features only, with 60 days of warm-up before the range."""
    span = bars(spark, sf_dir).where("date between date_sub(date'1998-01-01', 60) and date'1998-12-31'")
    a = ewm.ewm_features(span, ("ema_12d", "ema_26d"))
    b = features.window_features(span, ["vwap_20d"]).drop("p")
    return a.join(b, ["symbol", "date"]).where("date >= date'1998-01-01'").select("symbol", "date", r("ema_12d", 2).alias("ema_12d"), r("ema_26d", 2).alias("ema_26d"), r("vwap_20d", 2).alias("vwap_20d"))


QUERIES["f27_partial_recompute"] = partial_recompute
ORACLE["f27_partial_recompute"] = f"""WITH RECURSIVE {BARS}, n AS (SELECT *, row_number() {_L} AS i, (high + low + close) / 3 AS tp FROM bars WHERE date BETWEEN DATE '1998-01-01' - 60 AND DATE '1998-12-31'),
v AS (SELECT symbol, i, CASE WHEN count(*) {_w(20)} = 20 THEN sum(tp * volume) {_w(20)} / nullif(sum(volume) {_w(20)}, 0) END AS vwap FROM n),
e AS (SELECT symbol, date, i, close AS e12, close AS e26 FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.date, n.i, {_mix('n.close', 'e.e12', 12)}, {_mix('n.close', 'e.e26', 26)} FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
SELECT e.symbol, e.date, {sql_r('e12', 2)} AS ema_12d, {sql_r('e26', 2)} AS ema_26d, {sql_r('vwap', 2)} AS vwap_20d FROM e JOIN v ON v.symbol = e.symbol AND v.i = e.i WHERE e.date >= DATE '1998-01-01'"""


def wide_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 with S14: versioned rows read back wide, of each feature's newest active version."""
    b = bars(spark, sf_dir)
    v1 = features.to_long(features.window_features(b, _LONG), _LONG, "v1")
    v2 = v1.where("feature_name = 'returns_20d'").select("symbol", "date", "feature_name", (F.col("value") * 2).alias("value"), F.lit("v2").alias("version"))
    return features.to_wide(v1.unionByName(v2), _LONG, active_versions(registry(spark))).select("symbol", "date", r("returns_20d").alias("returns_20d"), r("sma_20d", 2).alias("sma_20d"), r("volume_ratio").alias("volume_ratio"))


def registry(spark: SparkSession) -> DataFrame:
    """A registry of feature versions: what an operator of the store would have entered."""
    rows = [(n, "v1", "2024-01-01", True) for n in _LONG] + [("returns_20d", "v2", "2024-02-01", True), ("sma_20d", "v2", "2024-02-01", False)]
    return spark.createDataFrame(rows, "feature_name string, version string, created_at string, is_active boolean")


def active_versions(versions: DataFrame) -> DataFrame:
    """Newest active version of each feature."""
    return versions.where("is_active").groupBy("feature_name").agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))


QUERIES["s13_s14_wide_read_active_version"] = wide_read
ORACLE["s13_s14_wide_read_active_version"] = f"""WITH {_STAGES}, f AS (SELECT symbol, date, 2 * ({_SQL['returns_20d']}) AS a, {_SQL['sma_20d']} AS b, {_SQL['volume_ratio']} AS c FROM s3)
SELECT symbol, date, {sql_r('a')} AS returns_20d, {sql_r('b', 2)} AS sma_20d, {sql_r('c')} AS volume_ratio FROM f WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL"""


def momentum_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 25 by 20-day momentum on the latest date, of symbols that traded in the week before; the flagship query."""
    b = bars(spark, sf_dir)
    f = features.window_features(b, ["momentum_20d", "sma_20d", "volatility_20d"]).withColumn("before", F.lag("date").over(features.w()))
    last = b.agg(F.max("date").alias("last"))
    # each symbol's newest row stands for it on the latest date, if it isn't older than 30 days
    newest = f.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("rn = 1").crossJoin(F.broadcast(last)).where("date >= date_sub(last, 30) and date_diff(date, before) <= 7 and momentum_20d is not null")
    top = newest.join(symbols(spark, sf_dir), "symbol").orderBy(F.desc(r("momentum_20d", 6)), "symbol").limit(25)
    return top.select("symbol", "name", "sector", "date", r("momentum_20d", 6).alias("momentum_20d"), r("sma_20d", 2).alias("sma_20d"), r("volatility_20d").alias("volatility_20d"))


QUERIES["r13_momentum_screen"] = momentum_screen
ORACLE["r13_momentum_screen"] = f"""WITH {_STAGES}, {SYMBOLS}, f AS (SELECT symbol, date, lag(date) {_L} AS before, {_SQL['momentum_20d']} AS m, {_SQL['sma_20d']} AS s, {_SQL['volatility_20d']} AS v FROM s3),
newest AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
SELECT symbol, name, sector, date, {sql_r('m', 6)} AS momentum_20d, {sql_r('s', 2)} AS sma_20d, {sql_r('v')} AS volatility_20d FROM newest JOIN symbols USING (symbol)
WHERE date >= (SELECT max(date) FROM bars) - 30 AND date - before <= 7 AND m IS NOT NULL ORDER BY {sql_r('m', 6)} DESC, symbol LIMIT 25"""


def preset_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight preset screens at once, over each symbol's newest row of the last 30 days; earnings are units sold in the last quarter, dividends the last cash action."""
    names = ["momentum_20d", "volume_ratio", "price_to_sma_200d", "volatility_20d"]
    newest = written(features.newest(bars(spark, sf_dir), [*names, "rsi_14d", "adx_14d"]), "newest")
    last = newest.agg(F.max("last_date").alias("last"))  # one row
    earned = statements(spark, sf_dir).groupBy("symbol").agg(F.max_by("units", "period_end").alias("units"))
    paid = actions(spark, sf_dir).groupBy("symbol").agg(F.max_by("cash", "date").alias("cash"))
    wide = newest.join(F.broadcast(last)).where("date >= date_sub(last, 30)").join(symbols(spark, sf_dir), "symbol").join(earned, "symbol", "left").join(paid, "symbol", "left")
    wide = wide.withColumn("pe_ratio", F.try_divide("market_cap", "units")).withColumn("dividend_yield", F.try_divide("cash", "close") * 1e4)
    kept = [F.round(F.col(c) + 1.7e-8, 4).alias(c) for c in (*names, "rsi_14d", "adx_14d", "pe_ratio", "dividend_yield")]
    top = research.screened(wide.select("symbol", "date", "before", *kept), F.date_diff("date", "before") <= 7)
    return top.join(symbols(spark, sf_dir), "symbol").select("screen", "rank", "symbol", "name", "sector", "value")


QUERIES["r13_preset_screens"] = preset_screens
_PRE = {"momentum_20d": _SQL["momentum_20d"], "volume_ratio": _SQL["volume_ratio"], "price_to_sma_200d": _SQL["price_to_sma_200d"], "volatility_20d": _SQL["volatility_20d"]}
_EWM = ORACLE["f20_f25_exponential"]
ORACLE["r13_preset_screens"] = f"""{_EWM[: _EWM.rindex("SELECT symbol, date, round")].rstrip()}, {_STAGES.replace(BARS + ", ", "")}, {SYMBOLS}, {STATEMENTS}, {ACTIONS},
es AS (SELECT symbol, last({sql_r('CASE WHEN el > 0 THEN 100 - 100 / (1 + eg / el) WHEN eg > 0 THEN 100.0 END')} ORDER BY date) AS rsi_14d, last({sql_r('adx')} ORDER BY date) AS adx_14d FROM e GROUP BY symbol),
fs AS (SELECT symbol, date, lag(date) {_L} AS before, close, {", ".join(f"{sql_r(v)} AS {k}" for k, v in _PRE.items())} FROM s3), ns AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
ea AS (SELECT symbol, last(units ORDER BY period_end) AS units FROM statements GROUP BY symbol), pd AS (SELECT symbol, last(cash ORDER BY date) AS cash FROM actions GROUP BY symbol),
al AS (SELECT ns.*, es.rsi_14d, es.adx_14d, symbols.name, symbols.sector, {sql_r('market_cap / nullif(units, 0)')} AS pe_ratio, {sql_r('cash / nullif(close, 0) * 10000')} AS dividend_yield FROM ns JOIN symbols USING (symbol) LEFT JOIN es USING (symbol) LEFT JOIN ea USING (symbol) LEFT JOIN pd USING (symbol) WHERE date >= (SELECT max(date) FROM bars) - 30),
un AS ({" UNION ALL ".join(f"SELECT '{k}' AS screen, symbol, name, sector, {v} AS value, {'-' if down else ''}{v} AS k FROM al WHERE {v} IS NOT NULL{f' AND {v} > 0' if pos else ''}{' AND date - before <= 7' if held else ''}" for k, (v, down, pos, held) in research.SCREENS.items())})
SELECT screen, CAST(row_number() OVER (PARTITION BY screen ORDER BY k, symbol) AS INTEGER) AS rank, symbol, name, sector, CAST(value AS DOUBLE) AS value FROM un QUALIFY row_number() OVER (PARTITION BY screen ORDER BY k, symbol) <= 25"""
