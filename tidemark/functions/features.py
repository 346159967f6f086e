"""Per-symbol window features, as columns over one partitioning: a registry of name -> builder, computed in three stacked selects.

Rolling values are null until their window holds n non-null inputs, as pandas gives them. Input: symbol, date, open, high, low, close, adj_close,
volume. Price is adj_close, else close; a bar without either has no features.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ewm, rolling


def w() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def rows(n: int, back: int = 0) -> Window:
    return w().rowsBetween(-(n - 1) - back, -back)


def full(agg: Callable[[Column], Column], c: str, n: int, frame=None) -> Column:
    """agg of c over the last n rows, null until all n are there."""
    over = rows(n) if frame is None else frame
    return F.when(F.count(c).over(over) == n, agg(F.col(c)).over(over))


def change(n: int) -> Column:
    return F.try_divide("p", F.lag("p", n).over(w())) - 1


def mean(c: str, n: int) -> Column:
    return full(F.avg, c, n)


def std(c: str, n: int) -> Column:
    return full(F.stddev_samp, c, n)


def mad_deviation(n: int) -> Column:
    """CCI: typical price against the window's own mean, in units of its mean absolute deviation."""
    xs, m = F.collect_list("tp").over(rows(n)), F.avg("tp").over(rows(n))
    mad = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.abs(x - m)) / n
    return F.when(F.count("tp").over(rows(n)) == n, F.try_divide(F.col("tp") - m, 0.015 * mad))


def money_flow(n: int) -> Column:
    pos, neg = F.sum("flow_up").over(rows(n)), F.sum("flow_down").over(rows(n))
    return F.when(F.count("tp").over(rows(n)) == n, F.when(neg > 0, 100 - 100 / (1 + pos / neg)).when(pos > 0, 100.0))


#: First select: what other features read.
FIRST: dict[str, Callable[[], Column]] = {
    "r1": lambda: change(1),
    "r5": lambda: change(5),
    "dp": lambda: F.col("p") - F.lag("p").over(w()),
    "tp": lambda: (F.col("high") + F.col("low") + F.col("p")) / 3,
    "pc": lambda: F.lag("p").over(w()),
}
SECOND: dict[str, Callable[[], Column]] = {
    "log_r": lambda: F.when((F.col("p") > 0) & (F.col("pc") > 0), F.log(F.col("p") / F.col("pc"))),
    "down": lambda: F.when(F.col("r1") < 0, F.col("r1")).otherwise(0.0),
    "r5_before": lambda: F.lag("r5").over(w()),
    "flow_up": lambda: F.when(F.col("tp") > F.lag("tp").over(w()), F.col("tp") * F.col("volume")).otherwise(0.0),
    "flow_down": lambda: F.when(F.col("tp") < F.lag("tp").over(w()), F.col("tp") * F.col("volume")).otherwise(0.0),
    "low14": lambda: full(F.min, "low", 14),
    "high14": lambda: full(F.max, "high", 14),
    "tpv": lambda: F.col("tp") * F.col("volume"),
}
THIRD: dict[str, Callable[[], Column]] = {"k14": lambda: 100 * F.try_divide(F.col("p") - F.col("low14"), F.col("high14") - F.col("low14"))}

FEATURES: dict[str, Callable[[], Column]] = {
    **{f"returns_{n}d": (lambda n=n: change(n)) for n in (1, 5, 20, 60, 252)},
    **{f"momentum_{n}d": (lambda n=n: change(n)) for n in (20, 60, 252)},
    "roc_10d": lambda: 100 * change(10),
    "volatility_20d": lambda: std("log_r", 20) * 252**0.5,
    "simple_volatility_20d": lambda: std("r1", 20) * 252**0.5,
    "volume_20d": lambda: mean("volume", 20),
    "volume_ratio": lambda: F.try_divide("volume", mean("volume", 20)),
    "sma_20d": lambda: mean("p", 20),
    "price_to_sma_20d": lambda: F.try_divide("p", mean("p", 20)),
    "bb_upper_20d": lambda: mean("p", 20) + 2 * std("p", 20),
    "bb_lower_20d": lambda: mean("p", 20) - 2 * std("p", 20),
    "bb_width_20d": lambda: F.try_divide(4 * std("p", 20), mean("p", 20)),
    "stoch_k_14d": lambda: F.col("k14"),
    "stoch_d_14d": lambda: mean("k14", 3),
    "williams_r_14d": lambda: -100 * F.try_divide(F.col("high14") - F.col("p"), F.col("high14") - F.col("low14")),
    "obv": lambda: F.sum(F.signum("dp") * F.col("volume")).over(w().rowsBetween(Window.unboundedPreceding, 0)),
    "vwap_20d": lambda: F.try_divide(full(F.sum, "tpv", 20), full(F.sum, "volume", 20)),
    "mfi_14d": lambda: money_flow(14),
    "cci_20d": lambda: mad_deviation(20),
}

#: Risk: parametric value at risk and expected shortfall of 252 returns (constants: normal quantile and density there).
Z = {95: (1.6448536269514722, 0.10313564037537128), 99: (2.3263478740408408, 0.026652142203457714)}


#: Features of wide frames, from a symbol's whole series (functions/rolling.py); what they read is in SERIES.
GROUPED: dict[str, Callable] = {
    **{f"sma_{n}d": (lambda x, n=n: rolling.frames(x["p"], n, rolling.mean)) for n in (50, 200)},
    **{f"price_to_sma_{n}d": (lambda x, n=n: rolling.ratio(x["p"], rolling.frames(x["p"], n, rolling.mean))) for n in (50, 200)},
    "trend": lambda x: np.sign(x["p"] - rolling.frames(x["p"], 200, rolling.mean)),
    "volatility_60d": lambda x: rolling.frames(x["log_r"], 60, rolling.deviation) * 252**0.5,
    "simple_volatility_60d": lambda x: rolling.frames(x["r1"], 60, rolling.deviation) * 252**0.5,
    "skewness_60d": lambda x: rolling.frames(x["r1"], 60, rolling.skewness),
    "kurtosis_60d": lambda x: rolling.frames(x["r1"], 60, rolling.kurtosis),
    "downside_vol_60d": lambda x: rolling.frames(x["down"], 60, rolling.deviation) * 252**0.5,
    "autocorrelation_5d": lambda x: rolling.autocorrelation(x["r5"], x["r5_before"]),
    "var_95_1d": lambda x: rolling.value_at_risk(x["r1"], *Z[95], 95, 1),
    "cvar_95_1d": lambda x: rolling.value_at_risk(x["r1"], *Z[95], 95, 1, True),
    "var_99_1d": lambda x: rolling.value_at_risk(x["r1"], *Z[99], 99, 1),
    "var_95_10d": lambda x: rolling.value_at_risk(x["r1"], *Z[95], 95, 10),
}
SERIES = ["p", "r1", "log_r", "r5", "r5_before", "down"]


def last_mean(v: np.ndarray, n: int) -> float:
    """Mean of the last n values, NaN if there are fewer or one is missing."""
    return float(v[-n:].mean()) if len(v) >= n else np.nan


def last_ratio(a: float, b: float) -> float:
    return float(a / b) if b != 0 else np.nan


def last_volatility(p: np.ndarray, n: int) -> float:
    v = p[-n - 1 :]
    return float(np.log(v[1:] / v[:-1]).std(ddof=1) * 252**0.5) if len(v) > n and (v > 0).all() else np.nan


#: The same features at the newest row only, of a symbol's series (NaN: null): no frame of any other row is gone over.
NEWEST: dict[str, Callable] = {
    **{f"{k}_{n}d": (lambda x, n=n: last_ratio(x["p"][-1], x["p"][-1 - n]) - 1 if len(x["p"]) > n else np.nan) for n in (20, 60, 252) for k in ("returns", "momentum")},
    "volume_ratio": lambda x: last_ratio(x["volume"][-1], last_mean(x["volume"], 20)),
    **{f"price_to_sma_{n}d": (lambda x, n=n: last_ratio(x["p"][-1], last_mean(x["p"], n))) for n in (20, 50, 200)},
    **{f"volatility_{n}d": (lambda x, n=n: last_volatility(x["p"], n)) for n in (20, 60)},
}


def register(name: str, builder: Callable[[], Column]) -> None:
    """Adds a feature to the registry; its builder may read the columns of all three selects."""
    FEATURES[name] = builder


def window_features(prices: DataFrame, names: list[str] | None = None) -> DataFrame:
    """symbol, date, p and the named features (all by default): one shuffle by symbol, one sort, however many features."""
    names = [*FEATURES, *GROUPED] if names is None else names
    base = prices.withColumn("p", F.coalesce("adj_close", "close")).where("p is not null")
    for stage in (FIRST, SECOND, THIRD):
        base = base.select("*", *[b().alias(k) for k, b in stage.items()])
    grouped = {n: GROUPED[n] for n in names if n in GROUPED}
    out = base.select("symbol", "date", "p", *[FEATURES[n]().alias(n) for n in names if n not in grouped], *(SERIES[1:] if grouped else []))
    return rolling.by_symbol(out, grouped, SERIES, SERIES[1:]).select("symbol", "date", "p", *names) if grouped else out


def newest(prices: DataFrame, names: list[str]) -> DataFrame:
    """A row a symbol: its last bar's date and close, and of its newest bar with a price the date, the date before and the named features (of NEWEST or of
    the exponential family). One pass over a symbol's days on the partitioning by symbol; only that row leaves it."""
    kind = dict(prices.dtypes)["symbol"]
    base = prices.select("symbol", "date", "close", F.coalesce("adj_close", "close").alias("p"), "high", "low", F.col("volume").cast("double").alias("volume")).where("date is not null")
    slow = tuple(n for n in names if n in ewm.OUTPUTS)

    def run(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by("date")
        last = {"symbol": tab["symbol"][-1:], "last_date": tab["date"][-1:], "close": tab["close"][-1:]}
        tab = tab.filter(tab["p"].is_valid())
        got = dict.fromkeys(names, np.nan)
        if tab.num_rows:
            x = {c: ewm.numbers(tab, c) for c in ("p", "high", "low", "volume")}
            with np.errstate(all="ignore"):
                got |= {n: NEWEST[n](x) for n in names if n not in slow}
            got |= {n: v[-1] for n, v in ewm.series(x["p"], x["high"], x["low"], slow).items()}
        days = tab["date"][-2:].to_pylist()
        at = {"date": days[-1] if days else None, "before": days[0] if len(days) > 1 else None}
        return pa.table({**last, **{k: pa.array([v], pa.date32()) for k, v in at.items()}, **{n: pa.array([v], pa.float64(), from_pandas=True) for n, v in got.items()}})

    return base.groupBy("symbol").applyInArrow(run, f"symbol {kind}, last_date date, close double, date date, before date, " + ", ".join(f"{n} double" for n in names))


def run(prices: DataFrame, names: list[str], start: str, end: str, lookback_days: int = 400, least_rows: int = 60, version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """The daily feature job: long rows (symbol, date, feature_name, value, version) within [start, end], and the symbols that failed for short history."""
    span = prices.where(F.col("date").between(F.date_sub(F.lit(start).cast("date"), lookback_days), F.lit(end).cast("date")))
    count = F.count("*").over(Window.partitionBy("symbol"))
    enough = span.withColumn("n", count).where(F.col("n") >= least_rows)
    failed = span.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") < least_rows)
    wide = window_features(enough, names).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return to_long(wide, names, version), failed


def to_long(wide: DataFrame, names: list[str], version: str = "v1") -> DataFrame:
    """Wide features as rows, nulls dropped."""
    flat = wide.select("symbol", "date", *[F.col(n).cast("double").alias(n) for n in names])
    return flat.unpivot(["symbol", "date"], names, "feature_name", "value").where("value is not null").withColumn("version", F.lit(version))


def to_wide(long: DataFrame, names: list[str], active: DataFrame | None = None) -> DataFrame:
    """Rows as wide features, of the active version of each feature where `active` (feature_name, version) is given; missing ones are null columns."""
    if active is not None:
        long = long.join(active.select("feature_name", "version"), ["feature_name", "version"], "left_semi")
    return long.where(F.col("feature_name").isin(names)).groupBy("symbol", "date").pivot("feature_name", names).agg(F.first("value"))
