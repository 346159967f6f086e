"""Portfolio, risk and trade analysis: metrics, limits, stops, value at risk, sizing, attribution, track records, safeguards."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import asof, scans

YEAR = 252


# --- metrics ------------------------------------------------------------------------------------------------------------------


def curve(returns: DataFrame, key: str, order: list[str], growth: Column, few_keys: bool = False) -> DataFrame:
    """Rows with i (their number), cum (the running sum of `growth`) and peak (its running maximum, 0 at least), per key.

    A window a key where keys are many; with `few_keys`, scans in blocks, as a key's rows may then be more than a task should sort.
    """
    if few_keys:
        c = scans.running(scans.blocks(returns.withColumn("__g", growth), [key], order), [key], order, cum=F.col("__g"), i=F.lit(1.0)).drop("__g")
        return scans.running(c, [key], order, {"peak": F.greatest("cum", F.lit(0.0))}).drop("block")
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    c = returns.withColumn("cum", F.sum(growth).over(w)).withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("double"))
    return c.withColumn("peak", F.greatest(F.max("cum").over(w), F.lit(0.0)))


def performance(returns: DataFrame, key: str, at: str | list[str] = "date", ret: str = "r", few_keys: bool = False) -> DataFrame:
    """Per key, the usual measures of a return series in the order of `at`: the cumulative curve, then aggregates; quantiles are exact.

    few_keys: as in curve(); quantiles then come from row numbers too.
    """
    c = curve(returns.where(F.col(ret).isNotNull()), key, [at] if isinstance(at, str) else at, F.log1p(ret), few_keys)
    tail = F.expr(f"percentile({ret}, 0.05)")
    base = c.groupBy(key).agg(
        F.count("*").alias("n"), F.exp(F.sum(F.log1p(ret))).alias("growth"), F.stddev_samp(ret).alias("sd"), F.stddev_samp(F.when(F.col(ret) < 0, F.col(ret))).alias("down_sd"), F.avg(ret).alias("mean"), F.min(F.exp(F.col("cum") - F.col("peak")) - 1).alias("max_drawdown"),
        F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(F.when(F.col(ret) > 0, F.col(ret))).alias("avg_win"), F.avg(F.when(F.col(ret) < 0, F.col(ret))).alias("avg_loss"), F.sum(F.when(F.col(ret) > 0, F.col(ret)).otherwise(0.0)).alias("gain"), F.sum(F.when(F.col(ret) < 0, -F.col(ret)).otherwise(0.0)).alias("loss"),
        *([] if few_keys else [tail.alias("q05"), F.expr(f"percentile({ret}, 0.95)").alias("q95")]), F.regr_r2("cum", "i").alias("stability"),
    )
    if few_keys:
        base = base.join(scans.quantiles(returns, [key], ret, q05=0.05, q95=0.95), key)
    low = returns.join(base.select(key, "q05"), key).where(F.col(ret) <= F.col("q05")).groupBy(key).agg(F.avg(ret).alias("cvar_5"))
    m = base.join(low, key, "left")
    cagr = F.pow("growth", F.lit(float(YEAR)) / F.col("n")) - 1
    return m.select(
        key, "n", (F.col("growth") - 1).alias("total_return"), cagr.alias("cagr"), (F.col("sd") * YEAR**0.5).alias("volatility"), (F.col("down_sd") * YEAR**0.5).alias("downside_volatility"), F.when(F.col("sd") > 1e-10, F.col("mean") / F.col("sd") * YEAR**0.5).otherwise(0.0).alias("sharpe"),
        F.when(F.col("down_sd") > 1e-10, F.col("mean") / F.col("down_sd") * YEAR**0.5).otherwise(0.0).alias("sortino"), "max_drawdown", F.try_divide(cagr, F.abs("max_drawdown")).alias("calmar"), "win_rate", "avg_win", "avg_loss", F.try_divide("gain", "loss").alias("profit_factor"), F.col("q05").alias("var_5"), "cvar_5", F.try_divide(F.abs("q95"), F.abs("q05")).alias("tail_ratio"), "stability",
    )


def relative(returns: DataFrame, benchmark: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Beta, annual alpha, tracking error and information ratio of aligned dates; null with `least` or fewer."""
    j = returns.join(benchmark, "date").where("r is not null and b is not null").withColumn("x", F.col("r") - F.col("b"))
    g = j.groupBy(key).agg(F.count("*").alias("n"), F.covar_samp("r", "b").alias("cov"), F.var_samp("b").alias("var"), F.avg("r").alias("mr"), F.avg("b").alias("mb"), F.stddev_samp("x").alias("te"), F.avg("x").alias("mx")).where(F.col("n") > least)
    beta = F.try_divide("cov", "var")
    return g.select(key, "n", beta.alias("beta"), ((F.col("mr") - beta * F.col("mb")) * YEAR).alias("alpha"), (F.col("te") * YEAR**0.5).alias("tracking_error"), F.when(F.col("te") > 1e-12, F.col("mx") / F.col("te") * YEAR**0.5).otherwise(0.0).alias("information_ratio"))


def signal_portfolio(df: DataFrame, signal: str, max_positions: int, fee: float) -> DataFrame:
    """Equal weights of yesterday's signals, fees for weight changes: return and equity per date."""
    w = Window.partitionBy("symbol").orderBy("date")
    weight = F.coalesce(F.lag(F.when(F.col(signal) > 0, 1.0 / max_positions).otherwise(0.0)).over(w), F.lit(0.0))
    h = df.withColumn("weight", weight)
    h = h.withColumn("traded", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))))
    daily = h.groupBy("date").agg((F.sum(F.col("weight") * F.coalesce("r1", F.lit(0.0))) - fee * F.sum("traded")).alias("r"))
    return daily.withColumn("equity", F.exp(F.sum(F.log1p("r")).over(Window.orderBy("date"))))  # one row a date


# --- limits -------------------------------------------------------------------------------------------------------------------


def limited(weights: DataFrame, min_value: float = 1e6, most: float = 0.05, least: float = 0.01, sector_limit: float = 0.25, unknown_limit: float = 0.10, top: int = 5, top_limit: float = 0.40, gross: float = 1.0) -> DataFrame:
    """Liquidity, position, sector, concentration and gross limits in this order. Input: date, symbol, sector, weight, value_traded.

    Each step is kept (w0 .. w5), so that `violations` can say what a limit changed.
    """
    day, ties = Window.partitionBy("date"), [F.col("symbol")]
    d = weights.withColumn("w0", F.when(F.coalesce("value_traded", F.lit(0.0)) < min_value, 0.0).otherwise(F.col("weight")))
    d = d.withColumn("w1", F.least("w0", F.lit(most)))
    d = d.withColumn("w2", F.when((F.col("w1") > 0) & (F.col("w1") < least), 0.0).otherwise(F.col("w1")))
    name = F.coalesce("sector", F.lit("Unknown"))
    exposure, limit = F.sum("w2").over(Window.partitionBy("date", name)), F.when(name == "Unknown", unknown_limit).otherwise(sector_limit)
    d = d.withColumn("w3", F.when(exposure > limit, F.col("w2") * limit / exposure).otherwise(F.col("w2")))
    d = d.withColumn("rn", F.row_number().over(day.orderBy(F.desc(F.round("w3", 12)), *ties)))
    held = F.sum(F.when(F.col("rn") <= top, F.col("w3"))).over(day)
    d = d.withColumn("w4", F.when((F.col("rn") <= top) & (held > top_limit), F.col("w3") * top_limit / held).otherwise(F.col("w3")))
    total = F.sum("w4").over(day)
    return d.withColumn("w5", F.when(total > gross, F.col("w4") * gross / total).otherwise(F.col("w4"))).drop("rn")


LIMITS = {"liquidity": ("weight", "w0"), "max_position": ("w0", "w1"), "min_position": ("w1", "w2"), "sector": ("w2", "w3"), "concentration": ("w3", "w4"), "gross": ("w4", "w5")}


def warned(weights: DataFrame, min_value: float = 1e6, most: float = 0.05, least: float = 0.01, sector_limit: float = 0.25, unknown_limit: float = 0.10, top: int = 5, top_limit: float = 0.40, gross: float = 1.0) -> DataFrame:
    """K12 in warn mode: weights stay, and each limit is held against them as they are: (date, symbol, limit, limit_value, actual).

    Position limits name a symbol; of a sector, the largest names or a whole date that exceed a limit each member gives a row with the sum.
    """
    day, name = Window.partitionBy("date"), F.coalesce("sector", F.lit("Unknown"))
    rank = F.row_number().over(day.orderBy(F.desc(F.round("weight", 12)), "symbol"))
    cap = F.when(name == "Unknown", unknown_limit).otherwise(sector_limit)
    d = weights.withColumn("__rn", rank).withColumn("__sector", F.sum("weight").over(Window.partitionBy("date", name))).withColumn("__gross", F.sum("weight").over(day))
    d = d.withColumn("__top", F.sum(F.when(F.col("__rn") <= top, F.col("weight"))).over(day))
    checks = {
        "liquidity": (F.lit(min_value), F.coalesce("value_traded", F.lit(0.0)), (F.coalesce("value_traded", F.lit(0.0)) < min_value) & (F.col("weight") != 0)),
        "max_position": (F.lit(most), F.col("weight"), F.col("weight") > most),
        "min_position": (F.lit(least), F.col("weight"), (F.col("weight") > 0) & (F.col("weight") < least)),
        "sector": (cap, F.col("__sector"), F.col("__sector") > cap),
        "concentration": (F.lit(top_limit), F.col("__top"), (F.col("__rn") <= top) & (F.col("__top") > top_limit)),
        "gross": (F.lit(gross), F.col("__gross"), F.col("__gross") > gross),
    }
    each = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(k).alias("limit"), limit.cast("double").alias("limit_value"), actual.cast("double").alias("actual"))) for k, (limit, actual, broken) in checks.items()]))
    return d.select("date", "symbol", F.explode(each).alias("v")).select("date", "symbol", "v.*")


def violations(limited_: DataFrame) -> DataFrame:
    """One row for each weight that a limit changed."""
    each = F.array(*[F.struct(F.lit(k).alias("limit"), F.col(a).alias("before"), F.col(b).alias("after")) for k, (a, b) in LIMITS.items()])
    return limited_.select("date", "symbol", F.explode(each).alias("v")).select("date", "symbol", "v.*").where(F.abs(F.col("before") - F.col("after")) > 1e-9)


def impact_cost(shares: Column, price: Column, adv: Column, sigma: Column, per_share: float = 0.005, least: float = 1.0, cap: float = 0.005, spread_bps: float = 5.0, eta: float = 0.1) -> Column:
    """Commission with floor and cap, spread, and a square-root impact; without volume the impact is that of a whole day's volume, at most 5 % of the value."""
    value = shares * price
    fee = F.greatest(F.lit(least), F.least(shares * per_share, value * cap))
    impact = F.when(adv > 0, eta * sigma * F.sqrt(shares / adv) * value).otherwise(F.least(0.05 * value, eta * sigma * value))
    return fee + value * spread_bps / 1e4 + impact


# --- helpers that keep state ----------------------------------------------------------------------------------------------------


STOPS = ("atr_trailing", "fixed_pct", "volatility_scaled")


def stop_level(kind: str, multiple: float = 2.0, pct: float = 0.05, width: float = 2.0) -> Column:
    """A bar's stop below its close: by the average true range (column atr), by a share, or by `width` times the daily volatility of 20 days (column vol20)."""
    return {"atr_trailing": F.col("close") - multiple * F.col("atr"), "fixed_pct": F.col("close") * (1 - pct), "volatility_scaled": F.col("close") * (1 - width * F.col("vol20"))}[kind]


def stop_scan(df: DataFrame, level: str = "stop_level", by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every bar (by, date, low, signal, level) with trade (number of the position, by series), is_entry, is_exit and signal_after, the signal with stopped bars at 0.

    A position opens on a bar whose signal is on while none is open, and is not checked on that bar. On later bars it is stopped where the low is at or
    below the stop, and ends where the signal is off; after a stop the next bar with the signal on opens another. So within bars of one signal, of
    neighbouring bars at their stop every other one is an exit: the state is a count of rows, and windows find it without a loop over bars.
    """
    w = Window.partitionBy(*by).orderBy("date")
    on, before = F.col("signal") > 0, F.coalesce(F.lag(F.col("signal") > 0).over(w), F.lit(False))
    d = df.withColumn("__on", F.coalesce(on, F.lit(False))).withColumn("__was", before).withColumn("__i", F.row_number().over(w))
    start = F.col("__on") & ~F.col("__was")
    hit = (F.col("__on") | F.col("__was")) & ~start & F.coalesce(F.col("low") <= F.col(level), F.lit(False))
    d = d.withColumn("__start", start).withColumn("__hit", hit)
    d = d.withColumn("__free", F.coalesce(F.max(F.when(~F.col("__hit"), F.col("__i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    d = d.withColumn("is_exit", F.col("__hit") & ((F.col("__i") - F.col("__free")) % 2 == 1))
    d = d.withColumn("is_entry", F.col("__start") | (F.col("__on") & F.coalesce(F.lag("is_exit").over(w), F.lit(False))))
    d = d.withColumn("trade", F.sum(F.col("is_entry").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("signal_after", F.when(F.col("is_exit"), 0.0).otherwise(F.col("signal").cast("double"))).drop("__on", "__was", "__i", "__start", "__hit", "__free")


def stop_exits(scanned: DataFrame, level: str = "stop_level", by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The stop events of `stop_scan`: (by, entry_date, exit_date, entry_price, exit_price, stop_level, trailing_high, pnl). Prices are the lows that are checked."""
    w = Window.partitionBy(*by, "trade").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    e = scanned.withColumn("entry_date", F.first("date").over(w)).withColumn("entry_price", F.first("low").over(w)).withColumn("trailing_high", F.max("low").over(w)).where("is_exit")
    return e.select(*by, "entry_date", F.col("date").alias("exit_date"), "entry_price", F.col("low").alias("exit_price"), F.col(level).alias("stop_level"), "trailing_high", (F.try_divide("low", "entry_price") - 1).alias("pnl"))


def stop_statistics(scanned: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per series, stops, positions, their ratio, mean and summed result of stops, and mean holding time in calendar days; zeroes without a stop."""
    w = Window.partitionBy(*by, "trade").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    e = scanned.withColumn("__date", F.first("date").over(w)).withColumn("__pnl", F.try_divide("low", F.first("low").over(w)) - 1)
    at = lambda c: F.when(F.col("is_exit"), c)
    one = e.groupBy(*by).agg(F.count_if("is_entry").alias("n_trades"), F.count_if("is_exit").alias("n_stops"), F.avg(at(F.col("__pnl"))).alias("mean_pnl"), F.sum(at(F.col("__pnl"))).alias("sum_pnl"), F.avg(at(F.date_diff("date", "__date"))).alias("mean_days"))
    return one.fillna(0, ["n_stops", "mean_pnl", "sum_pnl", "mean_days"]).withColumn("stop_rate", F.coalesce(F.try_divide("n_stops", "n_trades"), F.lit(0.0)))


def _hashed(seed: np.ndarray, value: int | np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int column on top of earlier columns' hash."""
    with np.errstate(over="ignore"):
        h = seed + np.uint64(0x27D4EB2F165667C5) + np.uint64(4)
        h = h ^ (np.asarray(value).astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B185EBCA87)
        h = (h << np.uint64(23) | h >> np.uint64(41)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
        h = (h ^ h >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
        return h ^ h >> np.uint64(32)


def simulated_var(returns: DataFrame, key: str, draws: int = 10_000, level: float = 0.95, days: int = 1, heavy: bool = False) -> DataFrame:
    """Value at risk and shortfall of simulated losses over `days`, fitted per group; normal, or `heavy`: Student's t fitted by its fourth moment.

    The fit is one aggregation, a row a group; a group's draws are one array while its row is at hand, never rows, and nothing is shuffled after the fit. Draws
    are hashes of group and number (xxhash64), so reruns agree and any executor can make them again. t draws are a normal over the root of a mean of squared
    normals.
    """
    fit = returns.groupBy(key).agg(F.avg("r").alias("__mu"), F.stddev_samp("r").alias("__sigma"), F.kurtosis("r").alias("__k"), F.count("r").alias("__n")).where("__n >= 30")
    # t with f degrees of freedom has excess kurtosis 6 / (f - 4)
    freedom = F.when(F.lit(heavy) & (F.col("__k") > 0.05), F.least(F.lit(30), F.greatest(F.lit(5), F.round(4 + 6 / F.col("__k")).cast("int"))))
    rows = fit.select(F.col(key).alias("k"), "__mu", "__sigma", freedom.alias("f"), F.xxhash64(key).alias("h"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        number = np.arange(1, draws + 1)
        for b in batches:
            var, cvar = np.empty(b.num_rows), np.empty(b.num_rows)
            for at, (mu, sigma, f, h) in enumerate(zip(*(b.column(c).to_pylist() for c in ("__mu", "__sigma", "f", "h")), strict=True)):
                own = _hashed(np.full(draws, h, np.int64).view(np.uint64), number)
                uniform = lambda seed, salt: ((_hashed(seed, salt) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
                normal = lambda seed: np.sqrt(-2 * np.log(uniform(seed, 1))) * np.cos(2 * math.pi * uniform(seed, 2))
                wide = np.zeros(draws)
                for j in range(1, (f or 0) + 1):
                    wide += normal(_hashed(_hashed(own, -1), j)) ** 2
                scale = np.sqrt((f - 2) / wide) if f else 1.0
                loss = -sum((mu + sigma * normal(_hashed(own, day)) * scale for day in range(days)), np.zeros(draws))
                loss.sort()
                place = (draws - 1) * level
                low, high = math.floor(place), math.ceil(place)
                var[at] = loss[low] if low == high else (high - place) * loss[low] + (place - low) * loss[high]
                cvar[at] = loss[loss >= var[at]].mean()
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(var), pa.array(cvar)], names=["k", "var", "cvar"])

    return rows.mapInArrow(run, f"k {kind}, var double, cvar double").withColumnRenamed("k", key)


def bootstrap(returns: DataFrame, key: str, resamples: int = 200, level: float = 0.95) -> DataFrame:
    """Percentile intervals of annual mean, Sharpe ratio and deviation by Poisson weights: replicates are partial sums, so groups are never gathered.

    A row's weight in a replicate is a Poisson(1) draw by a hash of the row and the replicate, so reruns agree. Rows aren't multiplied: each batch of rows
    gives its keys' sums for all replicates at once, as arrays, and only these are shuffled.
    """
    cdf = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    rows = returns.where("r is not null").select(F.col(key).alias("k"), F.col("r").cast("double").alias("r"), F.xxhash64(key, "date", "r").alias("h"))
    salt = (np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]

    def partial(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                t = b.slice(at, 4096)
                codes = t.column("k").dictionary_encode()
                code, r_ = np.asarray(codes.indices.fill_null(len(codes.dictionary))), np.asarray(t.column("r"))
                x = np.asarray(t.column("h")).view(np.uint64)[:, None] ^ salt
                for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
                w = np.searchsorted(cdf, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right").astype(float)
                names, place = np.unique(code, return_inverse=True)
                sums = []
                for v in (np.ones(len(r_)), r_, r_ * r_):
                    s_ = np.zeros((len(names), resamples))
                    np.add.at(s_, place, w * v[:, None])
                    sums.append(pa.array(list(s_), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(names, mask=names == len(codes.dictionary))), *sums], names=["k", "n", "s", "q"])

    kind = rows.schema["k"].dataType.simpleString()
    each = rows.mapInArrow(partial, f"k {kind}, n array<double>, s array<double>, q array<double>")
    sums = each.select(F.col("k").alias(key), F.posexplode(F.arrays_zip("n", "s", "q")).alias("replicate", "x")).groupBy(key, "replicate").agg(*[F.sum(F.col("x")[c]).alias(c) for c in ("n", "s", "q")])
    sd = F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1))
    each = sums.where("n > 1").select(key, (F.col("s") / F.col("n") * YEAR).alias("mean"), (sd * YEAR**0.5).alias("std"), F.when(sd > 0, F.col("s") / F.col("n") / sd * YEAR**0.5).otherwise(0.0).alias("sharpe"))
    low, high = (1 - level) / 2, (1 + level) / 2
    return each.groupBy(key).agg(*[F.expr(f"percentile({c}, {q})").alias(f"{c}_{side}") for c in ("mean", "sharpe", "std") for side, q in (("low", low), ("high", high))])


def student_tail(t: Column, freedom: Column) -> Column:
    """Upper tail of Student's t for whole degrees of freedom, by its finite series in the angle atan(t / sqrt(freedom)); all in columns."""
    angle, even = F.atan(t / F.sqrt(freedom)), freedom % 2 == 0
    # even: sin * (1 + 1/2 cos^2 + 1*3/(2*4) cos^4 ...), odd: 2/pi * (angle + sin * (cos + 2/3 cos^3 + ...)), each with floor(freedom / 2) terms
    terms = F.floor(freedom / 2).cast("int")
    first = F.when(even, 1.0).otherwise(F.cos(angle))
    step = F.struct(F.lit(0.0).alias("total"), first.cast("double").alias("term"))
    odd = F.when(even, 0.0).otherwise(1.0)
    series = F.aggregate(
        F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), step,
        lambda a, k: F.struct((a["total"] + a["term"]).alias("total"), (a["term"] * F.pow(F.cos(angle), 2) * (2 * k - 1 + odd) / (2 * k + odd)).alias("term")),
    )["total"]
    within = F.when(even, F.sin(angle) * series).otherwise(2 / math.pi * (angle + F.sin(angle) * series))
    return 0.5 - within / 2


def significance(stats: DataFrame, trials: int) -> DataFrame:
    """Of (mean, sd, n) per key: Sharpe with its error and t, the Sharpe to expect of the best of `trials`, and the p of a positive mean."""
    s = F.col("mean") / F.col("sd")
    se = F.sqrt((1 + s * s / 2) / F.col("n"))
    best = NormalDist().inv_cdf(1 - 1 / trials)
    d = stats.where("sd > 0 and n > 2").withColumn("sharpe", s).withColumn("se", se).withColumn("t", s * F.sqrt("n"))
    return d.withColumn("expected_best", F.col("se") * best).withColumn("deflated", F.col("sharpe") > F.col("se") * best).withColumn("p_value", student_tail(F.col("t"), F.col("n") - 1))


class _Tile(NamedTuple):
    """Series of some names as matrices of names x days: the values (shifted by each name's mean), their squares, which days a name has; names whose values
    aren't all finite; and, of the values as they are, the day and where a name's begin."""

    x: np.ndarray
    xx: np.ndarray
    m: np.ndarray
    held: np.ndarray
    odd: np.ndarray
    value: np.ndarray
    day: np.ndarray
    start: np.ndarray

    def plain(self, k: int) -> np.ndarray:
        v, at = np.zeros(self.x.shape[1]), slice(self.start[k], self.start[k + 1])
        v[self.day[at]] = self.value[at]
        return v


def _tile(tab: pa.Table, days: np.ndarray) -> _Tile:
    """Rows (symbol, dates, r) as matrices over the sorted `days`; other days are left out."""
    lengths = np.asarray(pc.list_value_length(tab["dates"].combine_chunks()))
    date, value = tab["dates"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.asarray(tab["r"].combine_chunks().flatten())
    at, row = np.searchsorted(days, date), np.repeat(np.arange(len(lengths)), lengths)
    known = at < len(days)
    known[known] = days[at[known]] == date[known]
    at, row, value = at[known], row[known], value[known]
    odd = np.bincount(row, ~np.isfinite(value), len(lengths)) > 0
    with np.errstate(invalid="ignore"):
        mean = np.bincount(row, value, len(lengths)) / np.maximum(np.bincount(row, minlength=len(lengths)), 1)
        v = np.where(odd[row], 0.0, value - mean[row])  # a shift of a name's values changes neither result
    x, xx, m = (np.zeros((len(lengths), len(days))) for _ in range(3))
    x[row, at], xx[row, at], m[row, at] = v, v * v, 1
    return _Tile(x, xx, m, m.astype(np.float32), odd, value, at, np.searchsorted(row, np.arange(len(lengths) + 1)))


def _correlated(one: _Tile, u: np.ndarray, two: _Tile, w: np.ndarray | None = None, take: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, corr, cov) of the names u of a tile with those of another, on the days that both have, weighed by w. Sums over common days are matrix products of
    values with a mask; where they cancel, as with values that hardly vary, a pair (of those to take) is told from its own values."""
    n = one.held[u] @ two.held.T
    m, x, xx = (v[u] if w is None else v[u] * w for v in (one.m, one.x, one.xx))
    ww = n.astype(float) if w is None else m @ two.m.T
    sx, sy, sxy, sxx, syy = x @ two.m.T, m @ two.x.T, x @ two.x.T, xx @ two.m.T, m @ two.xx.T
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy, vxy = sxx - sx * sx / ww, syy - sy * sy / ww, sxy - sx * sy / ww
        free = ww - 1 if w is None else ww - (m * w) @ two.m.T / ww
        close = (vx <= 1e-7 * sxx) | (vy <= 1e-7 * syy) | one.odd[u][:, None] | two.odd[None, :]
        corr, cov = vxy / np.sqrt(vx * vy), np.where(n > 1, vxy / free, np.nan)
    for i, j in zip(*np.nonzero(close & (n > 0) & take), strict=True):
        both = (one.held[u[i]] > 0) & (two.held[j] > 0)
        c, p, q = np.ones(both.sum()) if w is None else w[both], one.plain(u[i])[both], two.plain(j)[both]
        p, q = (v - (c * v).sum() / c.sum() if v.min() < v.max() or not np.isfinite(v).all() else np.zeros(len(v)) for v in (p, q))
        size = np.sqrt((c * p * p).sum() * (c * q * q).sum())
        corr[i, j] = (c * p * q).sum() / size if size != 0 else np.nan
        cov[i, j] = (c * p * q).sum() / free[i, j] if n[i, j] > 1 else np.nan
    return n, corr, cov


def _series(returns: DataFrame, most: int) -> tuple[DataFrame, pa.Table]:
    """Rows (symbol, dates, r), one a name, in files of `most` names at most, and the calendar (date, names), a row a date. Returns that are partitioned by
    symbol stay where they are."""
    x = returns.where("symbol is not null and date is not null and r is not null").groupBy("symbol").agg(F.collect_list(F.struct("date", F.col("r").cast("double").alias("r"))).alias("s"))
    x = written(x.select("symbol", F.col("s.date").alias("dates"), F.col("s.r").alias("r")), "series", maxRecordsPerFile=most)
    return x, x.select(F.explode("dates").alias("date")).groupBy("date").agg(F.count("*").alias("names")).toArrow().sort_by("date")


def _rows(files: list[str]) -> pa.Table:
    """Rows of files of a written table, read in a task."""
    return pa.concat_tables(pq.read_table(path, filesystem=system, partitioning=None) for system, path in map(fs.FileSystem.from_uri, files))


def correlations(returns: DataFrame, halflife: float | None = None, complete: bool = False, size: int = 1024) -> DataFrame:
    """(a, b, n, corr, cov) of all pairs of names with a common day, a < b, over the days that both have; a row a name and day. Null where undefined.

    The result has a row a pair, so the work grows with the square of the names; disk does not. A name's series is one row, written once, and tiles are files
    of some `size` names at most. Only numbers of tiles are shuffled: each two tiles are read in one task, which multiplies matrices of names x days. A task
    is bounded by tile and calendar, and gives its pairs in batches. `complete` keeps days that every name has; `halflife` weighs days by age in sessions,
    as a debiased exponential covariance.
    """
    series, days = _series(returns, max(1, size // 4))
    files = sorted((f, n) for f, n in series.groupBy(F.input_file_name()).count().collect())  # a row a file
    names = sum(n for _, n in files)
    if complete:
        days = days.filter(pc.equal(days["names"], names))
    days = days["date"].to_numpy()
    w = None if halflife is None else np.power(0.5, np.arange(len(days))[::-1] / halflife)
    most, tiles, within = -(-names // max(1, -(-names // size), min(12, names // 64))), [], 0
    for f, n in files:
        if not tiles or within + n > most:
            tiles, within = [*tiles, []], 0
        tiles[-1].append(f)
        within += n
    kind = series.schema["symbol"].dataType.simpleString()

    last = {}  # a task's pairs come in order: most have the first tile of the pair before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(k):
            tab = _rows(tiles[k])
            return tab["symbol"], _tile(tab, days)

        for i, j in ((i, j) for b in batches for i, j in zip(b.column("i").to_pylist(), b.column("j").to_pylist(), strict=True)):
            if i not in last:
                last.clear()
                last[i] = read(i)
            (names_, one), (others, two) = last[i], last[i] if i == j else read(j)
            name = pa.chunked_array([*names_.chunks, *(others.chunks if i != j else [])]).combine_chunks()
            order = np.asarray(pc.sort_indices(name))
            name, place = name.take(pa.array(order)), np.argsort(order)
            first, second = place[: len(one.x)], place[-len(two.x) :]
            for at in range(0, len(first), 256):
                u = np.arange(at, min(at + 256, len(first)))
                p, q = np.broadcast_arrays(first[u][:, None], second[None, :])
                take = p < q if i == j else np.full(p.shape, True)
                n, corr, cov = _correlated(one, u, two, w, take)
                take &= n > 0
                a, b = np.minimum(p, q)[take], np.maximum(p, q)[take]
                own = [name.take(pa.array(a)), name.take(pa.array(b)), pa.array(n[take].astype(np.int64)), *(pa.array(v[take], pa.float64(), from_pandas=True) for v in (corr, cov))]
                yield pa.RecordBatch.from_arrays(own, names=["a", "b", "n", "corr", "cov"])

    count, spark = max(1, len(tiles)), series.sparkSession
    pairs = spark.range(len(tiles) ** 2).select(F.expr(f"id div {count}").alias("i"), F.expr(f"id % {count}").alias("j")).where("i <= j")
    most = count * (count + 1) // 2
    dealt = pairs.repartitionByRange(min(most, max(4 * spark.sparkContext.defaultParallelism, most // 8)), "i", "j")  # so many tasks, however few bytes the numbers have
    return dealt.groupBy("i", "j").applyInArrow(run, f"a {kind}, b {kind}, n bigint, corr double, cov double")


def drop_correlated(signals: DataFrame, edges: DataFrame, limit: float = 0.7) -> DataFrame:
    """Names (symbol, strength, ...) without a stronger one they correlate with beyond the limit, chosen greedily from the strongest.

    Rounds instead of a loop over names: open names without a stronger open neighbour stay, and their weaker neighbours go. Each round's tables hold what is
    still open between open names, so they shrink. The strongest open name is always decided, and mostly whole layers are.
    """
    rank = signals.select("symbol", "strength")
    mine, other = rank.select(F.col("symbol").alias("a"), F.col("strength").alias("s")), rank.select(F.col("symbol").alias("b"), F.col("strength").alias("bs"))
    first = F.expr("bs > s or (bs = s and b < a)")
    close = edges.where(F.abs("corr") > limit).select("a", "b").where("a <> b").join(mine, "a").join(other, "b")
    stronger = written(close.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b")), "stronger")
    left, kept = written(rank.select("symbol"), "open"), None
    while not left.isEmpty():
        stays = written(left.join(stronger, left["symbol"] == stronger["a"], "left_anti"), "stays")
        kept = stays if kept is None else kept.union(stays)
        goes = written(stronger.join(stays, stronger["b"] == stays["symbol"], "left_semi").select(F.col("a").alias("symbol")).distinct(), "goes")
        left = written(left.join(stays.union(goes), "symbol", "left_anti"), "open")
        stronger = written(stronger.join(goes, stronger["a"] == goes["symbol"], "left_anti").join(goes, stronger["b"] == goes["symbol"], "left_anti"), "stronger")
    return signals.limit(0) if kept is None else signals.join(kept, "symbol", "left_semi")


def _apart(tab: pa.Table, strong: pa.Table, days: np.ndarray, limit: float) -> np.ndarray:
    """Row numbers of the names of `tab` that correlate beyond the limit with none of `strong`; some hundred names of either are matrices at a time."""
    out = []
    for at in range(0, tab.num_rows, 512):
        one = _tile(tab.slice(at, 512), days)
        u = np.arange(len(one.x))
        for k in range(0, strong.num_rows, 256):
            if len(u):
                u = u[~(np.abs(_correlated(one, u, _tile(strong.slice(k, 256), days))[1]) > limit).any(axis=1)]
        out.append(at + u)
    return np.concatenate([np.zeros(0, np.int64), *out])


def uncorrelated(signals: DataFrame, returns: DataFrame, limit: float = 0.7, batch: int = 8192) -> DataFrame:
    """As drop_correlated with the correlations of `returns`, without a row a pair, and without most pairs: only names that stay are compared with others.

    The strongest `batch` open names are settled in one task, then all weaker ones are compared with those of them that stay, and the near ones go, until none
    is open. Where many names correlate, few stay and few rounds settle all; where none do, all pairs are compared in names / batch rounds. Disk is linear:
    a round writes names, and the series of its stays; the other series are written again only where half of them are settled.
    """
    series, days = _series(returns, batch)
    days = days["date"].to_numpy()
    names = written(signals.select("symbol", "strength"), "names")
    kept = names.join(series.select("symbol"), "symbol", "left_anti").select("symbol")
    left = written(names.join(series.select("symbol"), "symbol", "left_semi"), "open")
    n, rows, kind = left.count(), series.count(), "symbol {}, dates {}, r array<double>".format(*(series.schema[c].dataType.simpleString() for c in ("symbol", "dates")))

    def settle(tab: pa.Table) -> pa.Table:
        tab, stays = tab.sort_by("k").select(["symbol", "dates", "r"]), []
        while tab.num_rows:
            first = _tile(tab.slice(0, 256), days)
            near = np.abs(_correlated(first, np.arange(len(first.x)), first)[1]) > limit
            own = np.ones(len(near), bool)
            for k in range(len(near)):
                own[k + 1 :] &= ~(own[k] & near[k, k + 1 :])
            stays.append(tab.slice(0, 256).take(pa.array(np.flatnonzero(own))))
            tab = tab.slice(256)
            tab = tab.take(pa.array(_apart(tab, stays[-1], days, limit)))
        return pa.concat_tables(stays)

    while n:
        if 2 * n <= rows:
            series, rows = written(series.join(left, "symbol", "left_semi"), "series"), n
        head = written(left.orderBy(F.desc("strength"), "symbol").limit(batch).withColumn("k", F.row_number().over(Window.orderBy(F.desc("strength"), "symbol"))), "head")  # a batch
        stays = written(series.join(F.broadcast(head), "symbol").groupBy(F.lit("batch")).applyInArrow(settle, kind), "stays")
        kept, left = kept.union(stays.select("symbol")), left.join(head, "symbol", "left_anti")
        files = list(stays.inputFiles())

        def near(batches, files=files):
            strong = _rows(files)
            for b in batches:
                gone = np.ones(b.num_rows, bool)
                gone[_apart(pa.Table.from_batches([b]), strong, days, limit)] = False
                yield pa.RecordBatch.from_arrays([b.column("symbol").filter(pa.array(gone))], names=["symbol"])

        if n > batch:
            left = left.join(written(series.mapInArrow(near, kind.split(",")[0]), "near"), "symbol", "left_anti")
        left = written(left, "open")
        n = left.count()
    return signals.join(kept, "symbol", "left_semi")


def top_of_sector(signals: DataFrame, positions: int = 20, share: float = 0.3) -> DataFrame:
    """Of each sector (null is one of its own) the max(1, positions x share) strongest names."""
    w = Window.partitionBy(F.coalesce("sector", F.lit("Unknown"))).orderBy(F.desc("strength"), "symbol")
    return signals.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max(1, int(positions * share))).drop("__rn")


def inverse_volatility(names: DataFrame, old: DataFrame, most: float = 0.10, turnover: float = 0.2, dust: float = 0.001) -> DataFrame:
    """(symbol, raw, capped, turnover, weight) of names (symbol, signal, sd) against the old weights (symbol, old), one batch of names at a time.

    |signal| / sd, normalised; capped once, the excess shared among the rest up to the cap; then blended with the old weights so that the one-way
    turnover meets its limit (turnover is linear in the blend, so the factor is limit / turnover); what is left below `dust` goes, the rest sums to 1.
    """
    batch = Window.partitionBy(F.lit(1))  # a portfolio's names
    x = names.withColumn("__x", F.abs("signal") * F.when(F.col("sd") > 0, 1 / F.col("sd")).otherwise(1.0))
    total = F.sum("__x").over(batch)
    x = x.withColumn("raw", F.when(total > 0, F.col("__x") / total).otherwise(1.0 / F.count("*").over(batch)))
    x = x.withColumn("__c", F.least("raw", F.lit(most)))
    free = F.sum(F.when(F.col("__c") < most, F.col("__c"))).over(batch)
    x = x.withColumn("__c", F.when(F.col("__c") < most, F.least(F.col("__c") + F.sum(F.col("raw") - F.col("__c")).over(batch) * F.col("__c") / free, F.lit(most))).otherwise(F.col("__c")))
    x = x.withColumn("capped", F.col("__c") / F.sum("__c").over(batch))
    both = x.select("symbol", "raw", "capped").join(old.select("symbol", "old"), "symbol", "full_outer").fillna(0.0, ["raw", "capped", "old"])
    both = both.withColumn("turnover", 0.5 * F.sum(F.abs(F.col("capped") - F.col("old"))).over(batch))
    blend = F.when(F.col("turnover") > turnover, turnover / F.col("turnover")).otherwise(1.0)
    both = both.withColumn("__w", blend * F.col("capped") + (1 - blend) * F.col("old")).withColumn("__w", F.when(F.col("__w") > dust, F.col("__w")).otherwise(0.0))
    return both.select("symbol", "raw", "capped", "turnover", F.try_divide("__w", F.sum("__w").over(batch)).alias("weight"))


def solved(df: DataFrame, matrix: list[list[Column]], right: list[Column], names: list[str]) -> DataFrame:
    """df with the solution of a small symmetric positive system for each row, by elimination in columns; null where it is singular."""
    n = len(right)
    cell = lambda i, j: f"__cell{i}_{j}"
    d = df.select("*", *[matrix[i][j].alias(cell(i, j)) for i in range(n) for j in range(n)], *[right[i].alias(cell(i, n)) for i in range(n)])
    for k in range(n):
        rows = [i for i in range(n) if i != k]
        keep = [c for c in d.columns if not c.startswith("__cell")]
        pivot = [F.try_divide(F.col(cell(k, j)), F.col(cell(k, k))) for j in range(n + 1)]
        d = d.select(*keep, *[pivot[j].alias(cell(k, j)) for j in range(n + 1)], *[(F.col(cell(i, j)) - F.col(cell(i, k)) * pivot[j]).alias(cell(i, j)) for i in rows for j in range(n + 1)])
    keep = [c for c in d.columns if not c.startswith("__cell")]
    return d.select(*keep, *[F.col(cell(i, n)).alias(name) for i, name in enumerate(names)])


def factor_attribution(j: DataFrame, y: str, factors: list[str], key: str) -> DataFrame:
    """Per key, the exposure to each factor, its contribution (exposure x mean factor), alpha as the rest of the mean, and R2.

    One factor: least squares with intercept. Several: without, from sums of cross-products that one aggregation gives, solved in columns.
    """
    j = j.where(" and ".join(f"{c} is not null" for c in (y, *factors)))
    if len(factors) == 1:
        f = factors[0]
        g = j.groupBy(key).agg(F.count("*").alias("n"), F.avg(y).alias("__y"), F.avg(f).alias(f"__mean_{f}"), F.regr_slope(y, f).alias(f"beta_{f}"), F.regr_r2(y, f).alias("r2"))
    else:
        m = len(factors)
        aggs = [F.count("*").alias("n"), F.avg(y).alias("__y"), F.var_pop(y).alias("__var"), F.sum(F.col(y) * F.col(y)).alias("__yy")]
        aggs += [F.avg(f).alias(f"__mean_{f}") for f in factors] + [F.sum(F.col(f) * F.col(y)).alias(f"__b{i}") for i, f in enumerate(factors)]
        aggs += [F.sum(F.col(factors[a]) * F.col(factors[b])).alias(f"__a{a}_{b}") for a in range(m) for b in range(a, m)]
        at = lambda a, b: F.col(f"__a{min(a, b)}_{max(a, b)}")
        g = solved(j.groupBy(key).agg(*aggs), [[at(a, b) for b in range(m)] for a in range(m)], [F.col(f"__b{i}") for i in range(m)], [f"beta_{f}" for f in factors])
        rest = F.col("__yy") - sum((F.col(f"beta_{f}") * F.col(f"__b{i}") for i, f in enumerate(factors)), F.lit(0.0))
        g = g.withColumn("r2", 1 - F.try_divide(rest, F.col("__var") * F.col("n")))
    parts = [(F.col(f"beta_{f}") * F.col(f"__mean_{f}")).alias(f"contribution_{f}") for f in factors]
    alpha = F.col("__y") - sum((F.col(f"beta_{f}") * F.col(f"__mean_{f}") for f in factors), F.lit(0.0))
    return g.select(key, "n", *[f"beta_{f}" for f in factors], *parts, alpha.alias("alpha"), "r2")


def historical_var(returns: DataFrame, key: str, level: float = 0.95, days: int = 1) -> DataFrame:
    """(key, n, var, cvar): quantile of losses over overlapping sums of `days` returns, and the mean of losses from there on; null keys are one key.

    Keys of fewer than 30 sums are left out.
    """
    w = Window.partitionBy(key).orderBy("date")
    x = returns.where("r is not null").select(key, "date", "r")
    if days > 1:
        frame = w.rowsBetween(-(days - 1), 0)
        x = x.select(key, "date", F.sum("r").over(frame).alias("r"), F.count("*").over(frame).alias("__n")).where(F.col("__n") == days)
    x = x.select(F.col(key).alias("__k"), (-F.col("r")).alias("loss"))
    q = x.groupBy("__k").agg(F.expr(f"percentile(loss, {level})").alias("v"), F.count("*").alias("n")).where(f"n >= {30 + (1 if days > 1 else 0)}")
    tail = x.join(q.withColumnRenamed("__k", "__q"), F.col("__k").eqNullSafe(F.col("__q"))).where("loss >= v")
    return tail.groupBy(F.col("__k").alias(key)).agg(F.first("n").alias("n"), F.first("v").alias("var"), F.avg("loss").alias("cvar"))


def tail_risk(returns: DataFrame, key: str, least: int = 20) -> DataFrame:
    """Per key, quantiles and shortfalls at 5 and 1 %, population skewness and kurtosis, worst day, share of positive days; all null below `least` days."""
    x = returns.where("r is not null").select(key, "r")
    g = x.groupBy(key).agg(F.count("*").alias("n"), F.expr("percentile(r, 0.05)").alias("q5"), F.expr("percentile(r, 0.01)").alias("q1"), F.skewness("r").alias("skewness"), F.kurtosis("r").alias("kurtosis"), F.min("r").alias("worst"), (100 * F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0))).alias("positive_pct"))
    low = x.join(g.select(key, "q5", "q1"), key).where("r <= q5").groupBy(key).agg(F.avg("r").alias("c5"), F.avg(F.when(F.col("r") <= F.col("q1"), F.col("r"))).alias("c1"))
    d = g.join(low, key, "left").withColumnsRenamed({"q5": "var_95", "q1": "var_99", "c5": "cvar_95", "c1": "cvar_99"})
    return d.select(key, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("var_95", "cvar_95", "var_99", "cvar_99", "skewness", "kurtosis", "worst", "positive_pct")])


#: Fixed thresholds: name of the measure -> (bound, whether it is the least allowed).
CRITERIA = {"sharpe": (0.5, True), "trades": (100, True), "max_drawdown": (0.25, False), "win_rate": (0.40, True), "profit_factor": (1.2, True), "oos_days": (730, True), "var": (0.05, False), "cvar": (0.08, False)}


def validated(m: DataFrame) -> DataFrame:
    """M (the measures of CRITERIA; var and cvar as losses of any sign) with the failed criteria in order, passed, and a confidence of 0 to 1.

    A missing measure fails as the worst value would, but var and cvar, which are then not held against anything. Confidence is the mean of what there is of
    Sharpe and trades against twice their least, and of the room below the bounds of var and cvar.
    """
    failed = []
    for name, (bound, at_least) in CRITERIA.items():
        v = F.abs(F.col(name)) if name in ("var", "cvar") else F.coalesce(F.col(name), F.lit(0.0 if at_least else 1.0))
        failed.append(F.when(v < bound if at_least else v > bound, name))
    most = lambda c, name: F.when(c != 0, F.least(F.lit(1.0), c / (2 * CRITERIA[name][0])))
    room = lambda name: F.when(F.col(name) != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(F.col(name)) / CRITERIA[name][0])))
    parts = F.array_compact(F.array(most(F.col("sharpe"), "sharpe"), most(F.col("trades").cast("double"), "trades"), room("var"), room("cvar")))
    score = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(0.0)
    d = m.withColumn("failed", F.array_compact(F.array(*failed)))
    return d.withColumn("passed", F.size("failed") == 0).withColumn("confidence", score)


def piecewise(x: Column, bad: float, target: float, good: float) -> Column:
    """0 at bad or beyond, a half at the target, 1 at good or beyond, straight between; good may lie below bad. Null is 0. NaN counts as above every number."""
    sign = 1 if good > bad else -1
    v = F.when(F.isnan(x), float("inf")).otherwise(x) * sign
    b, t, g = bad * sign, target * sign, good * sign
    return F.coalesce(F.when(v <= b, 0.0).when(v >= g, 1.0).when(v <= t, 0.5 * (v - b) / (t - b)).otherwise(0.5 + 0.5 * (v - t) / (g - t)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE has it: infinite or NaN where b is 0, which Spark's own division refuses. Null stays null."""
    over = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, over).otherwise(F.try_divide(a, b))


def correlation(x: str, y: str) -> Column:
    """An aggregate: Pearson's correlation of the pairs, NaN where it is undefined (one pair, a constant side; corr() fails on these), null without a pair."""
    return ratio(F.covar_pop(x, y), F.sqrt(F.regr_sxx(y, x) / F.regr_count(y, x) * (F.regr_syy(y, x) / F.regr_count(y, x))))


def decisions(dimensions: list[str], critical: Column) -> tuple[Column, Column]:
    """The mean of the dimensions' scores, and what follows: PIVOT on a critical failure, else CONTINUE from 0.75, CONDITIONAL from 0.5, KILL."""
    score = sum((F.col(c) for c in dimensions), F.lit(0.0)) / len(dimensions)
    kept = F.round(score + 1.7e-8, 6)
    return score, F.when(critical, "PIVOT").when(kept >= 0.75, "CONTINUE").when(kept >= 0.5, "CONDITIONAL").otherwise("KILL")


def gate_calibration(kills: DataFrame, passes: DataFrame, updates: DataFrame, statuses: DataFrame, outcomes: DataFrame, loss: float = -0.02) -> DataFrame:
    """(side, reason, n, share, wrong, rate, hours): decisions of the gates and how many look wrong afterwards.

    kills (hypothesis_id, ts, reason): wrong (false positives) where the hypothesis is alive again by its status, or was updated after the kill; `hours` is
    the mean time to that update. passes (hypothesis_id, ts): wrong (false negatives) where it was rejected, or its closed trades lose more than `loss` on
    average. updates (hypothesis_id, ts), statuses (hypothesis_id, status), outcomes (hypothesis_id, r). share: of all kills; a null reason is 'unknown'.
    """
    killed = asof.next_after(kills, updates, ["hypothesis_id"], "ts", "ts", {"ts": "updated_at"}).join(statuses, "hypothesis_id", "left")
    alive = F.coalesce(F.col("status").isin("testing", "validated", "deployed"), F.lit(False)) | F.col("updated_at").isNotNull()
    hours = (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    gates = killed.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"), F.count_if(alive).alias("wrong"), F.avg(hours).alias("hours"))
    gates = gates.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a reason
    lost = outcomes.groupBy("hypothesis_id").agg(F.avg("r").alias("mean"))
    passed = passes.join(statuses, "hypothesis_id", "left").join(lost, "hypothesis_id", "left")
    bad = F.coalesce(F.col("status") == "rejected", F.lit(False)) | F.coalesce(F.col("mean") < loss, F.lit(False))
    through = passed.agg(F.count("*").alias("n"), F.count_if(bad).alias("wrong")).select(F.lit(None).cast("string").alias("reason"), "n", "wrong", F.lit(None).cast("double").alias("hours"), F.lit(None).cast("double").alias("share"))
    both = gates.withColumn("side", F.lit("kill")).unionByName(through.withColumn("side", F.lit("pass")))
    return both.select("side", "reason", "n", "share", "wrong", F.coalesce(F.try_divide("wrong", "n"), F.lit(0.0)).alias("rate"), "hours")


def attributed(trades: DataFrame, positions: int = 20) -> DataFrame:
    """Trades (r, entry_price, close_price, prediction, weight, avg_price, benchmark) with the parts of their return: timing by the average price of the
    holding window, sizing against an equal weight, signal as the rest; and whether the direction was right."""
    timing = F.when((F.col("avg_price") > 0) & (F.col("entry_price") > 0), (F.col("avg_price") - F.col("entry_price")) / F.col("entry_price")).otherwise(0.0)
    sizing = F.col("r") * (F.col("weight") - 1.0 / positions)
    right = F.when(F.col("prediction") > 0, F.col("close_price") > F.col("entry_price")).otherwise(F.col("close_price") < F.col("entry_price"))
    return trades.withColumns({"timing": timing, "sizing": sizing, "correct": right}).withColumn("signal", F.col("r") - F.col("timing") - F.col("sizing"))


def attribution_summary(attributed_: DataFrame, *by: str) -> DataFrame:
    """Of attributed() trades: hit rate, mean parts and benchmark, and the information ratio of excess returns (population deviation; null where it is 0)."""
    excess = F.col("r") - F.col("benchmark")
    ratio = F.when((F.count("*") > 1) & (F.stddev_pop(excess) > 1e-12), F.avg(excess) / F.stddev_pop(excess))
    return attributed_.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("hit_rate"), *[F.avg(c).alias(c) for c in ("signal", "timing", "sizing", "benchmark")], ratio.alias("information_ratio"))


#: Fixed values by risk tolerance from 1 to 5: loss at which to stop, and base size.
STOP_LOSS = {1: 0.03, 2: 0.05, 3: 0.07, 4: 0.10, 5: 0.15}
BASE_SIZE = {1: 0.03, 2: 0.05, 3: 0.07, 4: 0.08, 5: 0.10}


def recommended(predictions: DataFrame, strength: str, price: str, tolerance: str, top: int, least: str = "LOW", by: tuple[str, ...] = (), order: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The `top` strongest positive predictions of each batch with confidence, target, stop, size and horizon; then those without a positive price and
    those below the least confidence go. A tolerance outside 1 to 5 counts as 3."""
    s, p = F.col(strength), F.col(price)
    of = lambda values: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(tolerance)), F.lit(values[3]))
    rank = lambda c: F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).otherwise(1)
    best = predictions.where(s > 0)
    w = Window.partitionBy(*by).orderBy(s.desc(), *order)
    best = best.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= top).drop("__rn") if by else best.orderBy(s.desc(), *order).limit(top)
    confidence = F.when(s >= 0.7, "HIGH").when(s >= 0.4, "MEDIUM").otherwise("LOW")
    out = best.where(p > 0).withColumn("confidence", confidence).where(rank(F.col("confidence")) >= rank(F.lit(least)))
    return out.withColumns({"target": p * (1 + s * 0.5), "stop": p * (1 - of(STOP_LOSS)), "size": F.least(of(BASE_SIZE) * (1 + s), F.lit(0.10)), "horizon": F.when(s > 0.5, 20).otherwise(60)})


def held_returns(active: DataFrame, bars: DataFrame, days: DataFrame) -> DataFrame:
    """(day, day_return, week_return) of a portfolio (symbol, weight) on each of `days` (day): the weighted last over first close of the bars of the two days
    and of the eight days that end there; symbols with fewer than two bars in them count 0, a portfolio without holdings gives no rows.

    Days are spread over the dates they look back on and joined on the date: a bar meets as many rows as days look back on it.
    """
    looked = days.select("day", F.explode(F.sequence(F.date_sub("day", 7), "day")).alias("date"))
    rows = bars.join(active, "symbol").join(looked, "date")
    at = lambda agg, c: agg(F.when(c, F.col("close")), F.when(c, F.col("date")))
    near, any_ = F.col("date") >= F.date_sub("day", 1), F.lit(True)
    per = rows.groupBy("day", "symbol", "weight").agg(*[x.alias(n) for k, c in (("d", near), ("w", any_)) for n, x in ((f"{k}n", F.count_if(c)), (f"{k}0", at(F.min_by, c)), (f"{k}1", at(F.max_by, c)))])
    move = lambda k: F.sum(F.when((F.col(f"{k}n") >= 2) & (F.col(f"{k}0") > 0), F.col("weight") * (F.col(f"{k}1") / F.col(f"{k}0") - 1)).otherwise(0.0))
    some = active.limit(1).select(F.lit(1).alias("__any"))
    found = per.groupBy("day").agg(move("d").alias("day_return"), move("w").alias("week_return"))
    return days.select("day").join(F.broadcast(some)).join(found, "day", "left").select("day", F.coalesce("day_return", F.lit(0.0)).alias("day_return"), F.coalesce("week_return", F.lit(0.0)).alias("week_return"))  # one row


def breaker(day: Column, week: Column, day_limit: float = -0.03, week_limit: float = -0.05) -> tuple[Column, Column]:
    """Why to halt (null if not), and the size multiplier: from 1 at the day's limit down to a half at the week's."""
    share = (week - day_limit) / (week_limit - day_limit)
    return F.when(day < day_limit, "daily_loss").when(week < week_limit, "weekly_loss"), F.when((week > week_limit) & (week < day_limit), F.greatest(F.lit(0.5), 1 - 0.5 * share)).otherwise(1.0)
