"""Exponential averages and what rests on them: one grouped pass per symbol computes all outputs, as the recurrence has no finite frame."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUTS = ("ema_12d", "ema_26d", "ema_crossover", "macd_line", "macd_signal", "macd_histogram", "rsi_14d", "atr_14d", "adx_14d")


def ema(x: np.ndarray, span: int) -> np.ndarray:
    """pandas' ewm(span, adjust=False).mean(), whose set-up costs more than a symbol's days; a missing value lets the old one's weight decay."""
    a = 2 / (span + 1)
    out, y, old = [], math.nan, 1.0
    for v in x.tolist():
        if y != y:
            y = v
        else:
            old *= 1 - a
            if v == v:
                if v != y:
                    y = (old * y + a * v) / (old + a)
                old = 1.0
        out.append(y)
    return np.array(out, float)


def series(p: np.ndarray, h: np.ndarray, low: np.ndarray, names: tuple[str, ...] = OUTPUTS) -> dict[str, np.ndarray]:
    """The named outputs of one symbol's prices in order of date, NaN where missing: seed is the first value, weight 2 / (span + 1)."""
    need = lambda *of: not set(of).isdisjoint(names)
    lagged = lambda v: np.concatenate([[np.nan], v[:-1]])
    out = {}
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        before = lagged(p)
        if need("ema_12d", "ema_26d", "ema_crossover", "macd_line", "macd_signal", "macd_histogram"):
            e12, e26 = ema(p, 12), ema(p, 26)
            line = e12 - e26
            out |= {"ema_12d": e12, "ema_26d": e26, "ema_crossover": np.sign(line), "macd_line": line}
            if need("macd_signal", "macd_histogram"):
                signal = ema(line, 9)
                out |= {"macd_signal": signal, "macd_histogram": line - signal}
        if need("rsi_14d"):
            d = p - before
            gain, loss = ema(np.where(d > 0, d, 0.0), 14), ema(np.where(d < 0, -d, 0.0), 14)
            out["rsi_14d"] = np.where(loss > 0, 100 - 100 / (1 + gain / loss), np.where(gain > 0, 100.0, np.nan))
        if need("atr_14d", "adx_14d"):
            atr = out["atr_14d"] = ema(np.fmax(np.fmax(h - low, np.abs(h - before)), np.abs(low - before)), 14)
        if need("adx_14d"):
            up, down = h - lagged(h), lagged(low) - low
            plus, minus = ema(np.where((up > down) & (up > 0), up, 0.0), 14), ema(np.where((down > up) & (down > 0), down, 0.0), 14)
            pdi, mdi = (np.where(atr > 0, 100 * m / atr, np.nan) for m in (plus, minus))
            out["adx_14d"] = ema(np.where(pdi + mdi > 0, 100 * np.abs(pdi - mdi) / (pdi + mdi), np.nan), 14)
    return {n: out[n] for n in names}


def averages(g: pd.DataFrame, names: tuple[str, ...] = OUTPUTS, keep: tuple[str, ...] = ()) -> pd.DataFrame:
    """series() of one symbol's bars in order of date, beside symbol, date and the columns of `keep`."""
    return pd.DataFrame({"symbol": g["symbol"], "date": g["date"], **{c: g[c] for c in keep}, **series(*(g[c].to_numpy(float) for c in ("p", "high", "low")), names)})


def numbers(tab: pa.Table, column: str) -> np.ndarray:
    """A column as doubles, NaN where null."""
    return np.asarray(tab[column].cast(pa.float64()).fill_null(np.nan).to_numpy(), float)


def ewm_features(prices: DataFrame, names: tuple[str, ...] = OUTPUTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """symbol, date, the columns of `keep` and the named outputs. One shuffle by symbol; a group is one symbol's days."""
    kind = dict(prices.dtypes)["symbol"]
    base = prices.select("symbol", "date", F.coalesce("adj_close", "close").alias("p"), "high", "low", *[c for c in keep if c not in ("high", "low")]).where("p is not null")
    schema = f"symbol {kind}, date date, " + "".join(f"`{c}` {dict(base.dtypes)[c]}, " for c in keep) + ", ".join(f"{n} double" for n in names)

    def run(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by("date")
        got = series(*(numbers(tab, c) for c in ("p", "high", "low")), names)
        return pa.table({**{c: tab[c] for c in ("symbol", "date", *keep)}, **{n: pa.array(v, pa.float64(), from_pandas=True) for n, v in got.items()}})

    done = base.groupBy("symbol").applyInArrow(run, schema)
    return done.select("symbol", "date", *[F.when(~F.isnan(c), F.col(c)).alias(c) if dict(base.dtypes)[c] == "double" else F.col(c) for c in keep], *names)
