"""Rolling moments of a symbol's series in one vectorised pass: a window aggregate would go over each frame's rows anew for every row.

Each value is taken from its own frame, around the frame's own mean, so no running sums cancel. Values are null until the frame holds as many numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Frames at a time, which bounds a task's memory for series of any length.
CHUNK = 4096


def frames(x: np.ndarray, n: int, f: Callable[..., np.ndarray], *more: np.ndarray) -> np.ndarray:
    """f of the last n values at each row, NaN before there are n."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    views = [np.lib.stride_tricks.sliding_window_view(v, n) for v in (x, *more)]
    for at in range(0, len(views[0]), CHUNK):
        part = f(*(v[at : at + CHUNK] for v in views))
        out[n - 1 + at : n - 1 + at + len(part)] = part
    return out


def mean(v: np.ndarray) -> np.ndarray:
    return v.mean(axis=1)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=np.isfinite(b) & (b != 0))


def deviation(v: np.ndarray) -> np.ndarray:
    return v.std(axis=1, ddof=1)


def _moment(v: np.ndarray, k: int) -> np.ndarray:
    d = v - v.mean(axis=1, keepdims=True)
    m2 = (d * d).mean(axis=1)
    return np.divide((d**k).mean(axis=1), m2 ** (k / 2), out=np.full(len(v), np.nan), where=m2 > 0)


def skewness(v: np.ndarray) -> np.ndarray:
    """Bias-adjusted, from the population value."""
    n = v.shape[1]
    return _moment(v, 3) * (n * (n - 1)) ** 0.5 / (n - 2)


def kurtosis(v: np.ndarray) -> np.ndarray:
    n = v.shape[1]
    return ((n + 1) * (_moment(v, 4) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3))


def correlation(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    a, b = v - v.mean(axis=1, keepdims=True), w - w.mean(axis=1, keepdims=True)
    size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.divide((a * b).sum(axis=1), size, out=np.full(len(v), np.nan), where=size > 0)


def autocorrelation(r5: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of 60 five-row returns with those of the row before: 59 pairs."""
    out = frames(r5, 59, correlation, before)
    return np.where(np.isfinite(frames(r5, 60, mean)), out, np.nan)


def value_at_risk(r1: np.ndarray, z: float, density: float, level: int, days: int, shortfall: bool = False) -> np.ndarray:
    mu, sigma = frames(r1, 252, mean), frames(r1, 252, deviation)
    return -mu * days + sigma * days**0.5 * density / (1 - level / 100) if shortfall else -(mu * days - z * sigma * days**0.5)


def by_symbol(df: DataFrame, names: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]], inputs: list[str], drop: list[str]) -> DataFrame:
    """df without `drop`, with each named series, computed from the `inputs` of a symbol's rows in order of date. A group is one symbol's days."""
    kept = [f for f in df.schema if f.name not in drop]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` double" for n in names])

    def run(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by("date")
        x = {c: np.asarray(tab[c].cast(pa.float64()).fill_null(np.nan).to_numpy(), float) for c in inputs}
        with np.errstate(invalid="ignore", over="ignore"):
            got = {n: f(x) for n, f in names.items()}
        return pa.table([*(tab[f.name] for f in kept), *(pa.array(v, pa.float64(), from_pandas=True) for v in got.values())], names=[*(f.name for f in kept), *got])

    return df.groupBy("symbol").applyInArrow(run, schema)
