"""Quantile sketches that are kept and merged: a KLL sketch per key and month as a binary column, from which any range of months is answered.

A sketch of size k holds some 3k numbers whatever it has seen; ranks of its quantiles are within about 2.3 / k^0.9 of the true ones (99 % of the time), also
after merging. Sums, extremes and counts beside it are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400
#: Bound of the rank error at K that holds with room to spare.
ERROR = 3 * 2.3 / K**0.9
#: Points of the grid by which drift() reads ranks.
GRID = 2000


def monthly(df: DataFrame, by: list[str], date: str, value: str, k: int = K) -> DataFrame:
    """(by, month, sketch, n, lo, hi, total): one row a key and month of the non-null values; partial sketches are merged before and after the shuffle."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.trunc(date, "month").alias("month"), F.col(value).cast("double").alias("__v"))
    return rows.groupBy(*by, "month").agg(F.kll_sketch_agg_double("__v", k).alias("sketch"), F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.sum("__v").alias("total"))


def merged(months: DataFrame, by: list[str], start: str | None = None, end: str | None = None, k: int = K) -> DataFrame:
    """(by, sketch, n, lo, hi, total) over the months from start to end, by what monthly() has kept: no value is read again."""
    d = months
    if start is not None:
        d = d.where(F.col("month") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.where(F.col("month") <= F.lit(end).cast("date"))
    return d.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"))


def with_quantiles(sketches: DataFrame, **at: float) -> DataFrame:
    """sketches with a column for each quantile asked for."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for name, q in at.items()})


def drift(reference: DataFrame, new: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """D02 from sketches alone: (by, n_ref, n_new, psi) with equal-width bins over the reference's range, whose shares are differences of ranks; the reference
    side can be kept for as long as a model serves. New values outside the range are ignored, as in the exact form."""
    both = reference.select(*by, F.col("sketch").alias("__r"), F.col("n").alias("n_ref"), "lo", "hi").join(new.select(*by, F.col("sketch").alias("__s"), F.col("n").alias("n_new")), by).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    # ranks of computed values by a grid of quantiles, as a sketch only tells those of constants
    grid = F.lit([(i + 0.5) / GRID for i in range(GRID)])
    both = both.withColumns({f"{s}q": F.kll_sketch_get_quantile_double(s, grid) for s in ("__r", "__s")})
    edge = lambda i: F.col("hi") if i == bins else F.col("lo") + width * i
    below = lambda s, i: F.size(F.filter(f"{s}q", lambda q: q <= edge(i) if i == bins else q < edge(i))) / F.lit(float(GRID))
    ranks = both.select(*by, "n_ref", "n_new", width.alias("__w"), *[below(s, i).alias(f"{s}{i}") for s in ("__r", "__s") for i in range(bins + 1)])
    shares = {s: [F.col(f"{s}{i + 1}") - F.col(f"{s}{i}") for i in range(bins)] for s in ("__r", "__s")}
    psi = F.lit(0.0)
    dense = {}
    for s, parts in shares.items():
        inside = sum(parts, F.lit(0.0))
        d = [F.try_divide(F.greatest(p, F.lit(0.0)), inside * F.col("__w")) + 1e-10 for p in parts]
        total = sum(d, F.lit(0.0))
        dense[s] = [x / total for x in d]
    for p, q in zip(dense["__r"], dense["__s"], strict=True):
        psi = psi + (p - q) * F.log(p / q)
    return ranks.select(*by, "n_ref", "n_new", psi.alias("psi"))
