"""Ordered scans of groups of any size: running sums, row numbers and average ranks in range partitions, with what stands before each carried over.

A window by a key with few values (a fold, a feature, a model) sorts all its rows in one task. Here rows are dealt by ranges of (key, order), so a group
lies in as many blocks as it needs; sums per block are scanned, which is a row a key and block, and what remains is a window within the block. Totals are a row a key, so they are broadcast: a join by the key would send all rows of
one to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def blocks(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """df as a written table with `block`: blocks ascend in the order of (by, order), and no row stands in a later block than a row that follows it.

    Rows that are equal in all of these are dealt among blocks too, so no tie fills a task.
    """
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    return written(salted.repartitionByRange(*by, *order, "__salt").drop("__salt").withColumn("block", F.spark_partition_id()), "blocks")


def before(df: DataFrame, by: list[str], maxes: dict[str, Column] | None = None, **sums: Column) -> DataFrame:
    """(by, block) with the sums and the maxima over the key's earlier blocks: 0 and null for the first."""
    totals = df.groupBy(*by, "block").agg(*[F.sum(x).alias(n) for n, x in sums.items()], *[F.max(x).alias(n) for n, x in (maxes or {}).items()])
    w = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "block", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums], *[F.max(n).over(w).alias(n) for n in maxes or {}])


def running(df: DataFrame, by: list[str], order: list[Column | str], maxes: dict[str, Column] | None = None, **sums: Column) -> DataFrame:
    """Running sums and maxima (this row included) in order within `by`, of a table with blocks. Keys are not null; ties in the order stand in any order."""
    w = Window.partitionBy(*by, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = before(df, by, maxes, **sums).select(*by, "block", *[F.col(n).alias(f"__{n}") for n in [*sums, *(maxes or {})]])
    found = {n: F.col(f"__{n}") + F.coalesce(F.sum(x).over(w), F.lit(0)) for n, x in sums.items()} | {n: F.greatest(F.col(f"__{n}"), F.max(x).over(w)) for n, x in (maxes or {}).items()}
    return df.join(carried, [*by, "block"]).withColumns(found).drop(*[f"__{n}" for n in found])


def numbered(df: DataFrame, by: list[str], order: list[Column | str], to: str = "n") -> DataFrame:
    """Row numbers from 1 in the order within `by`, exact for groups of any size. Keys are not null."""
    return running(blocks(df, by, order), by, order, **{to: F.lit(1)}).drop("block")


def tiled(df: DataFrame, by: list[str], order: list[Column | str], tiles: int, to: str) -> DataFrame:
    """ntile: the rows of each `by` in order, dealt into tiles of sizes that differ by one at most, the larger first."""
    n, k, b = F.col("__n"), F.col("__k"), F.lit(tiles)
    size, large = F.floor(n / b), n % b
    tile = F.when(k <= large * (size + 1), F.floor((k - 1) / (size + 1)) + 1).otherwise(large + F.floor(F.try_divide(k - 1 - large * (size + 1), size)) + 1)
    totals = df.groupBy(*by).agg(F.count("*").alias("__n"))
    return numbered(df, by, order, "__k").join(F.broadcast(totals), by).withColumn(to, tile.cast("int")).drop("__n", "__k")


def quantiles(df: DataFrame, by: list[str], value: str, **at: float) -> DataFrame:
    """(by, names of `at`): exact quantiles of the non-null values, interpolated between neighbours, by row numbers: no task holds a group's values."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    rows = numbered(rows, by, ["__v"], "__k").join(F.broadcast(rows.groupBy(*by).agg(F.count("*").alias("__n"))), by)
    place = {name: (F.col("__n") - 1) * q for name, q in at.items()}
    near = lambda p: F.greatest(1 - F.abs(F.col("__k") - 1 - p), F.lit(0.0))  # noqa: E731  weight of a row: both neighbours of the place share 1
    wanted = F.lit(False)
    for p in place.values():
        wanted = wanted | (near(p) > 0)
    return rows.where(wanted).groupBy(*by).agg(*[F.sum(F.when(near(p) > 0, near(p) * F.col("__v"))).alias(name) for name, p in place.items()])


def trailing(df: DataFrame, by: list[str], at: Column, span: int, **sums: Column) -> DataFrame:
    """df with sums over (at - span, at] within `by`, `at` being whole numbers such as days. A window a key and stretch of time, not a key: each row is dealt
    to its stretch of `span` and to the next, where it only counts."""
    own = F.floor(at / span)
    both = df.withColumn("__at", at).withColumn("__block", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy(*by, "__block").orderBy("__at").rangeBetween(-(span - 1), 0)
    return both.withColumns({n: F.sum(x).over(w) for n, x in sums.items()}).where(F.floor(F.col("__at") / span) == F.col("__block")).drop("__at", "__block")


def ranks(df: DataFrame, by: list[str], value: str, to: str = "rank") -> DataFrame:
    """Average ranks of a non-null column within `by`: 1 + the number of smaller values + half the number of other equal ones.

    A value that lies across blocks is the first or last of each of them, so a row a key and block tells its whole count. Two exchanges of the rows (one by
    range, one by block), whatever the number of keys. Keys are not null.
    """
    rows = blocks(df, by, [value])
    ends = rows.groupBy(*by, "block").agg(F.count("*").alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    ends = rows.select(*by, "block", value).join(ends, [*by, "block"]).groupBy(*by, "block").agg(
        F.first("__n").alias("__n"), F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"), F.count_if(F.col(value) == F.col("__lo")).alias("__los"), F.count_if(F.col(value) == F.col("__hi")).alias("__his")
    )
    w = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = written(ends.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))), "ends")
    low = ends.select(*by, F.col("__lo").alias("v"), F.col("__los").alias("n"), F.col("__before").alias("less"))
    high = ends.where("__lo < __hi").select(*by, F.col("__hi").alias("v"), F.col("__his").alias("n"), (F.col("__before") + F.col("__n") - F.col("__his")).alias("less"))
    edge = low.union(high).groupBy(*by, "v").agg((F.min("less") + (F.sum("n") + 1) / 2).alias("at"))
    at = lambda v, to: edge.select(*by, F.col("v").alias(v), F.col("at").alias(to))
    ends = ends.join(at("__lo", "__at_lo"), [*by, "__lo"]).join(at("__hi", "__at_hi"), [*by, "__hi"]).select(*by, "block", "__lo", "__hi", "__before", "__at_lo", "__at_hi")
    own, same = Window.partitionBy(*by, "block").orderBy(value), Window.partitionBy(*by, "block", value)
    rank = F.when(F.col(value) == F.col("__lo"), F.col("__at_lo")).when(F.col(value) == F.col("__hi"), F.col("__at_hi")).otherwise(F.col("__before") + F.rank().over(own) + (F.count("*").over(same) - 1) / 2)
    return rows.join(ends, [*by, "block"]).withColumn(to, rank).drop("block", "__lo", "__hi", "__before", "__at_lo", "__at_hi")


def rank_correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, ic, n): Spearman's correlation of the non-null pairs of each group, 0 where undefined, by ranks() of both columns."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    both = ranks(ranks(pairs, by, "__x", "__rx").drop("__x"), by, "__y", "__ry")
    ic = F.try_divide(F.covar_pop("__rx", "__ry"), F.sqrt(F.var_pop("__rx") * F.var_pop("__ry")))  # corr() fails on a constant
    return both.groupBy(*by).agg(F.coalesce(ic, F.lit(0.0)).alias("ic"), F.count("*").alias("n"))
