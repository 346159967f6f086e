"""Connected components as Spark joins: rounds of contraction towards random neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (u, v), roots equal exactly within a connected component.

    In each round every node moves to the neighbour (or itself) of least rank under a fresh hash, and edges follow; the expected number of
    live nodes shrinks by a constant factor whatever the shape of the graph, so long chains take O(log n) rounds. Grouping is by aggregates with
    map-side combination and by joins that adaptive execution can split; no neighbour list is ever collected. An empty edge list gives no rows.
    """
    live = written(edges.where("u <> v").distinct(), "edges")
    where = None
    for k in range(limit):
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(F.xxhash64(F.lit(k), "v").alias("rank"), "v")).alias("m"))
        here = F.struct(F.xxhash64(F.lit(k), "u").alias("rank"), F.col("u").alias("v"))
        moved = written(least.select("u", F.least("m", here)["v"].alias("to")), "moved")
        a, b = moved.select("u", F.col("to").alias("nu")), moved.select(F.col("u").alias("v"), F.col("to").alias("nv"))
        live = written(live.join(a, "u").join(b, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v")).where("u <> v").distinct(), "edges")
        if where is None:
            where = moved.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            step = moved.select(F.col("u").alias("root"), "to")
            where = where.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            where = written(where, "roots")
    else:
        raise RuntimeError("components: too many rounds")
    return where if where is not None else live.select(F.col("u").alias("node"), F.col("v").alias("root"))
