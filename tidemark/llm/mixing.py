"""Mixing sources to target weights by cube-method balanced sampling.

Each document is taken a whole number of times: floor(target / source size) copies, and one more by a balanced sample whose inclusion probability is
the remainder. Null texts have size 0; the null source comes last; repeated ids and rows are separate units; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, table, written

EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = 3.0) -> dict[str | None, float]:
    """Shares of the total size by weight; a share stops at `most` times its source's size and the excess is shared anew among the rest."""
    total, full = float(sum(sizes.values())), set()
    while True:
        rest = [s for s in sizes if s not in full]
        weight = sum(weights[s] for s in rest)
        left = total - sum(most * sizes[s] for s in full)
        over = {s for s in rest if left * weights[s] / weight > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else left * weights[s] / weight for s in sizes}
        full |= over


def flight(p: np.ndarray, x: np.ndarray, rng) -> np.ndarray:
    """Flight phase with constraints sum(p) and sum(p * x): moves three fractional units at a time along the null space of the constraints.

    Every step keeps both sums and each unit's expectation and makes a unit 0 or 1; at most two units stay fractional.
    """
    p, x = p.astype(float).tolist(), x.astype(float).tolist()
    draws = iter(rng.random(len(p) + 8).tolist())
    live: list[int] = []
    for k in range(len(p)):
        if p[k] <= EPS or p[k] >= 1 - EPS:
            p[k] = float(round(p[k]))
            continue
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(live, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(live, u, strict=True) if v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(live, u, strict=True):
            p[i] += step * v
            if p[i] <= EPS or p[i] >= 1 - EPS:
                p[i] = float(round(p[i]))
        live = [i for i in live if 0 < p[i] < 1]
    return np.array(p)


def landing(p: np.ndarray, x: np.ndarray, carry: tuple[float, float] = (0.0, 0.0), worth: float = 1.0) -> np.ndarray:
    """0 or 1 for each of a few fractional units: the choice whose totals of size and of count (with `carry`, tokens and documents already over target) move
    least, a document being worth so many tokens.

    All choices are compared; the units number at most a dozen or so.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = picks - p[open_]
    off = np.abs(off @ x[open_] + carry[0]) + np.abs(off.sum(axis=1) + carry[1]) * worth
    out = p.copy()
    out[open_] = picks[int(np.argmin(off))]
    return out


def tilted(p: np.ndarray, x: np.ndarray, carry: tuple[float, float]) -> np.ndarray:
    """Probabilities moved along a + b*size so that the totals of size and count give back `carry`, as far as bounds of 0.02 and 0.98 allow."""
    q, size, count = p.copy(), *carry
    for _ in range(4):
        free = (q > 0) & (q < 1)
        if abs(size) + abs(count) < 1e-9 or not free.any():
            break
        y = x[free] / max(1.0, float(x[free].max()))
        both = np.stack([np.ones(len(y)), y])
        move = np.linalg.lstsq(both @ both.T, -np.array([count, size / max(1.0, float(x[free].max()))]), rcond=None)[0] @ both
        new = np.clip(q[free] + move, np.minimum(0.02, q[free]), np.maximum(0.98, q[free]))
        size, count = size + float((new - q[free]) @ x[free]), count + float((new - q[free]).sum())
        q[free] = new
    return q


def sample(p: np.ndarray, x: np.ndarray, rng, small: int = 16) -> np.ndarray:
    """Balanced sample of a block on size and count: flights from the largest half of its units to the smallest few, which land.

    A flight leaves two of its units fractional. These are rounded, and the tokens and documents that this moves are given back by tilting the probabilities
    of all smaller units along their size, so that the next flight balances both; the last `small` units, the smallest, make up what is left.
    """
    order = np.lexsort((np.arange(len(x)), -x))
    q, y = p[order].astype(float), x[order].astype(float)
    at, aim, worth = 0, np.array([float(q @ y), float(q.sum())]), max(1.0, float(y.mean()) / 4)

    def over() -> tuple[float, float]:
        """Tokens and documents over target, with what is still fractional as it stands."""
        return float(q @ y) - aim[0], float(q.sum()) - aim[1]

    while len(q) - at > small:
        to = at + (len(q) - at + 1) // 2
        mix = rng.permutation(to - at)
        flown = np.empty(to - at)
        flown[mix] = flight(q[at:to][mix], y[at:to][mix], rng)
        q[at:to] = flown
        q[at:to] = landing(flown, y[at:to], over(), worth)
        q[to:] = tilted(q[to:], y[to:], over())
        at = to
    q[at:] = landing(q[at:], y[at:], over(), worth)
    out = np.empty(len(p))
    out[order] = q
    return out


def balanced(units: DataFrame, strata: dict[str | None, int], seed: int = 0, block: int = 1000) -> DataFrame:
    """units (unit_id, source, size, p, ...) with p moved to 0 or 1 for each, balanced on count and size within blocks of each source.

    Blocks of about `block` units are dealt by a hash of the id, so a hot source spreads over many tasks; each keeps its own totals, so their sums do.
    `strata`: number of units of each source.
    """
    schema = units.schema
    names = [f.name for f in schema]
    kinds = T.StructType([T.StructField("of", T.StringType()), T.StructField("parts", T.LongType())])
    spread = units.sparkSession.createDataFrame([(s, -(-k // block)) for s, k in strata.items()], kinds)
    dealt = units.join(F.broadcast(spread), F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("unit_id", "size", "text_hash"), "parts"))

    def run(key: tuple, tab: pa.Table) -> pa.Table:
        tab = tab.sort_by([("unit_id", "ascending"), ("size", "ascending"), ("text_hash", "ascending")])
        own = repr((seed, key[0].as_py(), key[1].as_py()))
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(own.encode()).digest()[:8], "big"))
        p = sample(tab["p"].to_numpy(), tab["size"].to_numpy().astype(float), rng)
        return tab.set_column(tab.schema.get_field_index("p"), "p", pa.array(p)).select(names)

    return dealt.groupBy("source", "block").applyInArrow(run, schema)


def mix_sources(docs: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 0, id_col: str = "doc_id", max_sources: int = 100_000) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, text_hash) of each document.

    Weights repeat `cycle` over the sources in code-point order. Only one row per source comes to the driver; more than `max_sources` are refused, as
    weights are set per source by a caller.
    """
    sizes = written(docs.select(F.col(id_col).alias("unit_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")), "sizes")
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    total = {r["source"]: r["size"] for r in rows}
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal = targets(total, {s: cycle[i % len(cycle)] for i, s in enumerate(order)}, most) if sum(total.values()) else dict.fromkeys(total, 0.0)
    plan = []
    for s in order:
        ratio = min(most, goal[s] / total[s]) if total[s] else 0.0
        whole = int(ratio + EPS)
        plan.append((s, total[s], float(goal[s]), whole, max(0.0, ratio - whole)))
    kinds = T.StructType([T.StructField("of", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("whole", T.LongType()), T.StructField("p", T.DoubleType())])
    spark = docs.sparkSession
    units = sizes.join(F.broadcast(spark.createDataFrame(plan, kinds)), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    flown = balanced(units, {r["source"]: r["n"] for r in rows}, seed)
    copies = F.col("whole") + F.round("p").cast("long")
    return flown.select(F.col("unit_id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "text_hash")


def op5_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
