"""Hard-negative mining by segment summaries: each vector segment's mean and deviation bound every inner product; exact scores follow where bounds leave doubt.

A vector x of length d is cut into segments. With segment means m and deviations s (the norm of what is left of a segment of length L without its mean),
a segment adds L*m_x*m_y to an inner product, give or take s_x*s_y. Sums over segments bound the score from both sides; segments of 16 components are
refined to 4 and to 2 for the pairs that the coarser bound can't settle, and only pairs that no bound settles are scored exactly.

Rows with a null label, a null vector or a component that is null or not finite take no part, nor does a row whose scaled component leaves the range of
doubles. A row is one row, whatever repeats it: a copy of an anchor is one of its other rows. Vectors are compared with those of their own length; empty
ones score 0. Null ids come last among ties and are never anchors. Scores are exact integers; those outside a long are held at its ends, before anything is
compared. Extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, values, written

#: Lengths of segments, each a multiple of the next; summaries are stored for the last and added up for the others.
SEGMENTS = (16, 4, 2)
#: Rows and anchors of a tile.
ROWS, ANCHORS = 8192, 4096
#: Pairs of one pass of numpy within a tile.
AT_ONCE = 1 << 20
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """Rows that take part, with vec (integers floor(scale*x), 2, 4 or 8 bytes each), dim, and the sums and deviations of the shortest segments."""
    x = F.transform(vector, lambda v: v.cast("double") * F.lit(float(scale)))
    inf = F.lit(float("inf"))
    rest = [c for c in df.columns if c != vector]
    rows = df.select(*rest, x.alias("__x")).where(F.col("__x").isNotNull() & F.forall("__x", lambda v: F.coalesce((v > -inf) & (v < inf), F.lit(False))))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest) + ", dim int, vec binary, parts binary"

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 8192):
                part = b.slice(lo, 8192)
                col = values(part, "__x")
                dims = np.diff(np.asarray(col.offsets))
                flat = np.floor(np.asarray(col.flatten(), float))
                at = np.concatenate([[0], np.cumsum(dims)])
                vec, parts = [b""] * len(dims), [b""] * len(dims)
                for d in np.unique(dims):
                    of = np.flatnonzero(dims == d)
                    v = flat[at[of][:, None] + np.arange(d)]
                    most = np.abs(v).max(axis=1, initial=0)
                    wide = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
                    both = np.concatenate(_summary(v), axis=1)
                    for k, row, w, p in zip(of.tolist(), v, wide.tolist(), both, strict=True):
                        vec[k], parts[k] = row.astype({2: "<i2", 4: "<i4", 8: "<f8"}[w]).tobytes(), p.tobytes()
                yield pa.RecordBatch.from_arrays([*(values(part, c) for c in rest), pa.array(dims, pa.int32()), pa.array(vec, pa.binary()), pa.array(parts, pa.binary())], names=[*rest, "dim", "vec", "parts"])

    return rows.mapInArrow(run, schema)


def _summary(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and deviations of the shortest segments of each row."""
    starts = np.arange(0, v.shape[1], SEGMENTS[-1])
    if not len(starts):
        return np.zeros((len(v), 0)), np.zeros((len(v), 0))
    size = np.diff([*starts, v.shape[1]])
    sums = np.add.reduceat(v, starts, axis=1)
    return sums, np.sqrt(np.add.reduceat((v - np.repeat(sums / size, size, axis=1)) ** 2, starts, axis=1))


class Vectors:
    """Vectors of one length with their summaries, one level for each of SEGMENTS: means times the root of the length, and deviations."""

    def __init__(self, vec: list[bytes], parts: list[bytes], dim: int):
        width = np.array([len(x) for x in vec]) // max(dim, 1)
        self.v = np.zeros((len(vec), dim))
        for w, kind in ((2, "<i2"), (4, "<i4"), (8, "<f8")):
            of = np.flatnonzero(width == w)
            if dim and len(of):
                self.v[of] = np.frombuffer(b"".join(vec[k] for k in of), kind).reshape(len(of), dim)
        n = -(-dim // SEGMENTS[-1])
        both = np.frombuffer(b"".join(parts), "<f8").reshape(len(vec), 2 * n)
        sums, dev = both[:, :n], both[:, n:]
        self.most = float(np.abs(self.v).max(initial=0))
        self.levels, shortest = [], np.diff([*range(0, dim, SEGMENTS[-1]), dim]) if dim else np.zeros(0)
        for length in SEGMENTS:
            starts = np.arange(0, n, length // SEGMENTS[-1])
            if not len(starts):
                self.levels.append((np.zeros((len(vec), 0)), np.zeros((len(vec), 0))))
                continue
            size, total = np.add.reduceat(shortest, starts), np.add.reduceat(sums, starts, axis=1)
            # deviation of the whole: that within the parts and that of the parts' means
            spread = np.add.reduceat(dev**2 + sums**2 / shortest, starts, axis=1) - total**2 / size
            self.levels.append((total / np.sqrt(size), np.sqrt(np.maximum(spread, 0))))
        self.norm = np.sqrt((self.v**2).sum(axis=1))


def bounds(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores of rows i of a with rows j of b; the slack covers the rounding of sums."""
    mid = a.levels[level][0][i] @ b.levels[level][0][j].T
    off = a.levels[level][1][i] @ b.levels[level][1][j].T + 1e-6 + 1e-9 * np.outer(a.norm[i], b.norm[j])
    low, high = mid - off, mid + off
    return np.clip(np.where(np.isnan(low), -np.inf, low), *_LONG), np.clip(np.where(np.isnan(high), np.inf, high), *_LONG)


def exact(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """Scores as int64, or as Python integers within a long where a sum could leave the integers that a double holds."""
    if a.v.shape[1] * a.most * b.most < 1 << 53:
        return (a.v[i] @ b.v[j].T).astype(np.int64)
    left, right = (np.array([[int(x) for x in row] for row in v], object).reshape(len(v), a.v.shape[1]) for v in (a.v[i], b.v[j]))
    return np.clip(left @ right.T if a.v.shape[1] else np.zeros((len(i), len(j)), object), *_LONG)


def paired(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """Scores of each row of i with its own rows of j, as in exact()."""
    if a.v.shape[1] * a.most * b.most < 1 << 53:
        return np.einsum("id,ikd->ik", a.v[i], b.v[j]).astype(np.int64)
    return np.array([exact(a, i[k : k + 1], b, j[k])[0] for k in range(len(i))], object).reshape(j.shape)


def _kth(score: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest valid score of each row as a float that is not above it, or -inf."""
    if score.shape[1] < k:
        return np.full(len(score), -np.inf)
    s = np.partition(np.where(valid, score, -np.inf).astype(float), -k, axis=1)[:, -k]
    return np.where(np.abs(s) < 1 << 53, s, s - 1e-12 * np.abs(s))


def _best(score: np.ndarray, valid: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k first valid entries of each row, by score, then id."""
    i, j = np.nonzero(valid)
    order = np.lexsort((ids[j], np.array([-x for x in score[i, j]], score.dtype), i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep]


def search(a: Vectors, b: Vectors, may: np.ndarray, ids: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each column q of low and high: (i, j, score) of the k first of b's rows for each of a's, among those that `may` and score from low to high.

    low, high: floats of shape (rows of a, q), with nan where there is no such search.
    """
    out, everything = [], np.arange(len(b.v))
    for lo in range(0, len(a.v), step := max(1, AT_ONCE // max(1, len(b.v)))):
        i, open_ = np.arange(lo, min(lo + step, len(a.v))), may[lo : lo + step].copy()
        least, most = low[i], high[i]
        j = everything
        for level in range(len(SEGMENTS)):
            floor, ceil = bounds(a, i, b, j, level)
            if not level:  # the likeliest of each search, scored at once, give its first limit from below
                mid, few = (floor + ceil) / 2, min(4 * k, len(j))
                for q in range(least.shape[1]):
                    near = np.where(open_ & (mid <= most[:, q : q + 1]), mid, -np.inf)
                    likely = np.argpartition(near, len(j) - few, axis=1)[:, len(j) - few :]
                    got = paired(a, i, b, likely)
                    limit = _kth(got, np.take_along_axis(open_, likely, axis=1) & (got <= most[:, q : q + 1]), k)
                    least[:, q] = np.where(np.isnan(most[:, q]), np.nan, np.fmax(least[:, q], limit))
            wanted = np.zeros_like(open_)
            for q in range(least.shape[1]):
                wanted |= (ceil >= least[:, q : q + 1]) & (floor <= most[:, q : q + 1])
            open_ &= wanted
            used = open_.any(axis=1), open_.any(axis=0)
            i, j, open_, least, most = i[used[0]], j[used[1]], open_[used[0]][:, used[1]], least[used[0]], most[used[0]]
            if not len(i):
                break
        if len(i):
            score = exact(a, i, b, j)
            for q in range(least.shape[1]):
                r, c = _best(score, open_ & (score >= least[:, q : q + 1]) & (score <= most[:, q : q + 1]), ids[j], k)
                out.append((np.full(len(r), q), i[r], j[c], score[r, c]))
    return out


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    """Places of ids in ascending order, nulls last; equal ids share one."""
    got = [(x is None, 0 if x is None else x) for x in ids.to_pylist()]
    place = {x: k for k, x in enumerate(sorted(set(got)))}
    return np.array([place[x] for x in got], np.int64)


def _tile(searches):
    """A function of a tile (anchors, rows): the first rows of each of the tile's searches. Tiles hold at most some ROWS rows and ANCHORS anchors."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = {c: [] for c in ("anchor", "search", "row", "row_id", "score")}
        if anchors.num_rows and rows.num_rows:
            ids, a_dim, b_dim = _order(rows["id"]), anchors["dim"].to_numpy(), rows["dim"].to_numpy()
            a_row, b_row = anchors["row"].to_numpy(), rows["row"].to_numpy()
            for d in np.intersect1d(a_dim, b_dim).tolist():
                ka, kb = np.flatnonzero(a_dim == d), np.flatnonzero(b_dim == d)
                ta, tb = anchors.take(ka), rows.take(kb)
                a, b = (Vectors(t["vec"].to_pylist(), t["parts"].to_pylist(), d) for t in (ta, tb))
                for of, may, low, high, k in searches(ta, tb):
                    for q, i, j, score in search(_Part(a, of[0]), _Part(b, of[1]), may, ids[kb][of[1]], k, low, high):
                        i, j = of[0][i], of[1][j]
                        found["anchor"] += a_row[ka[i]].tolist()
                        found["search"] += q.tolist()
                        found["row"] += b_row[kb[j]].tolist()
                        found["row_id"] += rows["id"].take(kb[j]).to_pylist()
                        found["score"] += [int(s) for s in score]
        return pa.table({"anchor": pa.array(found["anchor"], pa.int64()), "search": pa.array(found["search"], pa.int32()), "row": pa.array(found["row"], pa.int64()), "row_id": pa.array(found["row_id"], rows["id"].type), "score": pa.array(found["score"], pa.int64())})

    return run


class _Part:
    """Some rows of Vectors."""

    def __init__(self, whole: Vectors, of: np.ndarray):
        self.v, self.most, self.norm, self.levels = whole.v[of], whole.most, whole.norm[of], [(m[of], s[of]) for m, s in whole.levels]


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """One numbering for the values of all columns."""
    code: dict = {}
    return [np.array([code.setdefault(x, len(code)) for x in c.to_pylist()], np.int64) for c in columns]


def _of_same_label(k: int):
    def searches(a: pa.Table, b: pa.Table):
        la, lb = _codes(a["label"], b["label"])
        ra, rb = a["row"].to_numpy(), b["row"].to_numpy()
        for label in np.intersect1d(la, lb):
            of = np.flatnonzero(la == label), np.flatnonzero(lb == label)
            free = np.full((len(of[0]), 1), np.inf)
            yield of, ra[of[0]][:, None] != rb[of[1]], -free, free, k

    return searches


def _of_other_labels(k: int, low: int, high: int):
    def searches(a: pa.Table, b: pa.Table):
        la, lb = _codes(a["label"], b["label"])
        held = a["scores"].to_pylist()
        least, most = (np.full((len(held), max(map(len, held), default=0)), np.nan) for _ in range(2))
        for i, scores in enumerate(held):  # low*p <= 100*n <= high*p in integers
            least[i, : len(scores)] = [-(-low * p // 100) for p in scores]
            most[i, : len(scores)] = [high * p // 100 for p in scores]
        yield (np.arange(len(la)), np.arange(len(lb))), la[:, None] != lb, least, most, k

    return searches


def _tiled(anchors: DataFrame, rows: DataFrame, searches, rows_in_tile: int, anchors_in_tile: int) -> DataFrame:
    """Each anchor with each row, in tiles dealt by hashes: no tile grows with a label, an id or the corpus."""
    groups = max(1, -(-rows.count() // rows_in_tile))
    blocks = max(1, -(-anchors.count() // anchors_in_tile))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    n = min(2 * groups * blocks, 1 << 20)
    a = anchors.withColumn("block", deal(blocks)).withColumn("group", every(groups)).repartition(n, "block", "group")
    b = rows.withColumn("group", deal(groups)).withColumn("block", every(blocks)).repartition(n, "block", "group")
    kind = rows.schema["id"].dataType.simpleString()
    a, b = a.toDF(*a.columns), b.toDF(*b.columns)  # columns of their own where both come from one table
    return a.groupBy("block", "group").cogroup(b.groupBy("block", "group")).applyInArrow(_tile(searches), f"anchor long, search int, row long, row_id {kind}, score long")


def _first(df: DataFrame, k: int, *by: str) -> DataFrame:
    """The k first of each group by score, then id; all but k of each task go before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("row_id").asc_nulls_last(), "row")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256, rows_in_tile: int = ROWS, anchors_in_tile: int = ANCHORS) -> DataFrame:
    """For each anchor and each of its `positives` first other rows of the same label, the `negatives` first rows of another label that score from low to
    high per cent of the positive's score: anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    Tiles of bounded numbers of anchors and rows are joined by number; each gives at most `positives` (then `negatives`) rows an anchor (and positive), and
    a window of those picks the first. Ties go to the smaller id. Nothing is broadcast and nothing but two counts comes to the driver.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")).where("label is not null")
    rows = written(quantised(rows, "vector", scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors, corpus = rows.where("anchor").drop("anchor"), rows.drop("anchor")
    near = _first(_tiled(anchors, corpus, _of_same_label(positives), rows_in_tile, anchors_in_tile), positives, "anchor")
    near = written(near.select("anchor", (F.col("rank") - 1).cast("int").alias("search"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("search", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = anchors.join(scores, anchors["row"] == scores["anchor"]).drop("anchor")
    found = _tiled(written(asked, "anchors"), corpus, _of_other_labels(negatives, low, high), rows_in_tile, anchors_in_tile)
    found = _first(found, negatives, "anchor", "search").select("anchor", "search", "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(near, ["anchor", "search"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", (F.col("search") + 1).alias("positive_rank"), F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", wrong), F.col("vec_id") % 100 == 0).drop("positive_rank")


#: op11: all anchors against all rows, scored whole.
ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""
