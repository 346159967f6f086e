"""Prefix trie of rebuilt conversations by whole-sequence collapse: equal conversations become one weighted sequence with its list of ends, an anti-join
tells the sequences that go on in others from the leaves, and sums over weighted prefixes give the nodes.

Turns are ordered by turn, nulls first, and equal turn numbers by a hash of role and text, so that repeated rows and ties have one order. Null role and text
are empty. Rows without a conv_id belong to no conversation. A prefix is known by its depth and by the running sums of four 32-bit words of a hash of each
turn and its place, which scan in blocks: neither a long conversation nor a text is ever held whole. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans
from .common import key_runs, table, values, written

WORDS = ["s1", "s2", "s3", "s4"]
KEY = ["depth", *WORDS]
PARENT = ["p_depth", "p1", "p2", "p3", "p4"]
#: Ids of one piece of an end list.
PIECE = 20_000


def _words(of: Column, prefix: str) -> list[Column]:
    """Four 32-bit words of a SHA-256 in hex."""
    return [F.conv(F.substring(of, 8 * k + 1, 8), 16, 10).cast("long").alias(f"{prefix}{k + 1}") for k in range(4)]


def rebuilt(conversations: DataFrame, head: Column, source: Column) -> DataFrame:
    """Turns of each conversation anew: the first `head` turns of conversation `source`, then its own after the first `head`.

    conv_id, depth (from 1), t1 to t4 (the turn and its place, hashed), bytes (of the text) and block, and a row of depth 0 for each conversation. head, at
    most some ten, and source are expressions of conv_id.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    hashed = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", hashed.alias("hash"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("hash").asc()]
    ranked = written(scans.running(scans.blocks(turns, ["conv_id"], order), ["conv_id"], order, nth=F.lit(1)).drop("turn"), "turns")
    size = ranked.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = size.select("conv_id", head.cast("int").alias("head"), source.alias("source"))
    convs = written(convs.join(size.select(F.col("conv_id").alias("source"), F.col("size").alias("there")), "source", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))).cast("long")).drop("there"), "conversations")
    own = ranked.join(convs.select("conv_id", "head", "taken"), "conv_id").where("nth > head").select("conv_id", (F.col("nth") - F.col("head") + F.col("taken")).alias("depth"), "hash", "bytes", "block")
    most = convs.agg(F.max("taken")).first()[0] or 0
    first = ranked.where(F.col("nth") <= most).select(F.col("conv_id").alias("source"), F.col("nth").alias("depth"), "hash", "bytes")
    taken = convs.select("conv_id", "source", "taken").join(first, "source").where("depth <= taken").select("conv_id", "depth", "hash", "bytes", F.lit(-1).alias("block"))
    rows = own.unionByName(taken).select("conv_id", "depth", *_words(F.sha2(F.concat_ws(":", "depth", "hash"), 256), "t"), "bytes", "block")
    none = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(f"t{k}") for k in (1, 2, 3, 4)], F.lit(0).cast("long").alias("bytes"), F.lit(-1).alias("block"))
    return written(rows.unionByName(none), "rebuilt")


def ends(found: DataFrame) -> DataFrame:
    """KEY and the SHA-256 of the ascending, comma-joined conv_ids of each key: ids go to tasks by ranges, so a long list is cut, and its pieces then stream
    through one hash in order."""

    def joined(batches):
        for tab in key_runs(batches, KEY, PIECE):
            keys, ids = tab.select(KEY).to_pydict(), tab["conv_id"].to_pylist()
            same = list(zip(*keys.values(), strict=True))
            at = [k for k in range(len(ids)) if not k or same[k] != same[k - 1]] + [len(ids)]
            cut = sorted({*at, *(x for lo, hi in zip(at, at[1:]) for x in range(lo, hi, PIECE))})
            cols = [pa.array([keys[c][lo] for lo in cut[:-1]], pa.int64()) for c in KEY]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([ids[lo] for lo in cut[:-1]], pa.int64()), pa.array([",".join(map(str, ids[lo:hi])) for lo, hi in zip(cut, cut[1:])])], names=[*KEY, "first_id", "ids"])

    def hashed(batches):
        now, digest = None, None
        out: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([*(pa.array([x[0][k] for x in out], pa.int64()) for k in range(len(KEY))), pa.array([x[1] for x in out])], names=[*KEY, "ends_sha256"])

        for b in batches:
            for key, ids in zip(zip(*(values(b, c).to_pylist() for c in KEY), strict=True), values(b, "ids"), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            if len(out) >= 10_000:
                yield batch()
                out = []
        if now is not None:
            out.append((now, digest.hexdigest()))
            yield batch()

    kinds = ", ".join(f"{c} long" for c in KEY)
    pieces = found.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(joined, f"{kinds}, first_id long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first_id").mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of rebuilt() conversations, as op13 returns them.

    Subtree sums come without walking levels: each node belongs to the least leaf beneath it, sums run along each leaf's path over the nodes that are its
    own, and what lies beneath a node is the rest of the path from there on, added up over its leaves.
    """
    path = written(scans.running(rows, ["conv_id"], ["depth"], **{s: F.col(f"t{k + 1}") for k, s in enumerate(WORDS)}), "paths")
    last = path.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end")).select("conv_id", "end.*")
    sequences = written(last.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")), "sequences")
    mine = sequences.select("conv_id", "weight", F.col("depth").alias("size"))
    up = [F.when(F.col("depth") > 0, F.col("depth") - 1).alias("p_depth"), *[(F.col(s) - F.col(f"t{k + 1}")).alias(f"p{k + 1}") for k, s in enumerate(WORDS)]]
    prefixes = written(path.join(mine, "conv_id").select("conv_id", "weight", "size", *KEY, *up, "bytes", "block"), "prefixes")
    inner = prefixes.where("depth < size").groupBy(*KEY).agg(F.count("*").alias("on")).drop("on")
    leaves = written(sequences.join(inner, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf")), "leaves")
    marked = prefixes.join(leaves, "conv_id", "left")
    nodes = marked.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"), F.min("bytes").alias("bytes"), *[F.min(p).alias(p) for p in PARENT]
    )
    nodes = written(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    along = prefixes.join(leaves.select("conv_id"), "conv_id").select("conv_id", *KEY, "block").join(nodes.select(*KEY, "owner", "own"), KEY)
    along = along.withColumn("own", F.when(F.col("owner") == F.col("conv_id"), F.col("own")).otherwise(0))
    along = written(along.drop("owner"), "leaf-paths")
    total = along.groupBy("conv_id").agg(F.sum("own").alias("total"))
    beneath = scans.running(along, ["conv_id"], ["depth"], upto=F.col("own")).join(total, "conv_id")
    saved = beneath.groupBy(*KEY).agg(F.sum(F.col("total") - F.col("upto") + F.col("own")).alias("saved_tokens"))
    children = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("n_children"))
    parents = nodes.select(*[F.col(k).alias(p) for k, p in zip(KEY, PARENT, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(saved, KEY).join(children.toDF(*KEY, "n_children"), KEY, "left").join(parents, PARENT, "left").join(ends(last), KEY, "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    return trie(rebuilt(table(spark, sf_dir, "conversations"), head, F.col("conv_id") - F.col("conv_id") % 5))


#: op13: every prefix of every conversation as a list; subtrees by comparing lists.
ORACLE = """
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t.role, t.text) AS l FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, l, conv_id - conv_id % 5 AS source,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295) % 9 AS h
  FROM whole),
built AS (
  SELECT a.conv_id, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS l FROM heads a LEFT JOIN whole b ON b.conv_id = a.source),
prefixes AS (SELECT conv_id, l[1:d] AS p, d, d = len(l) AS ends FROM built, unnest(range(0, len(l) + 1)) AS r(d)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
sized AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.p[1:n.d] = n.p) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(p[d].text) END AS own FROM nodes n),
beneath AS (
  SELECT a.p, a.d, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.own)::BIGINT AS saved_tokens FROM sized a JOIN sized b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.p, a.d)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM sized n JOIN beneath b ON b.d = n.d AND b.p = n.p LEFT JOIN sized u ON u.d = n.d - 1 AND u.p = n.p[1:u.d]
"""
