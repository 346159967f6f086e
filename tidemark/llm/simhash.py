"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming budget by a binary-trie self-join.

Nulls are empty texts; an empty text has fingerprint zero and links like any other; equal texts have equal fingerprints; extra columns are ignored.
Null ids take part, and are never a component's smallest id while it has another. Texts of any length are read whole, bits of very many shingles a part at
a time; a bit that half of the shingles have is 0; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffers, clean_text, key_runs, mix, pieces, shingles, table, values, written
from .components import components

BITS, SEED = 64, 42


def fingerprint(text: bytes, n: int = 4) -> int:
    """SimHash of lower-cased n-word shingles, repeats included, by XXH64: a bit is 1 if set in over half of them."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))  # one past the space that follows
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    if len(words) < n:
        raw = digest(joined, SEED)
    else:
        raw = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[n - 1 :], strict=False)])
    hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a text of any length takes 4 MB of bits at a time
        total += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            texts = values(b, "text").cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([values(b, id_col), pa.array(fps)], names=[id_col, "fp"])

    return clean_text(docs, id_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, fp long")


# --- trie self-join -----------------------------------------------------------------------------------------------------------


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def trie_pairs(key: np.ndarray, fp: np.ndarray, budget: int, cap: int = 1 << 15):
    """Pairs of places (a, b) of distinct (key, fp), sorted by both, that connect exactly the fingerprints of one key within `budget` bits; a piece at a time.

    Each key's fingerprints are a binary trie: a node is a range that shares leading bits. Pairs of nodes go down together, one bit a level,
    for all keys at once; unlike branches cost one bit of the budget, and a pair over budget goes no further. A pair whose remaining bits fit what
    is left of the budget links whole, each of its fingerprints with the first, without going on; a pair of a few fingerprints is compared at once.
    """
    n = len(fp)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if n else np.zeros(1, int)
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    ones = {}

    def split(lo, hi, bit):
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        return hi - (ones[bit][hi] - ones[bit][lo])

    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        bit, al, ah, bl, bh, d = stack.pop()
        if not len(al):
            continue
        if len(al) > cap:
            half = len(al) // 2
            stack += [(bit, al[:half], ah[:half], bl[:half], bh[:half], d[:half]), (bit, al[half:], ah[half:], bl[half:], bh[half:], d[half:])]
            continue
        whole = budget - d >= bit + 1  # remaining bits can't exceed the budget
        if whole.any():
            for x, y in ((al, ah), (bl, bh)):
                size = (y - x)[whole]
                to = np.repeat(al[whole], size)
                at = np.repeat(x[whole] - np.cumsum(size) + size, size) + np.arange(size.sum())
                yield at, to
        few = ~whole & ((ah - al) * (bh - bl) <= 16)
        if few.any():
            w = (bh - bl)[few]
            size = (ah - al)[few] * w
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            w = np.repeat(w, size)
            i, j = np.repeat(al[few], size) + k // w, np.repeat(bl[few], size) + k % w
            near = np.bitwise_count(fp[i] ^ fp[j]) <= budget
            yield i[near], j[near]
        go = ~(whole | few)
        al, ah, bl, bh, d = al[go], ah[go], bl[go], bh[go], d[go]
        am, bm = split(al, ah, bit), split(bl, bh, bit)
        same = (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, d, None), (am, ah, bm, bh, d, None), (al, am, bm, bh, d + 1, None), (am, ah, bl, bm, d + 1, ~same)]
        nxt = []
        for pl, ph, ql, qh, e, only in parts:
            ok = (ph > pl) & (qh > ql) & (e <= budget)
            if only is not None:
                ok &= only
            one = (pl == ql) & (ph == qh) & (ph - pl == 1)  # a single fingerprint with itself
            ok &= ~one
            nxt.append([x[ok] for x in (pl, ph, ql, qh, e)])
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*nxt, strict=True))))


def _distinct(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, fp) in order, and where each row's stands."""
    order = np.lexsort((fp, key))
    k, f = key[order], fp[order]
    new = np.ones(len(f), bool)
    new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
    at = np.empty(len(f), np.int64)
    at[order] = np.cumsum(new) - 1
    return k[new], f[new], at


def trie_links(key: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, root) that connect exactly the fingerprints of one key within `budget` bits, as a forest over the rows' fingerprints."""
    key, fp, _ = _distinct(key, fp)
    found = list(trie_pairs(key, fp, budget))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    own, at = np.unique(fp, return_inverse=True)
    a, b = at[a], at[b]
    real = a != b
    label = _labels(len(own), a[real], b[real])
    moved = np.flatnonzero(label != np.arange(len(own)))
    return own[moved], own[label[moved]]


def trie_neighbours(key: np.ndarray, fp: np.ndarray, budget: int, few: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one key within `budget` bits, by their fingerprints' first rows: all of a fingerprint that has at most `few` others near, and the
    nearest and the first of one that has more, as in large groups of copies; and each row with the first of its own fingerprint. Third: the keys some of
    whose pairs are not among these."""
    key, fp, at = _distinct(key, fp)
    first = np.full(len(fp), len(at))
    np.minimum.at(first, at, np.arange(len(at)))
    none = np.iinfo(np.int64).max
    near, low = np.full(len(fp), none), np.full(len(fp), none)
    degree = np.zeros(len(fp), np.int64)
    for a, b in trie_pairs(key, fp, budget):
        real = a != b
        a, b = a[real], b[real]
        degree += np.bincount(a, minlength=len(fp)) + np.bincount(b, minlength=len(fp))
        d = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64) << 40
        for x, y in ((a, b), (b, a)):
            np.minimum.at(near, x, d | y)
            np.minimum.at(low, x, y)
    u, v, capped = [np.arange(len(at))], [first[at]], [np.zeros(0, key.dtype)]
    if len(at) > len(fp):  # rows of one fingerprint meet its first only
        capped.append(np.unique(key[np.bincount(at, minlength=len(fp)) > 2]))
    for best in (near & ((1 << 40) - 1), low):
        has = np.flatnonzero(low != none)
        u.append(first[has])
        v.append(first[best[has]])
    for a, b in trie_pairs(key, fp, budget):
        real, within = a != b, np.minimum(degree[a], degree[b]) <= few
        u.append(first[a[real & within]])
        v.append(first[b[real & within]])
        capped.append(np.unique(key[a[real & ~within]]))
    u, v = np.concatenate(u), np.concatenate(v)
    return u[u != v], v[u != v], np.unique(np.concatenate(capped))


def _block(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of `parts` blocks of the lowest `bits` bits."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(fp, at: int, width: int):
    """`width` bits of a 64-bit column from bit `at` on, cyclic."""
    turned = F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, BITS - at)) if at else fp
    return turned.bitwiseAND(F.lit((1 << width) - 1))


def linked(fps: DataFrame, budget: int = 4, hot: int = 1500) -> DataFrame:
    """(u, v) forest over the distinct fingerprints `fps` (fp long) that lie within `budget` bits of each other.

    With budget + 1 blocks, two linked fingerprints agree in one block at least, so each fingerprint goes to one shard per block. A shard of more than
    `hot` fingerprints is dealt out again by budget + 1 blocks of its remaining bits: exact again, as linked fingerprints must agree in one of these too.
    Shards hold distinct fingerprints only, so copies add nothing; what a shard emits is a forest, at most one row a fingerprint.
    """
    parts = budget + 1
    blocks = _block(BITS, parts)
    rows = fps.select("fp", F.posexplode(F.array(*[_bits(F.col("fp"), at, width) for at, width in blocks])).alias("b", "v"))
    rows = rows.select("fp", "b", F.xxhash64("b", "v").alias("k"))
    size = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k", F.lit(True).alias("is_hot"))
    rows = written(rows.join(size, "k", "left"), "shards")
    again = None
    for b, (at, width) in enumerate(blocks):
        sub = [_bits(F.col("fp"), (at + width + x) % BITS, w) for x, w in _block(BITS - width, parts)]
        keys = F.array(*[F.xxhash64("k", F.lit(i), v) for i, v in enumerate(sub)])
        part = rows.where(F.col("is_hot") & (F.col("b") == b)).select("fp", F.explode(keys).alias("k"))
        again = part if again is None else again.unionByName(part)
    shards = rows.where("is_hot is null").select("fp", "k").unionByName(again)

    def run(batches):
        for tab in key_runs(batches, ["k"]):
            x, root = trie_links(tab["k"].to_numpy(), tab["fp"].to_numpy().view(np.uint64), budget)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(root.view(np.int64))], names=["u", "v"])

    return shards.repartition("k").sortWithinPartitions("k").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", shingle: int = 4, budget: int = 4) -> DataFrame:
    """(id, fp, component): component is the smallest id that is reachable over links of at most `budget` differing bits, itself included."""
    own = written(fingerprints(docs, id_col, shingle), "simhash")
    reps = own.groupBy("fp").agg(F.min(id_col).alias("rep"))
    roots = components(linked(reps.select("fp"), budget)).select(F.col("node").alias("fp"), "root")
    named = reps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = written(named.join(least, "root").select("fp", "component"), "classes")
    return own.join(named, "fp", "left").select(id_col, "fp", "component")


# --- documents of like shingle sets ---------------------------------------------------------------------------------------------

_KEYS = 8
#: Bins of the signature that estimates a pair's similarity, a byte each; 0 is an empty bin.
_BINS = 256
_SEEDS = mix(np.arange(101, 101 + _KEYS, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of each row's distinct n-word shingles, A-Z lower-cased, by row."""
    w = Words(data, offs, lower=True)
    h, row = shingles(w, w.hashes(), n)
    order = np.argsort(h, kind="stable")
    again = order[1:][(h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])]
    keep = np.ones(len(h), bool)
    keep[again] = False
    return h[keep], row[keep]


def sketched(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash of each row's set of shingles, the least shingle under each of eight orders, and a signature: of each of 256 bins of shingles a byte of the
    least. Rows without words have zeroes."""
    h, row = shingle_sets(data, offs, n)
    rows = len(offs) - 1
    count = np.bincount(row, minlength=rows)
    have = np.flatnonzero(count)
    begin = (np.cumsum(count) - count)[have]
    total = np.zeros((rows, BITS), np.int64)
    for at in range(0, len(h), 1 << 16):  # a text of any length takes 4 MB of bits at a time
        r = row[at : at + (1 << 16)]
        cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        bits = np.unpackbits(mix(h[at : at + (1 << 16)]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total[r[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    fp = np.packbits(2 * total > count[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)
    keys = np.zeros((rows, _KEYS), np.uint64)
    for k, seed in enumerate(_SEEDS):
        if len(have):
            keys[have, k] = np.minimum.reduceat(mix(h ^ seed), begin)
    dealt = mix(h ^ np.uint64(0x5EED))
    none = np.iinfo(np.uint64).max
    least = np.full(rows * _BINS, none, np.uint64)
    np.minimum.at(least, row * _BINS + (dealt >> np.uint64(56)).astype(np.int64), dealt & np.uint64((1 << 56) - 1))
    signature = np.where(least == none, 0, 1 + least % np.uint64(255)).astype(np.uint8).reshape(rows, _BINS)
    return fp, keys, signature


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of two arrays of signatures: the estimated share of shingles in common, and whether it lies within four deviations of the similarity or above."""
    some = np.maximum(((a | b) > 0).sum(axis=1), 1)
    share = ((a == b) & (a > 0)).sum(axis=1) / some
    return share, share >= similarity - 4 * np.sqrt(similarity * (1 - similarity) / some)


def jaccard(data: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """Of rows 0 and 1, 2 and 3 and so on: the share of their shingles that both have; 1 where neither has any."""
    h, row = shingle_sets(data, offs, n)
    pair = row >> 1
    order = np.argsort(h, kind="stable")
    both = np.bincount(pair[order[1:]][(h[order[1:]] == h[order[:-1]]) & (pair[order[1:]] == pair[order[:-1]])], minlength=(len(offs) - 1) // 2)
    every = np.bincount(pair, minlength=(len(offs) - 1) // 2) - both
    return np.where(every > 0, both / np.maximum(every, 1), 1.0)


def candidates(own: DataFrame, budget: int, hot: int = 600) -> tuple[DataFrame, DataFrame]:
    """Of `own` (h, fp, keys): (u, v) pairs that share a least shingle and differ in at most `budget` bits, but of what has very many in a shard only the nearest
    and the first; and (h, k, i, j), the members of all shards that have further such pairs, with the numbers of the shard's least shingles (j: -1 for one).

    Shards are documents with one least shingle in common. One of more than `hot` documents, by a shingle that many texts have, is dealt again by each of
    the later least shingles (two documents that share an earlier one meet there). What is hot even so are copies of one text, mostly: these are cut by
    chance, alike in all shards, and each part gets the shard's first document.
    """
    rows = own.select("h", "fp", F.posexplode("keys").alias("i", "key")).select("h", "fp", "i", F.xxhash64("i", "key").alias("k"))
    sized = lambda df: df.groupBy("k").agg(F.count("*").alias("n"), F.min("h").alias("first"), F.min_by("fp", "h").alias("first_fp")).where("n > 1").select("k", "n", "first", "first_fp")
    one = written(rows.join(sized(rows).hint("merge"), "k"), "shards")
    again = one.where(F.col("n") > hot).select("h", "fp", "k", "i").join(own.select("h", "keys"), "h")
    again = again.select("h", "fp", "k", "i", F.posexplode("keys").alias("j", "other")).where("j > i").select("h", "fp", "i", "j", F.xxhash64("k", "j", "other").alias("k"))
    two = written(again.join(sized(again).hint("merge"), "k"), "shards")
    part = F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / hot))
    cut = two.where(F.col("n") > hot)
    firsts = cut.where("h = first").groupBy("k", "first", "first_fp").agg(F.max("n").alias("n")).select(F.col("first").alias("h"), F.col("first_fp").alias("fp"), "k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / hot) - 1)).alias("part"))
    pieces_ = cut.select("h", "fp", "k", part.alias("part")).unionByName(firsts).select("h", "fp", F.xxhash64("k", "part").alias("k"))
    whole = one.where(F.col("n") <= hot).select("h", "fp", "k", "i", F.lit(-1).alias("j")).unionByName(two.where(F.col("n") <= hot).select("h", "fp", "k", "i", "j"))

    def run(batches):
        for tab in key_runs(batches, ["k"]):
            h = tab["h"].to_numpy()
            u, v, capped = trie_neighbours(tab["k"].to_numpy(), tab["fp"].to_numpy().view(np.uint64), budget)
            none = pa.nulls(len(capped), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(h[u], h[v])), pa.array(np.maximum(h[u], h[v])), pa.nulls(len(u), pa.int64())], names=["u", "v", "k"])
            yield pa.RecordBatch.from_arrays([none, none, pa.array(capped)], names=["u", "v", "k"])

    found = written(whole.select("h", "fp", "k").unionByName(pieces_).repartition("k").sortWithinPartitions("k").mapInArrow(run, "u long, v long, k long").distinct(), "neighbours")
    open_ = found.where("k is not null").select("k")
    members = whole.select("h", "k", "i", "j").join(open_, "k", "left_semi").unionByName(cut.select("h", "k", "i", "j"))
    return found.where("u <> v").select("u", "v"), members


def _first_two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of two arrays of least shingles: the numbers of the first and the second that are equal, or as many as there are."""
    same = np.hstack([a == b, np.ones((len(a), 2), bool)])
    first = same.argmax(axis=1)
    same[np.arange(len(a)), first] = False
    return first, same.argmax(axis=1)


def in_tiles(members: DataFrame, columns: DataFrame, classes: DataFrame, work, schema: str, tile: int, weight: str | None = None, most: int = 1 << 23) -> DataFrame:
    """What `work` gives for each tile of the shards of `members` (h, k, i, j) that hold more than one class (h, class; none: a class of its own).

    A shard is dealt by chance into parts of about `tile` documents (and `most` of `weight`), and each part meets each other in a tile of its own, so memory
    is bounded and a document is sent to as many tiles as its shard has parts. Tiles are tables with `columns` (h, ...), class, i, j, k, side (0, and 1 for the
    second part of a tile of `two`).
    """
    known = members.join(classes, "h", "left").withColumn("class", F.coalesce("class", "h"))
    known = known.join(columns.select("h", F.col(weight).alias("__weight")), "h") if weight else known
    heavy = F.ceil(F.sum("__weight") / most) if weight else F.lit(1)
    size = known.groupBy("k").agg(F.greatest(F.ceil(F.count("*") / tile), heavy).alias("parts"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("k", "parts")
    split = known.join(size, "k").withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")))
    tiles = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiles = tiles.withColumns({"t": F.xxhash64("k", F.least("part", "other"), F.greatest("part", "other")), "side": (F.col("part") > F.col("other")).cast("int"), "two": F.col("part") != F.col("other")}).drop("part", "other", "parts").join(columns, "h")

    def run(batches):
        for tab in key_runs(batches, ["t"], 2 * tile):
            t = tab["t"].to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True])))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield from work(tab.slice(lo, hi - lo))

    return tiles.repartition("t").sortWithinPartitions("t").mapInArrow(run, schema)


def open_pairs(tab: pa.Table, budget: int, similarity: float):
    """Places (a, b) of a tile's pairs of different classes that differ in at most `budget` bits and whose signatures allow the similarity, the likeliest of some
    thousand first. A pair that several shards hold is looked at in one, that of its first least shingles, or where this is no open shard, has been compared."""
    fp, cls = tab["fp"].to_numpy().view(np.uint64), tab["class"].to_numpy()
    keys = np.array(tab["keys"].to_pylist(), np.int64).reshape(len(fp), -1)
    signature = np.frombuffer(b"".join(tab["signature"].to_pylist()), np.uint8).reshape(len(fp), _BINS)
    i_, j_, side, two = tab["i"][0].as_py(), tab["j"][0].as_py(), tab["side"].to_numpy(), tab["two"][0].as_py()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(fp)),) * 2
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        near = (np.bitwise_count(fp[i][:, None] ^ fp[right]) <= budget) & (cls[i][:, None] != cls[right])
        if not two:
            near &= i[:, None] < right
        a, b = np.nonzero(near)
        a, b = i[a], right[b]
        for lo in range(0, len(a), 1 << 14):
            x, y = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
            first, second = _first_two(keys[x], keys[y])
            here = (first == i_) & ((second == j_) | (j_ < 0))
            x, y = x[here], y[here]
            share, ok = alike(signature[x], signature[y], similarity)
            order = np.argsort(-share[ok], kind="stable")
            yield x[ok][order], y[ok][order]


def remaining(members: DataFrame, own: DataFrame, plain: DataFrame, classes: DataFrame, budget: int, similarity: float, shingle: int, tile: int = 2048) -> DataFrame:
    """(u, v): links of `similarity` or more between different classes, from all pairs of members of one shard that open_pairs() leaves, compared as they are.

    Tiles of fingerprints and signatures first tell which documents have such a pair at all; only these are sent to tiles with their texts, where pairs are
    compared in place. Within a tile, classes that a link has joined are one, so large groups of copies cost a comparison a document or so. No pair is ever a
    row: what comes out is at most a forest a tile. `plain`: h, text.
    """
    small = own.select("h", "fp", "keys", "signature")

    def asked(tab: pa.Table):
        has = np.zeros(tab.num_rows, bool)
        for a, b in open_pairs(tab, budget, similarity):
            has[a] = has[b] = True
        yield pa.RecordBatch.from_arrays([pa.array(tab["h"].to_numpy()[has]), pa.array(tab["k"].to_numpy()[has])], names=["h", "k"])

    some = written(in_tiles(members, small, classes, asked, "h long, k long", tile).distinct(), "open")
    texts = written(plain.join(some.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"]), "texts-open")

    def compared(tab: pa.Table):
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}
        h, cls = tab["h"].to_numpy(), tab["class"].to_pylist()

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = np.unique(shingle_sets(*buffers(pa.array([tab["text"][k].as_py()], pa.large_string())), shingle)[0])
            return sets[k]

        us, vs = [], []
        for a, b in open_pairs(tab, budget, similarity):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = root(cls[x]), root(cls[y])
                if p != q:
                    m, n = of(x), of(y)
                    both = len(np.intersect1d(m, n, assume_unique=True))
                    if both >= similarity * (len(m) + len(n) - both):
                        parent[p] = q
                        us.append(min(h[x], h[y]))
                        vs.append(max(h[x], h[y]))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    kept = members.join(some, ["h", "k"], "left_semi")
    heavy = texts.withColumn("size", F.octet_length("text")).join(small, "h")
    return in_tiles(kept, heavy, classes, compared, "u long, v long", tile // 4, "size").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8, budget: int = 21) -> DataFrame:
    """(id, text_hash, class) of each document: class is a hash that documents share which links of `similarity` or more join.

    1. Each distinct text's SimHash over its set of word shingles, eight least shingles and a signature.
    2. Candidates by the trie within `budget` bits: at a similarity of 0.8 two SimHashes differ in some ten bits of 64, with a deviation of three.
    3. The shingle sets of each candidate pair are compared as they are; only pairs of the similarity link.
    4. Components of the links.
    5. Shards in which documents had more candidates than were compared, and hot ones that were cut: what is in different classes there is compared after
       all, in place. Copies of one text are one class by then, so little is left but where different texts share most of their words.

    A pair at 0.8 has no least shingle in common once in 400,000 times, and not two once in 12,000, which hot shards ask for; its SimHashes differ in more
    than 21 bits, or its signatures by more than four deviations, once in some ten thousand times. Texts may be of any length and are compared whole; texts
    without words are alike; equal texts are one, and an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def sketch(batches):
        for b in pieces(batches):
            fp, keys, signature = sketched(*buffers(values(b, "text")), shingle)
            raw = signature.tobytes()
            yield pa.RecordBatch.from_arrays([values(b, id_col), values(b, "h"), pa.array(fp.view(np.int64)), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([raw[k : k + _BINS] for k in range(0, len(raw), _BINS)], pa.binary())], names=[id_col, "h", "fp", "keys", "signature"])

    plain = clean_text(docs, id_col).withColumn("h", F.xxhash64("text"))
    own = written(plain.select(id_col, "h", "text").mapInArrow(sketch, f"{id_col} {kind}, h long, fp long, keys array<long>, signature binary"), "sketches")
    reps = written(own.groupBy("h").agg(F.min(id_col).alias("rep"), *[F.first(c).alias(c) for c in ("fp", "keys", "signature")]), "texts")

    def compared(batches):
        for b in pieces(batches, "a"):
            both = pa.array([x for pair in zip(values(b, "a").to_pylist(), values(b, "b").to_pylist(), strict=True) for x in pair], pa.large_string())
            near = pa.array(jaccard(*buffers(both), shingle) >= similarity)
            yield b.select(["u", "v"]).filter(near)

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs whose texts are of the similarity."""
        asked = pairs.select(F.col("u").alias("h")).union(pairs.select(F.col("v").alias("h"))).distinct().join(reps.select("h", "rep"), "h").select("h", "rep")
        texts = plain.join(asked.withColumnRenamed("h", "rep_h").hint("merge"), (F.col("h") == F.col("rep_h")) & F.col(id_col).eqNullSafe(F.col("rep")), "left_semi").select("h", "text").dropDuplicates(["h"])
        texts = written(texts, "texts-asked")
        with_a = pairs.join(texts.select(F.col("h").alias("u"), F.col("text").alias("a")).hint("merge"), "u")
        with_both = with_a.join(texts.select(F.col("h").alias("v"), F.col("text").alias("b")).hint("merge"), "v").select("u", "v", "a", "b")
        return written(with_both.mapInArrow(compared, "u long, v long"), "links")

    classes = lambda edges: written(components(edges).select(F.col("node").alias("h"), F.col("root").alias("class")), "roots")
    pairs, members = candidates(reps, budget)
    found = links(pairs)
    roots = classes(found)
    more = written(remaining(members, reps, plain.select("h", "text"), roots, budget, similarity, shingle), "links")
    if not more.isEmpty():
        roots = classes(found.unionByName(more))
    return own.select(id_col, "h").join(roots, "h", "left").select(id_col, F.col("h").alias("text_hash"), F.coalesce("class", "h").alias("class"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
