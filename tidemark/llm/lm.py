"""Language-model scoring with an Elias-Fano n-gram trie of words, pairs and triples in memory-mapped levels.

Level 1 holds the words: 64-bit hashes, monotone, with exact counts; a word's id is its rank. Level 2 holds each word's successors as one monotone
sequence, with pointers to where each context begins and quantised discounted probabilities; level 3 the same for each pair, whose successors are named by
their rank among the successors of the pair's last word. A context's kept mass is quantised beside its pointer. Levels are files of the shared folder, cut
into ranges of about equal work; they are queried by select and successor search on the coded words, so a task holds none of them.

Nulls are empty texts, which hold the end token only; repeated ids and rows are documents of their own, trained on and scored each; a null id counts
as the text "" in the fold rule; extra columns are ignored; with no training tokens every token is unknown.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffers, clean_text, new_path, pieces, table, values, written
from .ef import EliasFano, encoded, packed, unpacked
from .files import attempt_name, opened

END, START = np.uint64(1), np.uint64(0)  # stand for the end of a text and for what precedes it
DISCOUNT = 0.75
#: Tokens that a task gathers before it looks them up together, and training tokens of a shard of levels 2 and 3.
FLUSH, SHARD = 600_000, 2_000_000


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as log10 in steps of 1/32, from 1 down to 1e-8, as bytes."""
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-9)) * 32), 0, 255).astype(np.uint8)


_RESTORED = 10.0 ** (np.arange(256) / -32)


# --- files ----------------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def mapped(uri: str) -> np.ndarray:
    """A file of the shared folder as a memory map; from another store, a map of one copy for the process that has no name and goes with it."""
    system, at = opened(uri)
    if system.type_name == "local":
        return np.memmap(at, np.uint8, "r")
    with system.open_input_stream(at, compression=None) as source, tempfile.NamedTemporaryFile() as copy:
        while chunk := source.read(8 << 20):
            copy.write(chunk)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r")


def saved(uri: str, *parts: bytes) -> str:
    system, at = opened(uri)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at, compression=None) as out:
        for p in parts:
            out.write(p)
    return uri


def _eights(x: np.ndarray) -> bytes:
    return x.tobytes() + b"\0" * (-len(x) % 8)


@lru_cache(maxsize=4096)
def words_file(uri: str) -> tuple[EliasFano, np.ndarray, int]:
    """Hashes, packed counts and their width."""
    data = mapped(uri)
    hashes = EliasFano(data)
    width, size = (int(v) for v in np.frombuffer(data, "<u8", 2, hashes.end))
    return hashes, np.frombuffer(data, "<u8", size, hashes.end + 16), width


@lru_cache(maxsize=4096)
def level_file(uri: str) -> tuple[EliasFano, EliasFano, np.ndarray, np.ndarray]:
    """Successors by context, pointers to where contexts begin, and bytes of probabilities and kept masses."""
    data = mapped(uri)
    keys = EliasFano(data)
    begins = EliasFano(data, keys.end)
    codes = np.frombuffer(data, np.uint8, keys.n, begins.end)
    return keys, begins, codes, np.frombuffer(data, np.uint8, begins.n - 1, begins.end + keys.n + -keys.n % 8)


# --- the levels as they are queried -----------------------------------------------------------------------------------------------


def runs(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    if not len(group):
        return []
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    return [(int(group[i]), int(i), int(j)) for i, j in zip(cut, cut[1:], strict=False)]


@dataclass
class Level1:
    """Words in files by their hashes' highest bits; base: ids before each file."""

    bits: int
    paths: list[str | None]
    base: np.ndarray
    size: int

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of each token: -1 and 0 where unknown."""
        own, back = np.unique(tokens, return_inverse=True)
        ids, counts = np.full(len(own), -1), np.zeros(len(own), np.int64)
        for part, i, j in runs((own >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(own), np.int64)):
            if self.paths[part] is None:
                continue
            hashes, c, width = words_file(self.paths[part])
            at, hit = hashes.find(own[i:j])
            ids[i:j][hit] = at[hit] + self.base[part]
            counts[i:j][hit] = unpacked(c, at[hit], width).astype(np.int64)
        return ids[back], counts[back]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        for part, i, j in runs(np.searchsorted(self.base, ids, "right") - 1):
            _, c, width = words_file(self.paths[part])
            out[i:j] = unpacked(c, ids[i:j] - self.base[part], width).astype(np.int64)
        return out


@dataclass
class Level:
    """Shards by ranges of (context, successor): `bounds` are their first keys, context * width + successor; `base` counts the entries before each.

    A frequent context may lie in several shards: `shared` has these, with their whole kept masses, and `first` where a shard's first context begins.
    """

    width: int
    bounds: np.ndarray
    paths: list[str | None]
    base: np.ndarray
    first: np.ndarray
    shared: np.ndarray
    masses: np.ndarray

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted (context, successor; -1 for none): the entry's place or -1, its probability or 0, the context's left mass, and where it begins."""
        n = len(context)
        place, prob, left, begin = np.full(n, -1), np.zeros(n), np.ones(n), np.zeros(n, np.int64)
        want = np.maximum(successor, 0)
        for s, i, j in runs(np.searchsorted(self.bounds, context.astype(np.uint64) * np.uint64(self.width) + want.astype(np.uint64), "right") - 1):
            if self.paths[s] is None:
                continue
            keys, begins, codes, kept = level_file(self.paths[s])
            c = context[i:j] - int(self.bounds[s]) // self.width
            inside = c < begins.n - 1
            left[i:j][inside] = _RESTORED[kept[c[inside]]]
            ask = np.flatnonzero(inside & (successor[i:j] >= 0))
            at, hit = keys.find(c[ask].astype(np.uint64) * np.uint64(self.width) + want[i:j][ask].astype(np.uint64))
            ask, at = ask[hit], at[hit]
            place[i:j][ask] = at + self.base[s]
            prob[i:j][ask] = _RESTORED[codes[at]]
            begin[i:j][ask] = np.where(c[ask] == 0, self.first[s], begins.get(c[ask]).astype(np.int64) + self.base[s])
        if len(self.shared):
            at = np.minimum(np.searchsorted(self.shared, context), len(self.shared) - 1)
            same = self.shared[at] == context
            left[same] = self.masses[at[same]]
        return place, prob, left, begin


@dataclass
class Model:
    words: Level1
    tokens: int
    docs: int
    pairs: Level | None = None
    triples: Level | None = None


def tokens_of(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the rows: hashes of lower-cased words, each row ending with END; and the rows' first tokens."""
    w = Words(*buffers(values(piece, "text")), lower=True)
    n = piece.num_rows
    first = w.first + np.arange(n + 1)
    out = np.full(int(first[-1]), END, np.uint64)
    out[np.arange(len(w)) + w.row] = w.hashes() | np.uint64(2)  # never START or END
    return out, first


def gathered(batches):
    """(batches, tokens, first tokens) of about FLUSH tokens at a time, or of one longer text."""
    held, size = [], 0
    for b in pieces(batches):
        tokens, first = tokens_of(b)
        held.append((b, tokens, first))
        size += len(tokens)
        if size >= FLUSH:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    offs = np.cumsum([0, *(len(t) for _, t, _ in held)])
    return [b for b, _, _ in held], np.concatenate([t for _, t, _ in held]), np.append(np.concatenate([f[:-1] + o for (_, _, f), o in zip(held, offs, strict=False)]), offs[-1])


def distinct(a: np.ndarray, b: np.ndarray, width: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) in order, where each given one stands among them, and how often each stands; a < total, 0 <= b < width."""
    if total * width < 1 << 63:
        key, back, count = np.unique(a * width + b, return_inverse=True, return_counts=True)
        return key // width, key % width, back, count
    order = np.lexsort((b, a))  # too wide for one integer
    x, y = a[order], b[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, bool)
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return x[new], y[new], back, np.bincount(back)


def grams(model: Model, tokens: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """By token: id and count; and, where the model has pairs, its pair's place, probability, left mass, rank in its context, and the place of the pair before."""
    ids, counts = model.words.find(tokens)
    v = np.empty(len(ids), np.int64)
    v[1:] = ids[:-1]
    v[first[:-1][first[:-1] < first[1:]]] = model.words.size  # START
    out = {"ids": ids, "counts": counts, "before": v}
    if model.pairs is None:
        return out
    some = np.flatnonzero(v >= 0)
    c, w, back, _ = distinct(v[some], ids[some] + 1, model.words.size + 1, model.words.size + 1)
    place, prob, left, begin = model.pairs.find(c, w - 1)
    at = lambda x, empty: _spread(x[back], some, len(ids), empty)
    out |= {"place": at(place, -1), "p2": at(prob, 0.0), "left2": at(left, 1.0)}
    out["rank"] = np.where(out["place"] >= 0, out["place"] - at(begin, 0), -1)
    out["pair_before"] = np.concatenate(([-1], out["place"][:-1]))
    out["pair_before"][first[:-1]] = -1
    return out


def _spread(x: np.ndarray, at: np.ndarray, n: int, empty) -> np.ndarray:
    out = np.full(n, empty, x.dtype)
    out[at] = x
    return out


# --- counting and writing the levels ----------------------------------------------------------------------------------------------


def _flush(acc: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in acc]), np.concatenate([c for _, c in acc])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def count_words(rows: DataFrame) -> DataFrame:
    """(h, c) of all training tokens: counted in each task first."""

    def run(batches):
        acc, held = [], 0

        def out():
            k, c = _flush(acc)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["h", "c"])

        for b in pieces(batches):
            tokens, _ = tokens_of(b)
            if len(tokens):
                k, c = np.unique(tokens, return_counts=True)
                acc.append((k, c))
                held += len(k)
            if held > 500_000:
                yield out()
                acc, held = [], 0
        if acc:
            yield out()

    return rows.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def write_words(counts: DataFrame, size: int, folder: str) -> Level1:
    """Level 1: one file for each range of hashes, of some 250,000 words."""
    bits = max(0, (size // 250_000).bit_length())

    def run(key: tuple, tab: pa.Table) -> pa.Table:
        h, c = tab["h"].to_numpy().view(np.uint64), tab["c"].to_numpy()
        order = np.argsort(h)
        h, c = h[order], c[order].astype(np.uint64)
        width = int(c.max()).bit_length()
        body = packed(c, width)
        path = saved(f"{folder}/{attempt_name(f'words-{key[0].as_py():06d}', '.ef')}", encoded(h, (1 << 64) - 1), np.array([width, len(body)], "<u8").tobytes(), body.tobytes())
        return pa.table({"part": [key[0].as_py()], "path": [path], "n": pa.array([len(h)], pa.int64())})

    part = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = written(counts.withColumn("part", part).groupBy("part").applyInArrow(run, "part long, path string, n long"), "lm-words").collect()  # one row a file
    paths: list[str | None] = [None] * (1 << bits)
    n = np.zeros(1 << bits, np.int64)
    for r in rows:
        paths[r["part"]], n[r["part"]] = r["path"], r["n"]
    return Level1(bits, paths, np.cumsum(n) - n, int(n.sum()))


def at_mass(t: np.ndarray, ids: np.ndarray, masses: np.ndarray, density: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where on the line of ids a mass t lies: every id has `density`, some have a mass of their own. (id, how far into its mass)."""
    begin = density * ids + np.cumsum(masses) - masses
    i = np.searchsorted(begin, t, "right") - 1
    none = i < 0
    i = np.maximum(i, 0)
    if not len(ids):
        return np.minimum((t / max(density, 1e-300)).astype(np.int64), size - 1), np.zeros(len(t))
    into = np.where(none, 1.0, (t - begin[i]) / np.maximum(masses[i], 1e-300))
    past = np.where(none, t / max(density, 1e-300), ids[i] + (t - begin[i] - masses[i]) / max(density, 1e-300))
    return np.where(into < 1, ids[i], np.clip(past, 0, size - 1).astype(np.int64)), np.where(into < 1, into, 0.0)


def pair_bounds(shards: int, size: int, heavy: np.ndarray, counts: np.ndarray, tokens: int, docs: int, end: int) -> np.ndarray:
    """First keys of shards of about equal numbers of pairs, if words followed each other by chance. Words that aren't heavy are spread evenly, as ids follow
    hashes; a heavy context is cut by its successors."""
    rest = max(0.0, float(tokens - counts.sum())) / max(1, size)
    own = heavy != end
    ids, masses = np.append(heavy[own], size), np.append(counts[own], docs).astype(float)  # contexts: any word but END, and START
    t = np.arange(1, shards) / shards * (rest * size + masses.sum())
    v, into = at_mass(t, ids, masses, rest, size + 1)
    w, _ = at_mass(into * tokens, heavy, counts.astype(float), rest, size)
    return np.unique(np.concatenate(([0], v.astype(np.uint64) * np.uint64(size) + np.where(into > 0, w, 0).astype(np.uint64)))).astype(np.uint64)


def sent(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> pa.RecordBatch:
    """A task's keys and counts, in order of their shards and sorted within, in packed steps."""
    shard, blobs = [], []
    for s, i, j in runs(shards):
        steps = np.diff(keys[i:j], prepend=keys[i])
        k, c = int(steps.max()).bit_length(), int(counts[i:j].max()).bit_length()
        blobs.append(np.array([keys[i], j - i, k, c], "<u8").tobytes() + packed(steps, k).tobytes() + packed(counts[i:j].astype(np.uint64), c).tobytes())
        shard.append(s)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def received(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed counts of a shard's blobs, added up a few at a time."""
    acc: list[tuple[np.ndarray, np.ndarray]] = []
    for x in blobs:
        blob = np.frombuffer(x.as_py(), "<u8")
        base, n, k, c = (int(v) for v in blob[:4])
        at, words = np.arange(n), n * k // 64 + 2
        acc.append((np.cumsum(unpacked(blob[4 : 4 + words], at, k)) + np.uint64(base), unpacked(blob[4 + words :], at, c).astype(np.int64)))
        if len(acc) > 16:
            acc = [_flush(acc)]
    return _flush(acc)


def level_shard(folder: str, name: str, s: int, lo: int, hi: int, width: int, keys: np.ndarray, counts: np.ndarray, mass) -> dict:
    """Writes the shard of contexts lo..hi; `mass` gives how often contexts that have entries stand. What the driver has to know of it."""
    context = (keys // np.uint64(width)).astype(np.int64)
    n1 = np.bincount(context - lo, minlength=hi - lo + 1)
    begins = np.concatenate(([0], np.cumsum(n1)))
    have = np.flatnonzero(n1)
    total = np.ones(hi - lo + 1)
    total[have] = mass(have + lo, np.add.reduceat(counts, begins[have]) if len(have) else counts)
    prob = quantise((counts - DISCOUNT) / total[context - lo])
    kept = quantise(np.where(n1 > 0, DISCOUNT * n1 / total, 1.0))
    path = saved(f"{folder}/{attempt_name(f'{name}-{s:06d}', '.ef')}", encoded(keys - np.uint64(lo) * np.uint64(width), (hi - lo + 1) * width), encoded(begins.astype(np.uint64), len(keys) + 1), _eights(prob), _eights(kept))
    weight = np.cumsum(counts.astype(float) ** 0.85)  # about how many distinct successors an entry has
    cuts = np.searchsorted(weight, np.arange(1, 65) / 64 * weight[-1]) if len(keys) else np.zeros(64, np.int64)
    return {"shard": s, "path": path, "n": len(keys), "first_n1": int(n1[0]), "last_n1": int(n1[-1]), "last_begin": int(begins[-2]), "most": int(n1.max()), "weight": float(weight[-1]) if len(keys) else 0.0, "cuts": cuts.tolist()}


_SHARD = "shard long, path string, n long, first_n1 long, last_n1 long, last_begin long, most long, weight double, cuts array<long>"
_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n", pa.int64()), ("first_n1", pa.int64()), ("last_n1", pa.int64()), ("last_begin", pa.int64()), ("most", pa.int64()), ("weight", pa.float64()), ("cuts", pa.list_(pa.int64()))])


def level_of(rows: list, bounds: np.ndarray, width: int, last: int, mass) -> tuple[Level, int, np.ndarray, np.ndarray]:
    """The level of written shards; the largest number of successors of a context; and places with the weight before them. `mass`: of shared contexts."""
    k = len(bounds)
    by = {r["shard"]: r for r in rows}
    n = np.array([by[s]["n"] if s in by else 0 for s in range(k)], np.int64)
    base, first = np.cumsum(n) - n, np.zeros(k, np.int64)
    most, shared, seen, xs, ys, weight = 1, {}, 0, [0], [0.0], 0.0
    for s in range(k):
        r = by.get(s)
        lo = int(bounds[s]) // width
        hi = (int(bounds[s + 1]) - 1) // width if s + 1 < k else last
        inner = int(bounds[s]) % width > 0  # this shard goes on with the context of the one before
        first[s] = seen if inner else base[s]
        seen = first[s] if lo == hi else base[s] + (r["last_begin"] if r else 0)
        if inner:
            shared[lo] = shared.get(lo, 0) + (r["first_n1"] if r else 0)
        if s + 1 < k and int(bounds[s + 1]) % width > 0 and not (inner and lo == hi):
            shared[hi] = shared.get(hi, 0) + (r["last_n1"] if r else 0)
        if r:
            most = max(most, r["most"])
            xs += [int(base[s]) + c for c in r["cuts"]]
            ys += [weight + r["weight"] * (i + 1) / 64 for i in range(64)]
            weight += r["weight"]
    ids = np.array(sorted(shared), np.int64)
    n1 = np.array([shared[v] for v in ids.tolist()], np.int64)
    masses = _RESTORED[quantise(np.where(n1 > 0, DISCOUNT * n1 / np.maximum(mass(ids), 1), 1.0))] if len(ids) else np.zeros(0)  # as in the files
    return Level(width, bounds, [by[s]["path"] if s in by else None for s in range(k)], base, first, ids, masses), max([most, *n1.tolist()]), np.array(xs), np.array(ys)


def write_pairs(rows: DataFrame, model: Model, bounds: np.ndarray, folder: str) -> tuple[Level, int, np.ndarray, np.ndarray]:
    """Level 2. Tasks send each shard the pairs they counted, a few bytes each; a shard is written by one task."""
    size, docs = model.words.size, model.docs

    def mass(ids: np.ndarray, _=None) -> np.ndarray:
        out = np.full(len(ids), docs, np.int64)
        known = ids < size
        out[known] = model.words.counts(ids[known])
        return out

    def send(batches):
        for _, tokens, first in gathered(batches):
            g = grams(model, tokens, first)
            v, w, _, count = distinct(g["before"], g["ids"], size, size + 1)
            keys = v.astype(np.uint64) * np.uint64(size) + w.astype(np.uint64)
            yield sent(keys, count, np.searchsorted(bounds, keys, "right") - 1)

    def merge(key: tuple, tab: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys, counts = received(tab["blob"])
        hi = (int(bounds[s + 1]) - 1) // size if s + 1 < len(bounds) else size
        return pa.Table.from_pylist([level_shard(folder, "pairs", s, int(bounds[s]) // size, hi, size, keys, counts, mass)], _SHARD_ARROW)

    got = written(rows.mapInArrow(send, "shard long, blob binary").groupBy("shard").applyInArrow(merge, _SHARD), "lm-pairs").collect()  # one row a file
    return level_of(got, bounds, size, size, mass)


def write_triples(rows: DataFrame, model: Model, bounds: np.ndarray, width: int, pairs: int, folder: str) -> Level:
    """Level 3, whose contexts are the places of pairs and lie in one shard each. `bounds` are places; keys are relative to their shard."""

    def send(batches):
        for _, tokens, first in gathered(batches):
            g = grams(model, tokens, first)
            some = g["pair_before"] >= 0
            p, r, _, count = distinct(g["pair_before"][some], g["rank"][some], width, pairs)
            shard = np.searchsorted(bounds, p, "right") - 1
            local = (p - bounds[shard]).astype(np.uint64) * np.uint64(width) + r.astype(np.uint64)
            yield sent(local, count, shard)

    def merge(key: tuple, tab: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys, counts = received(tab["blob"])
        hi = int(bounds[s + 1]) if s + 1 < len(bounds) else pairs
        return pa.Table.from_pylist([level_shard(folder, "triples", s, 0, hi - int(bounds[s]) - 1, width, keys, counts, lambda _, total: total)], _SHARD_ARROW)

    got = written(rows.mapInArrow(send, "shard long, blob binary").groupBy("shard").applyInArrow(merge, _SHARD), "lm-triples").collect()  # one row a file
    by = {r["shard"]: r["path"] for r in got}
    none = np.zeros(len(bounds), np.int64)
    return Level(width, bounds.astype(np.uint64) * np.uint64(width), [by.get(s) for s in range(len(bounds))], none, none, none[:0], np.zeros(0))


# --- scoring ------------------------------------------------------------------------------------------------------------------


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """docs' rows with their tokens, known tokens, and both scores: unigram, and the interpolated trie.

    p(w | u v) = discounted(u v, w) + left(u v) * p(w | v), and so on down to the unigram; left is the mass that a context's discounts leave. A task looks up
    the distinct words, pairs and triples of some hundred thousand tokens at a time.
    """
    known, n = model.words.size, model.tokens

    def run(batches):
        for rows, tokens, first in gathered(batches):
            g = grams(model, tokens, first)
            uni = np.log10(g["counts"] + 0.1) - np.log10(n + 0.1 * (known + 1))
            p = 10.0**uni
            if model.pairs is not None:
                p = g["p2"] + g["left2"] * p
            if model.triples is not None:
                some = np.flatnonzero(g["pair_before"] >= 0)
                c, r, back, _ = distinct(g["pair_before"][some], g["rank"][some] + 1, model.triples.width + 1, int(model.pairs.base[-1]) + (1 << 32))
                _, prob, left, _ = model.triples.find(c, r - 1)
                p[some] = prob[back] + left[back] * p[some]
            full = np.log10(p)
            sums = [np.add.reduceat(x, first[:-1]) for x in (uni, full, (g["ids"] >= 0).astype(np.int64))]
            tab = pa.Table.from_batches([b.select([id_col, "held_out"]) for b in rows]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([values(tab, id_col), values(tab, "held_out"), pa.array(np.diff(first)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])], names=[id_col, "held_out", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str):
    """The contract's fold: crc32 of the id as text, modulo 10, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def train(rows: DataFrame) -> Model:
    """The model of the texts of `rows`."""
    spark = rows.sparkSession
    counts = written(count_words(rows), "lm-counts")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("h") == int(END), F.col("c"))), F.lit(0)).alias("docs")).first()
    folder = new_path(spark, "lm")
    model = Model(write_words(counts, total["v"], folder), total["n"], total["docs"])
    if not total["v"]:
        return model
    if total["v"] >= 1 << 32:
        raise ValueError("more words than ids of 32 bits")
    shards = max(1, -(-total["n"] // SHARD))
    some = counts.where(F.col("c") > total["n"] / (4 * shards)).collect()  # at most four a shard
    ids, c = model.words.find(np.array([r["h"] for r in some], np.int64).view(np.uint64))
    order = np.argsort(ids)
    end = int(model.words.find(np.array([END]))[0][0])
    bounds = pair_bounds(shards, model.words.size, ids[order], c[order], model.tokens, model.docs, end)
    model.pairs, width, xs, ys = write_pairs(rows, model, bounds, folder)
    pairs = int(xs[-1]) + 1 if len(xs) > 1 else 0
    last = model.pairs.base[-1] + (level_file(model.pairs.paths[-1])[0].n if model.pairs.paths[-1] else 0)
    pairs = max(pairs, int(last))
    at = np.interp(np.arange(shards) / shards * ys[-1], ys, xs).astype(np.int64)
    at[0] = 0
    model.triples = write_triples(rows, model, np.unique(at), width, pairs, folder)
    return model


def language_model_scores(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document; the model learns from those not held out."""
    rows = clean_text(docs, id_col).withColumn("held_out", held_out(id_col))
    model = train(rows.where(~F.col("held_out")).select("text"))
    return score_documents(rows, model, id_col).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op9_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
