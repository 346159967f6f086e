"""Benchmark decontamination by latent semantic retrieval: randomised SVD of TF-IDF passages, cosine search, then alignment and answer checks.

Nulls are empty texts; items without words are skipped; repeated ids and rows are judged each by its own text; extra columns are ignored; an empty
benchmark finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffers, clean_text, mix, pieces, table, values, written

#: Document frequencies are counted in stretches of so many words; words outside the benchmark share so many places.
STRETCH, OTHERS = 32, 1 << 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_words(texts: pa.Array) -> Words:
    """Lower-cased runs of letters and digits: case in any alphabet, punctuation and spacing don't hide a passage."""
    data, offs = buffers(pc.utf8_lower(texts))
    return Words(np.where(_LETTER[data], data, 32).astype(np.uint8), offs)


class Block:
    """Items of about one length: their places in the benchmark, their own vocabulary (places in the benchmark's) and the passages' length."""

    def __init__(self, window: int, items: list[int], terms: list[np.ndarray]):
        self.window, self.items = window, items
        self.vocab = np.unique(np.concatenate(terms))


class Benchmark:
    """The items' word hashes and their vocabulary. Small by a checked bound, so that each task may have it.

    Items are dealt into blocks by length, so that a passage is at most about twice as long as the items that it is held against. A block has at
    most `most` items, so that a space of some more dimensions holds each of them whole, and about `words` words, so that its matrices stay small.
    """

    def __init__(self, items: list[tuple[int, str]], most: int, words: int = 16_384):
        w = letter_words(pa.array([t for _, t in items], pa.large_string()))
        h = w.hashes()
        self.ids, self.words = [], []
        for i, (item, _) in enumerate(items):
            own = h[w.first[i] : w.first[i + 1]]
            if len(own):
                self.ids.append(item)
                self.words.append(own)
        self.vocab = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.terms = [np.unique(self.term(own)) for own in self.words]
        by: dict[int, list[int]] = {}
        for i, own in enumerate(self.words):
            by.setdefault(max(8, 1 << (len(own) - 1).bit_length()), []).append(i)
        self.blocks = []
        for window, own in sorted(by.items()):
            each = max(1, min(most, words // window))
            self.blocks += [Block(window, own[at : at + each], [self.terms[i] for i in own[at : at + each]]) for at in range(0, len(own), each)]
        self.windows = sorted(by)

    def term(self, h: np.ndarray) -> np.ndarray:
        """The word's place in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at, -1)


def passages(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of passages: windows of `window` words at every half window, over each whole row."""
    step = window // 2
    count = w.counts()
    each = np.where(count > 0, np.maximum(1, -(-(count - step) // step)), 0)
    row = np.repeat(np.arange(len(count)), each)
    k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    lo = w.first[row] + k * step
    return lo, np.minimum(lo + window, w.first[row + 1])


def lcs(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the longest common subsequence of words, and which places of `a` it uses. Bit-parallel over a, one step a word of b."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, steps = full, []
    for x in b.tolist():
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        steps.append(v)
    used = np.zeros(len(a), bool)
    i, j, blist = len(a), len(steps), b.tolist()
    zeros = lambda v, i: i - (v & ((1 << i) - 1)).bit_count()  # noqa: E731  length of the LCS of a's first i words
    while i and j:
        here = zeros(steps[j - 1], i)
        if not here:
            break
        if (zeros(steps[j - 2], i) if j > 1 else 0) == here:
            j -= 1
        elif zeros(steps[j - 1], i - 1) == here:
            i -= 1
        else:
            used[i - 1] = a[i - 1] == blist[j - 1]
            i, j = i - 1, j - 1
    return int(used.sum()), used


def overlaps(item: np.ndarray, region: np.ndarray, share: float, answer: float) -> float:
    """Share of the item's words that stand in the region in order, or 0 where the passage or its answer isn't there.

    The answer is the item's last quarter, of which at least `answer` must be used; a match of fewer than 8 words must be the whole item.
    """
    n, used = lcs(item, region)
    got = n / len(item)
    tail = used[-max(1, len(item) // 4) :]
    return got if got >= share and tail.mean() >= answer and (n >= 8 or n == len(item)) else 0.0


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", cosine: float = 0.25, common: float = 0.02, share: float = 0.6, answer: float = 0.5, dims: float = 0.5, latent_cosine: float = 0.5, block_items: int = 240, max_items: int = 50_000) -> DataFrame:
    """(id, text_hash, item_id, overlap, cosine) of each contaminated document and benchmark item.

    1. Document frequencies of all words over stretches of all documents; words outside the benchmark share a table of fixed size by hash, which can
       only lower their weight.
    2. TF-IDF of every passage, each word counted once; words that more than `common` of all stretches have weigh nothing (but for items that have
       hardly any others). Items are dealt by powers of two of their words, and each length has passages of its own, so that no long item hides a short
       one. A passage is let go here if no item of a block can have a plain cosine of `cosine` with it, by a bound: products with the items summed
       over its halves, repeats included, over the norm of words counted once at most. It only thins out what the search below has to look at.
    3. Randomised SVD a block of items: the passages, and the items as passages too, times a random matrix, partial sums in tasks, and once more for a
       power step. The space has `dims` dimensions for each item, fewer than items, at any size of the benchmark; blocks are worked in rounds of bounded
       memory.
    4. Cosine of passages and items within the latent space decides which pairs are looked at: from `latent_cosine` on, an item is aligned with the words
       around the passage by longest common subsequence. Words that go together in the corpus stand for each other there, so reworded passages come near.
       All of it runs in tasks; what moves is one matrix a block per partition and the found rows.
    """
    spark = docs.sparkSession
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"the benchmark has more than {max_items} items; raise max_items if each task can hold it")
    bench = Benchmark([(r["item_id"], r["text"]) for r in rows], most=block_items)
    kind = dict(docs.dtypes)[id_col]
    out = f"{id_col} {kind}, text_hash long, item_id long, overlap double, cosine double"
    if not bench.words:
        return spark.createDataFrame([], out)
    d = len(bench.vocab)
    plain = clean_text(docs, id_col)

    def slots(term: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The word's place in the tables of frequencies: its own for the benchmark's words, one of OTHERS by hash for all others."""
        return np.where(term >= 0, term, d + (mix(h) % np.uint64(OTHERS)).astype(np.int64))

    def frequencies(batches):
        df, n = np.zeros(d + OTHERS, np.int64), 0
        for b in pieces(batches):
            w = letter_words(values(b, "text"))
            if not len(w):
                continue
            h = w.hashes()
            stretch = (np.arange(len(w)) - w.first[w.row]) // STRETCH
            new = np.concatenate(([True], (np.diff(stretch) != 0) | (np.diff(w.row) != 0)))
            at = np.cumsum(new) - 1
            n += int(at[-1]) + 1
            df += np.bincount(np.unique(at * len(df) + slots(bench.term(h), h)) % len(df), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), -1)), pa.array(np.append(df[df > 0], n))], names=["slot", "n"])

    counted = plain.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most the benchmark's vocabulary and OTHERS
    total = max(1, sum(r["n"] for r in counted if r["slot"] < 0))
    df = np.zeros(d + OTHERS)
    for r in counted:
        if r["slot"] >= 0:
            df[r["slot"]] = r["n"]
    idf = np.log((total + 1) / (df + 1)) + 0.1
    usual = df > common * total
    for terms in bench.terms:
        if (~usual[terms]).sum() < 3:
            usual[terms] = False
    idf[usual] = 0.0

    postings = []  # a block: for each term of its vocabulary, where its items begin; these; their weights of norm 1
    for block in bench.blocks:
        item = np.repeat(np.arange(len(block.items)), [len(bench.terms[i]) for i in block.items])
        t = np.concatenate([bench.terms[i] for i in block.items])
        share_of = idf[t] / np.sqrt(np.bincount(item, idf[t] ** 2))[item]
        order = np.argsort(t, kind="stable")
        postings.append((np.searchsorted(t[order], np.append(block.vocab, d)), item[order], share_of[order]))

    def weighed(batches):
        """The passages that can reach the cosine with a block's items: block, the terms by their place there, weights divided by the whole norm, and the words around."""
        for b in pieces(batches, limit=500_000):
            w = letter_words(values(b, "text"))
            if not len(w):
                continue
            h = w.hashes()
            term = bench.term(h)
            slot = slots(term, h)
            square = idf[slot] ** 2
            own = w.row * np.int64(len(idf)) + slot
            order = np.argsort(own, kind="stable")
            again = np.diff(own[order]) == 0
            ago = np.full(len(w), len(w))  # words since the last one in the row of the same slot
            ago[order[1:][again]] = np.diff(order)[again]
            inside = np.flatnonzero((term >= 0) & (square > 0))
            rows, blocks, terms, weights, around = [], [], [], [], []
            for c, block in enumerate(bench.blocks):
                window, step, n = block.window, block.window // 2, len(block.items)
                if not c or bench.blocks[c - 1].window != window:
                    lo, hi = passages(w, window)
                    once = np.concatenate(([0], np.cumsum(np.where(ago >= window, square, 0.0))))
                    least = 0.999 * cosine * np.sqrt(once[hi] - once[lo])  # no word counts but once
                    cells = np.maximum(2, -(-w.counts() // step)) * (w.counts() > 0)  # half passages; a passage is two
                    begin = np.cumsum(cells) - cells
                    cell = begin[w.row] + (np.arange(len(w)) - w.first[w.row]) // step
                    half = begin[w.row[lo]] + (lo - w.first[w.row[lo]]) // step
                start, item, share_of = postings[c]
                local = np.full(d, -1)
                local[block.vocab] = np.arange(len(block.vocab))
                at, place = inside, local[term[inside]]
                at, place = at[place >= 0], place[place >= 0]
                size = start[place + 1] - start[place]
                to = np.repeat(start[place] - np.cumsum(size) + size, size) + np.arange(size.sum())
                dot = np.bincount(np.repeat(cell[at] * n, size) + item[to], np.repeat(idf[slot[at]], size) * share_of[to], minlength=int(cells.sum()) * n).reshape(-1, n)
                best = (dot[half] + dot[half + 1]).max(axis=1)  # repeats only add
                for k in np.flatnonzero((best > 0) & (best >= least)).tolist():
                    t = np.unique(slot[lo[k] : hi[k]])
                    x = idf[t]
                    norm2 = float(x @ x)
                    if best[k] < 0.999 * cosine * np.sqrt(norm2):
                        continue
                    t, x = t[t < d], x[t < d]
                    here = (local[t] >= 0) & (x > 0)
                    i = w.row[lo[k]]
                    rows.append(i)
                    blocks.append(c)
                    terms.append(local[t[here]].astype("<i4").tobytes())
                    weights.append((x[here] / np.sqrt(norm2)).astype("<f4").tobytes())
                    around.append(h[max(lo[k] - step, w.first[i]) : min(hi[k] + step, w.first[i + 1])].tobytes())
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([values(b, id_col).take(take), values(b, "text_hash").take(take), pa.array(blocks, pa.int32()), pa.array(terms, pa.binary()), pa.array(weights, pa.binary()), pa.array(around, pa.binary())], names=[id_col, "text_hash", "block", "terms", "weights", "around"])

    close = written(plain.withColumn("text_hash", F.xxhash64("text")).mapInArrow(weighed, f"{id_col} {kind}, text_hash long, block int, terms binary, weights binary, around binary"), "passages")

    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def dense(b, basis):
        """By block: the places of the batch's passages, their rows times the block's basis, and their terms and weights."""
        block = values(b, "block").to_numpy()
        terms = [np.frombuffer(x, "<i4") for x in values(b, "terms").to_pylist()]
        weights = [np.frombuffer(x, "<f4") for x in values(b, "weights").to_pylist()]
        for c in np.unique(block).tolist():
            at = np.flatnonzero(block == c)
            yield c, at, np.stack([weights[i] @ basis[c][terms[i]] for i in at]), [terms[i] for i in at], [weights[i] for i in at]

    def found(some: range) -> DataFrame:
        """What the passages hold of some blocks' items."""
        mine = close if len(some) == len(bench.blocks) else close.where(F.col("block").between(some[0], some[-1]))
        vectors, basis = {}, {}
        for c in some:
            block = bench.blocks[c]
            own = np.zeros((len(block.items), len(block.vocab)), np.float32)
            for i, item in enumerate(block.items):
                own[i, np.searchsorted(block.vocab, bench.terms[item])] = 1
            own *= idf[block.vocab].astype(np.float32)
            vectors[c] = own / np.linalg.norm(own, axis=1, keepdims=True)
            k = min(len(block.vocab), max(8, int(dims * len(block.items))))
            basis[c] = np.random.default_rng(c).standard_normal((len(block.vocab), k)).astype(np.float32)

        for _ in range(2):  # range finder, then a power step
            start = basis

            def times(batches, start=start):
                acc = {}
                for b in batches:
                    for c, _, y, terms, weights in dense(b, start) if b.num_rows else ():
                        if c not in acc:
                            acc[c] = np.zeros_like(start[c])
                        for r, (t, x) in enumerate(zip(terms, weights, strict=True)):
                            acc[c][t] += x[:, None] * y[r]
                for c, own in acc.items():
                    for at in range(0, len(own), 256):
                        chunk = own[at : at + 256]
                        if chunk.any():
                            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([at]), pa.array([chunk.tobytes()], pa.binary())], names=["block", "at", "part"])

            def added(key: tuple, tab: pa.Table) -> pa.Table:
                total = sum(np.frombuffer(x, np.float32) for x in tab["part"].to_pylist())
                return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "at": [key[1].as_py()], "part": pa.array([total.tobytes()], pa.binary())})

            moved = mine.select("block", "terms", "weights").mapInArrow(times, "block int, at long, part binary").groupBy("block", "at").applyInArrow(added, "block int, at long, part binary").collect()  # as many numbers as the bases have
            acc = {c: own.T @ (own @ start[c]) * max(1.0, total / 1e4 / len(own)) for c, own in vectors.items()}  # the items as passages
            for r in moved:
                part = np.frombuffer(r["part"], np.float32).reshape(-1, start[r["block"]].shape[1])
                acc[r["block"]][r["at"] : r["at"] + len(part)] += part
            basis = {c: np.linalg.qr(x.astype(np.float64))[0].astype(np.float32) for c, x in acc.items()}
        latent = {c: unit(vectors[c] @ basis[c]) for c in basis}

        def search(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                around = values(b, "around").to_pylist()
                got = []
                for c, at, y, _, _ in dense(b, basis):
                    near = unit(y) @ latent[c].T
                    for i, j in zip(*(x.tolist() for x in np.nonzero(near >= latent_cosine)), strict=True):
                        item = bench.blocks[c].items[j]
                        if o := overlaps(bench.words[item], np.frombuffer(around[at[i]], np.uint64), share, answer):
                            got.append((at[i], bench.ids[item], o, float(near[i, j])))
                if got:
                    rows, ids, over, cos = zip(*got, strict=True)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [values(b, id_col).take(take), values(b, "text_hash").take(take), pa.array(ids, pa.int64()), pa.array(over), pa.array(cos)],
                        names=[id_col, "text_hash", "item_id", "overlap", "cosine"],
                    )

        return mine.mapInArrow(search, out)

    rounds, at = [], 0
    while at < len(bench.blocks):  # bases of 64 MB at a time, or one
        to, size = at, 0
        while to < len(bench.blocks) and (to == at or size + len(bench.blocks[to].vocab) <= (1 << 25) // block_items):
            size += len(bench.blocks[to].vocab)
            to += 1
        rounds.append(range(at, to))
        at = to
    hits = None
    for some in rounds:
        part = found(some) if len(rounds) == 1 else written(found(some), "found")
        hits = part if hits is None else hits.unionByName(part)
    return hits.groupBy(id_col, "text_hash", "item_id").agg(F.max("overlap").alias("overlap"), F.max("cosine").alias("cosine"))


def op10_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    per = hits.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items"), F.max("overlap").alias("overlap"), F.max("cosine").alias("cosine"))
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    both = own.join(per, ["doc_id", "text_hash"], "left")
    return both.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), "overlap", "cosine")
