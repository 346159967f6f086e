"""Substring dedup by suffix automata: windows of words that start earlier in the corpus are removed.

The corpus is its own reference, so the reference is cut into shards by content instead of being broadcast whole: each window of 20 words is
represented by the least hash of the 8-word anchors in it, equal windows by equal anchors; a shard is all stretches of text that one anchor
represents. A shard's suffix automaton grows in corpus order while the stretches stream through it: matching statistics of 20 or more mark windows that
have stood before. Anchors that stand once can't repeat and are let go before any text moves.

Nulls are empty texts; rows of equal id and text count as one document and get the same result; rows of one id and other texts follow in order of a hash
of the text, a null id comes first; extra columns are ignored; texts of fewer than 20 words stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffers, clean_text, key_runs, pieces, span_hash, table, values, written

ANCHOR = 8


class SuffixAutomaton:
    """Of several sequences, each added after the ones before; transitions by word."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, seq: list) -> None:
        last = 0
        for c in seq:
            last = self._extend(last, c)

    def _clone(self, p: int, q: int, c) -> int:
        """A copy of q for the strings that end at p followed by c."""
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        cur = len(self.len)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return cur

    def matches(self, seq: list) -> list[int]:
        """Matching statistics: at each place, the length of the longest string that ends there and stands in a sequence of the automaton."""
        out, state, n = [], 0, 0
        nxt, link, size = self.next, self.link, self.len
        for c in seq:
            while state and c not in nxt[state]:
                state = link[state]
                n = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def anchors(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first window's word, windows) of each stretch of windows that one anchor represents: the least of a window's, leftmost of equals."""
    n, span = len(hashes), window - ANCHOR + 1
    if n < window:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    at = np.arange(n - ANCHOR + 1)
    g = span_hash(hashes, at, at + ANCHOR)
    least = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(n - window + 1)
    ok = np.flatnonzero(words.row[: n - window + 1] == words.row[window - 1 :])
    if not len(ok):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    pos, row = least[ok], words.row[ok]
    new = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (row[1:] != row[:-1]))))
    runs = np.diff(np.append(new, len(ok)))
    row = row[new]
    return g[pos[new]], row, ok[new] - words.first[row], runs


def runs_of(flags: list[bool]) -> list[tuple[int, int]]:
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", window: int = 20, hot: int = 2000) -> DataFrame:
    """(d, t, start, end): words covered by windows that start earlier in the corpus; d is the id, t a hash of the text.

    In shards of more than `hot` stretches equal ones (by SHA-256 of their words) are found first, by an aggregate that combines before it shuffles and a join that can be split;
    only the earliest of each goes to the automaton. A shard of more than 3 x `hot` different stretches is cut to single windows, by content: as exact, for
    a passage that any share of the documents may hold.
    """
    rows = clean_text(docs, id_col).select(F.col(id_col).alias("d"), F.xxhash64("text").alias("t"), "text")
    kind = dict(docs.dtypes)[id_col]

    def find(batches):
        for b in pieces(batches):
            w = Words(*buffers(values(b, "text")))
            a, row, start, n = anchors(w, w.hashes(), window)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), values(b, "d").take(take), values(b, "t").take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["a", "d", "t", "start", "n"])

    found = rows.mapInArrow(find, f"a long, d {kind}, t long, start int, n int")
    many = found.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a", (F.col("c") > hot).alias("is_hot"))
    of_doc = found.join(many.hint("merge"), "a")
    per = written(of_doc.groupBy("d", "t").agg(F.collect_set(F.struct("start", "n", "a", "is_hot")).alias("s")), "anchors")

    def small(batches):
        for b in pieces(batches):
            texts = pa.array([pa.compress(x.as_py().encode(), codec="zstd", asbytes=True) for x in values(b, "text")], pa.binary())
            sizes = pa.array([len(x.as_py().encode()) for x in values(b, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([values(b, "d"), values(b, "t"), texts, sizes], names=["d", "t", "packed", "size"])

    texts = rows.mapInArrow(small, f"d {kind}, t long, packed binary, size long")

    def cut(batches):
        """The words of each stretch."""
        for b in batches:
            for i in range(0, b.num_rows, 64):
                a, d, t, start, n, words, is_hot = [], [], [], [], [], [], []
                part = b.slice(i, 64)
                for doc, th, packed, size, spans in zip(*(values(part, c).to_pylist() for c in ("d", "t", "packed", "size", "s")), strict=True):
                    own = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True).split()
                    for s in spans:
                        a.append(s["a"])
                        d.append(doc)
                        t.append(th)
                        start.append(s["start"])
                        n.append(s["n"])
                        words.append(b" ".join(own[s["start"] : s["start"] + s["n"] + window - 1]))
                        is_hot.append(s["is_hot"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, part.schema.field("d").type), pa.array(t, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(words, pa.binary()), pa.array(is_hot, pa.bool_())], names=["a", "d", "t", "start", "n", "words", "is_hot"])

    stretches = per.join(texts.hint("merge"), per["d"].eqNullSafe(texts["d"]) & (per["t"] == texts["t"])).select(per["d"], per["t"], "packed", "size", "s")
    stretches = written(stretches.mapInArrow(cut, f"a long, d {kind}, t long, start int, n int, words binary, is_hot boolean"), "stretches")

    def stream(batches):
        for tab in key_runs(batches, ["a"], 50_000):
            col = {c: tab[c].to_pylist() for c in ("a", "d", "t", "start", "words")}
            out_d, out_t, out_s, out_e = [], [], [], []
            now = last = None
            for a, d, t, start, raw in zip(*col.values(), strict=True):
                if (a, d, t, start) == last:  # a repeated row
                    continue
                last = (a, d, t, start)
                if a != now:
                    now, seen, automaton, waiting = a, set(), None, None
                if raw in seen:
                    spans = [(0, raw.count(b" ") + 1)]
                elif waiting is None and automaton is None:
                    waiting, spans = raw.split(), []
                else:
                    if automaton is None:
                        automaton = SuffixAutomaton()
                        automaton.add(waiting)
                        waiting = None
                    words = raw.split()
                    hit = [n >= window for n in automaton.matches(words)][window - 1 :]
                    spans = [(i, j + window - 1) for i, j in runs_of(hit)]
                    if not all(hit):
                        automaton.add(words)
                seen.add(raw)
                for i, j in spans:
                    out_d.append(d)
                    out_t.append(t)
                    out_s.append(start + i)
                    out_e.append(start + j)
            yield pa.RecordBatch.from_arrays([pa.array(out_d, tab.schema.field("d").type), pa.array(out_t, pa.int64()), pa.array(out_s, pa.int32()), pa.array(out_e, pa.int32())], names=["d", "t", "start", "end"])

    cool = stretches.where(~F.col("is_hot")).select("a", "d", "t", "start", "words")
    # hot shards: equal stretches first, of which all but the earliest go whole
    many = stretches.where("is_hot").withColumn("h", F.sha2("words", 256))
    first = written(many.groupBy("a", "h").agg(F.min(F.struct("d", "t", "start", "words")).alias("f")), "first-stretches")
    place = F.struct("d", "t", "start")
    copies = many.drop("words").join(first.select("a", "h", F.struct("f.d", "f.t", "f.start").alias("f")).hint("merge"), ["a", "h"]).where(~place.eqNullSafe(F.col("f"))).select("d", "t", "start", (F.col("start") + F.col("n") + window - 1).alias("end"))
    size = first.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > 3 * hot).select("a", F.lit(True).alias("still"))
    distinct = first.select("a", "f.*").join(size.hint("merge"), "a", "left")
    cool = cool.unionByName(distinct.where("still is null").drop("still"))

    def windows(batches):
        for b in batches:
            d, t, start, w = [], [], [], []
            for doc, th, at, raw in zip(*(values(b, c).to_pylist() for c in ("d", "t", "start", "words")), strict=True):
                own = raw.split()
                for k in range(len(own) - window + 1):
                    d.append(doc)
                    t.append(th)
                    start.append(at + k)
                    w.append(hashlib.blake2b(b" ".join(own[k : k + window]), digest_size=32).digest())
            yield pa.RecordBatch.from_arrays([pa.array(d, b.schema.field("d").type), pa.array(t, pa.int64()), pa.array(start, pa.int32()), pa.array(w, pa.binary())], names=["d", "t", "start", "w"])

    # what is hot even so: single windows, by content
    single = distinct.where("still").select("d", "t", "start", "words").mapInArrow(windows, f"d {kind}, t long, start int, w binary")
    earliest = single.groupBy("w").agg(F.min(place).alias("f"))
    again = single.join(earliest.hint("merge"), "w").where(~place.eqNullSafe(F.col("f"))).select("d", "t", "start", (F.col("start") + window).alias("end"))
    streamed = cool.repartition("a").sortWithinPartitions("a", "d", "t", "start").mapInArrow(stream, f"d {kind}, t long, start int, end int")
    return streamed.unionByName(copies).unionByName(again)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", window: int = 20) -> DataFrame:
    """(id, text, n_words, n_removed) of each document: text is the kept words, joined by one space."""
    spans = written(repeated_spans(docs, id_col, window), "spans").groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    kind = dict(docs.dtypes)[id_col]
    rows = clean_text(docs, id_col).withColumn("t", F.xxhash64("text"))
    both = rows.join(spans.hint("merge"), rows[id_col].eqNullSafe(spans["d"]) & (rows["t"] == spans["t"]), "left").select(id_col, "text", "s")

    def run(batches):
        for b in pieces(batches):
            texts, n, removed = [], [], []
            for text, spans in zip(values(b, "text").to_pylist(), values(b, "s").to_pylist(), strict=True):
                words = text.encode().split()
                keep = np.ones(len(words) + 1, np.int64)
                keep[-1] = 0
                for s in spans or ():
                    keep[s["start"] : s["end"]] = 0
                kept = [w for w, k in zip(words, keep.tolist(), strict=False) if k] if spans else words
                texts.append(b" ".join(kept).decode())
                n.append(len(words))
                removed.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays([values(b, id_col), pa.array(texts), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[id_col, "text", "n_words", "n_removed"])

    return both.mapInArrow(run, f"{id_col} {kind}, text string, n_words long, n_removed long")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op2_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
