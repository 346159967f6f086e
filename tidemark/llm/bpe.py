"""BPE encoding by speculation and verification, and decoding, for byte-level BPE files of the tokenizers library.

A word (pre-token) is first cut greedily into the longest tokens of a prefix tree. Such a sequence is the one that merging gives exactly if every two
neighbours are compatible: undoing the merges of both from the latest on, no pair that ever stood at their border would have merged before the merge that is
undone. Both steps run over all words of a batch at once; words with an incompatible pair are merged one by one, in order of rank. Tokens that merging does
not give for their own bytes are never proposed.

Null texts are empty and have no ids; texts may be of any length and are encoded whole; special tokens' strings in a text become their ids, as in the library.
Repeated rows, null ids and extra columns are kept as they are; an empty table gives no rows. Files with a normaliser, another pre-tokeniser than plain
byte-level, options of BPE beyond merges, or merges that come before those of their parts are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, values
from .tokens import tokenizer_path

_NEVER = np.int64(1 << 40)
# A space before one of these always begins a new pre-token of byte-level BPE, so a text may be cut there.
_SAFE = "!-~¡-ʯ"
_CUT, _UNSAFE = re.compile(f" (?=[{_SAFE}])"), re.compile(f" (?![{_SAFE}])")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Strings:
    """Byte strings by number, in one buffer."""

    def __init__(self, each: list[bytes]):
        self.data = np.frombuffer(b"".join(each), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)

    def joined(self, ids: np.ndarray, at_once: int = 1 << 20) -> bytes:
        """The strings of these numbers, one after another."""
        out = []
        for lo in range(0, len(ids), at_once):
            start = self.at[ids[lo : lo + at_once]]
            size = self.at[ids[lo : lo + at_once].astype(np.int64) + 1] - start
            out.append(self.data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.at[ids.astype(np.int64) + 1] - self.at[ids]


class Bpe:
    """Tables of a byte-level BPE file, and encoding and decoding by them."""

    def __init__(self, path: str, memory: int = 400_000):
        import tokenizers

        tok = tokenizers.Tokenizer.from_file(path)
        spec = json.loads(tok.to_str())
        model, pre, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or (spec["decoder"] or {}).get("type") != "ByteLevel" or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.split_words = tok.pre_tokenizer.pre_tokenize_str
        byte = {ord(c): b for b, c in enumerate(byte_letters())}
        spelt = {t: bytes(byte[ord(c)] for c in t) for t in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in added}
        self.find_special = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if added else None
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        text = [b""] * size
        for t, k in model["vocab"].items():
            text[k] = spelt[t]
        for t, k in self.special.items():
            text[k] = t.encode()
        self.size, self.text, self.decimal = size, Strings(text), Strings([b"%d," % k for k in range(size)])
        self.known = np.array([len(t) > 0 for t in text])
        # merges: rank, parts and outcome
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        into = np.array([vocab[m[0] + m[1]] for m in merges], np.int64)
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank[into], self.left[into], self.right[into] = np.arange(len(merges)), a, b
        if len(set(into.tolist())) != len(into) or (np.maximum(self.rank[a], self.rank[b]) >= np.arange(len(merges))).any():
            raise ValueError(f"{path}: merges are not each of a token of its own, after those of its parts")
        key = a * size + b
        order = np.argsort(key)
        self.into = into
        self.pair_key, self.pair_rank = np.append(key[order], -1), np.append(order, _NEVER)
        self.merge = dict(zip(key.tolist(), zip(range(len(merges)), into.tolist(), strict=True), strict=True))
        self.byte_id = [vocab[c] for c in byte_letters()]
        # tokens that their own bytes give: both parts do, and nothing else would merge across them first
        clean = self.compatible(a, b, own=True).tolist()
        own = [False] * size
        for k in self.byte_id:
            own[k] = True
        for x, y, z, ok in zip(a.tolist(), b.tolist(), into.tolist(), clean, strict=True):
            own[z] = ok and own[x] and own[y]
        self._tree([(text[k], k) for k in range(size) if own[k]])
        self.most, self.memory = memory, {}

    def _tree(self, tokens: list[tuple[bytes, int]]) -> None:
        """Prefix tree: sorted keys of (node, byte), the node each leads to, and the token that ends at a node."""
        node, edges, ends = {b"": 0}, {}, [-1]
        for t, k in tokens:
            for n in range(1, len(t) + 1):
                if t[:n] not in node:
                    node[t[:n]] = len(ends)
                    edges[node[t[: n - 1]] << 8 | t[n - 1]] = len(ends)
                    ends.append(-1)
            ends[node[t]] = k
        keys = np.array(sorted(edges), np.int64)
        self.edge, self.to, self.ends = np.append(keys, np.iinfo(np.int64).max), np.array([*(edges[k] for k in keys.tolist()), 0], np.int64), np.array(ends, np.int64)

    # --- speculation --------------------------------------------------------------------------------------------------------

    def longest(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each byte and ends by `end`, and its length; every byte is a token."""
        n = len(data)
        token, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            key = node << 8 | data[at + depth]
            k = np.searchsorted(self.edge, key)
            hit = self.edge[k] == key
            at, node, depth = at[hit], self.to[k[hit]], depth + 1
            whole = self.ends[node] >= 0
            token[at[whole]], length[at[whole]] = self.ends[node[whole]], depth
            on = at + depth < end[at]
            at, node = at[on], node[on]
        return token, length

    def greedy(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest tokens of each word from its start on: the tokens of all words in order, and the word of each."""
        word = np.repeat(np.arange(len(starts)), stops - starts)
        token, length = self.longest(data, stops[word])
        taken = np.zeros(len(data), bool)
        at, end = starts, stops
        while len(at) > 64:
            taken[at] = True
            at = at + length[at]
            on = at < end
            at, end = at[on], end[on]
        step = length.tolist() if len(at) else []
        for lo, hi in zip(at.tolist(), end.tolist(), strict=True):  # the few long words that are left
            while lo < hi:
                taken[lo] = True
                lo += step[lo]
        return token[taken], word[taken]

    # --- verification -------------------------------------------------------------------------------------------------------

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        k = np.searchsorted(self.pair_key[:-1], key)
        return np.where(self.pair_key[k] == key, self.pair_rank[k], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, own: bool = False) -> np.ndarray:
        """Whether merging keeps tokens x and y apart where they stand side by side; with `own`, whether it keeps them until they merge into one.

        Backwards in time: of the two tokens at the border, the one that was merged later is undone, at equal ranks the right one, as merging goes from the
        left. The pair that then stands at the border must not have had its turn before: a rank below that of the undone merge, or the same rank when that
        merge stood to its right.
        """
        ok, live = np.ones(len(x), bool), np.arange(len(x))
        limit = np.zeros(len(x), np.int64) if own else np.full(len(x), _NEVER)
        while len(live):
            good = self.ranks(x, y) >= limit
            ok[live[~good]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = good & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            second = ry >= rx
            limit = np.where(second, ry + 1, rx)
            x, y = np.where(second, x, self.right[x]), np.where(second, self.left[y], y)
        return ok

    # --- exact merging ------------------------------------------------------------------------------------------------------

    def merged_together(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words at once: in each round every word merges its leftmost pair of least rank. (ids, word of each)."""
        ids, word, done = np.array(self.byte_id)[data], np.repeat(np.arange(len(size)), size), []
        while len(ids):
            inside = np.append(word[1:] == word[:-1], False)
            rank = np.full(len(ids), _NEVER)
            at = np.flatnonzero(inside)
            rank[at] = self.ranks(ids[at], ids[at + 1])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(ids)))
            on = np.repeat(least < _NEVER, length)
            done.append((ids[~on], word[~on]))
            pair = np.flatnonzero(on & (rank == np.repeat(least, length)))
            pair = pair[np.append(True, word[pair[1:]] != word[pair[:-1]])] if len(pair) else pair  # the leftmost of each word
            ids[pair] = self.into[rank[pair]]
            keep = on
            keep[pair + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = (np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def merged(self, word: bytes) -> list[int]:
        """Merges in order of rank, from the left at equal ranks; for long words, in n log n steps."""
        ids = [self.byte_id[b] for b in word]
        n, merge, size = len(ids), self.merge, self.size
        after, prior = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = merge[a * size + b][1], -1
            k = after[i] = after[j]
            if k >= 0:
                prior[k] = i
                if m := merge.get(ids[i] * size + ids[k]):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            h = prior[i]
            if h >= 0 and (m := merge.get(ids[h] * size + ids[i])):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
            after[j] = -1
        return [x for x in ids if x >= 0]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and where each word's begin (and the last ends)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(np.array([len(w) for w in words], np.int64))
        ids, word = self.greedy(data, np.concatenate([[0], stops[:-1]]), stops)
        pair = np.flatnonzero(word[1:] == word[:-1])
        wrong = np.unique(word[pair[~self.compatible(ids[pair], ids[pair + 1])]])
        size = np.bincount(word, minlength=len(words))
        if len(wrong):
            length = np.diff(np.append(0, stops))[wrong]
            long, short = wrong[length > 64], wrong[length <= 64]
            whole = [self.merged(words[k]) for k in long.tolist()]
            some, of = self.merged_together(np.frombuffer(b"".join([words[k] for k in short.tolist()]), np.uint8), length[length <= 64])
            keep = np.ones(len(words), bool)
            keep[wrong] = False
            ids = np.concatenate([ids[keep[word]], some, np.array([x for m in whole for x in m], np.int64)])
            word = np.concatenate([word[keep[word]], short[of], np.repeat(long, [len(m) for m in whole])])
            ids = ids[np.argsort(word, kind="stable")]
            size = np.bincount(word, minlength=len(words))
        return ids, np.concatenate([[0], np.cumsum(size)])

    # --- texts --------------------------------------------------------------------------------------------------------------

    def _chunks(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian, unsigned, 32 bits) of each text; the texts are cut into pre-tokens by the file's own pre-tokeniser."""
        words, of = [], []
        for k in range(0, len(texts), 4096):
            part = texts[k : k + 4096]
            size = [len(t.encode()) for t in part]
            # texts that begin with a safe space stay apart where they stand together; others go alone
            runs, lo = [], 0
            for i in range(1, len(part) + 1):
                if i == len(part) or not (part[i][:1] == " " and _CUT.match(part[i])):
                    runs.append((lo, i))
                    lo = i
            for lo, hi in runs:
                got = [w for w, _ in self.split_words("".join(part[lo:hi]))]
                at = np.cumsum([0, *(len(w) for w in got)])[:-1]
                words += got
                of += (k + lo + np.searchsorted(np.cumsum(size[lo:hi]), at, "right")).tolist()
        if not words:
            return [b""] * len(texts)
        number = {w: n for n, w in enumerate(dict.fromkeys(words))}
        code = np.array([number[w] for w in words], np.int64)
        ids, at = self.words([self._bytes(w) for w in number])
        size = (at[1:] - at[:-1])[code]
        flat = ids[np.repeat(at[code] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].astype("<u4").tobytes()
        stop = np.cumsum(np.bincount(np.array(of), size, len(texts))).astype(np.int64) * 4
        return [flat[lo:hi] for lo, hi in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]

    _LETTER = {ord(c): b for b, c in enumerate(byte_letters())}

    def _bytes(self, word: str) -> bytes:
        return word.translate(self._LETTER).encode("latin-1")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Chunks between safe spaces are remembered, a bounded number of them; new ones of all texts are encoded together."""
        cut = []  # of each text: a list of chunks, or an id
        for t in texts:
            row: list = []
            at = 0
            for m in [*(self.find_special.finditer(t) if self.find_special else ()), None]:
                part = t[at : m.start() if m else len(t)]
                if part:
                    first, *rest = _CUT.split(part) if _UNSAFE.search(part) else part.split(" ")
                    row.append(("\0" + first, rest))  # a chunk at the start has no space before it
                if m:
                    row.append(self.special[m[0]])
                    at = m.end()
            cut.append(row)
        need: set[str] = set()
        for row in cut:
            for x in row:
                if type(x) is tuple:
                    need.add(x[0])
                    need.update(x[1])
        fresh = sorted(need.difference(self.memory))
        if len(self.memory) + len(fresh) > self.most:
            self.memory = {c: self.memory[c] for c in need if c in self.memory}
        self.memory.update(zip(fresh, self._chunks([c[1:] if c[:1] == "\0" else " " + c for c in fresh]), strict=True))
        of, out = self.memory.__getitem__, []
        for row in cut:
            ids = b"".join([b"".join([of(x[0]), *map(of, x[1])]) if type(x) is tuple else x.to_bytes(4, "little") for x in row])
            out.append(np.frombuffer(ids, "<u4"))
        for c in fresh:
            if len(c) > 64:
                del self.memory[c]
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if len(ids) and (int(ids.max()) >= self.size or not self.known[ids].all()):
            raise ValueError("an id outside the vocabulary")
        return self.text.joined(ids)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters, as in the library."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One for all tasks of a Python worker."""
    return Bpe(path)


def encode(df: DataFrame, tokenizer: str, column: str = "text", to: str = "ids") -> DataFrame:
    """df with the ids of a text column as an array of ints. Rows stay where they are; `tokenizer` is a path that every executor has."""
    names = [c for c in df.columns if c != to]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + f", `{to}` array<int>"

    def run(batches):
        code = bpe(tokenizer)
        for b in pieces(batches, column, 4_000_000):
            ids = code.encode([x or "" for x in values(b, column).to_pylist()])
            offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(values(b, c) for c in names), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=[*names, to])

    return df.select(*names).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, column: str = "ids", to: str = "text") -> DataFrame:
    """df with the text of a column of ids; null ids give the empty text."""
    names = [c for c in df.columns if c != to]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + f", `{to}` string"

    def run(batches):
        code = bpe(tokenizer)
        for b in batches:
            texts = [code.decode(np.array(x or (), np.uint32)) for x in values(b, column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(values(b, c) for c in names), pa.array(texts, pa.string())], names=[*names, to])

    return df.select(*names).mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text: ids in decimals joined by commas, and the decoded text. One pass over the table, no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        code = bpe(tokenizer)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in pieces(batches, "text", 4_000_000):
            ids = code.encode([x or "" for x in values(b, "text").to_pylist()])
            said = [sha(code.decimal.joined(x)[:-1]) for x in ids]
            back = [sha(code.decode(x).encode()) for x in ids]
            yield pa.RecordBatch.from_arrays([values(b, id_col), pa.array([len(x) for x in ids], pa.int64()), pa.array(said), pa.array(back)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
