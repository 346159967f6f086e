"""Token-ID output: tokenizer ids in fixed-width bit-packed files with block offsets, in ascending order of document id.

Null texts are empty and hold the end id alone; equal ids are ordered by text, null ids come first; extra columns are ignored; an empty table gives no
rows and no files.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_text, new_path, pieces, table, values, written
from .files import attempt_name, opened

MAGIC = b"TMBITS1\n"
_FOOT = struct.Struct("<8sIIQQQQ")  # magic, bits, ids per block, ids, documents, where the block offsets and the document starts stand
_NO_ID = np.iinfo(np.int64).min


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, big-endian, padded to a whole byte at the end."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(wide.reshape(-1)).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)


class Writer:
    """Blocks of `block` ids, then their byte offsets, the documents' starts and ids, and a footer."""

    def __init__(self, out, bits: int, block: int = 8192):
        self.out, self.bits, self.block = out, bits, block
        self.at, self.n, self.offsets, self.starts, self.names = 0, 0, [], [0], []
        self.held: list[np.ndarray] = []
        self.rows = 0

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, name: int | None, ids: np.ndarray) -> None:
        """Appends a document."""
        self.names.append(_NO_ID if name is None else name)
        self.n += len(ids)
        self.starts.append(self.n)
        self.held.append(ids)
        self.rows += len(ids)
        if self.rows >= 16 * self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        full = len(ids) // self.block * self.block
        for at in range(0, full, self.block):
            self._put(ids[at : at + self.block])
        if all_ and full < len(ids):
            self._put(ids[full:])
            full = len(ids)
        self.held, self.rows = ([ids[full:]], len(ids) - full) if full < len(ids) else ([], 0)

    def close(self) -> None:
        self._flush(True)
        where = self.at
        offsets, starts = np.array([*self.offsets, self.at], "<u8").tobytes(), np.array([*self.starts, *self.names], "<i8").tobytes()
        self.out.write(offsets + starts + _FOOT.pack(MAGIC, self.bits, self.block, self.n, len(self.starts) - 1, where, where + len(offsets)))
        self.out.close()


class Reader:
    """Random access to the ids of a file: only the blocks that hold them are read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block, self.n, self.docs, a, b = _FOOT.unpack(source.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.offsets = np.frombuffer(source.read_at(b - a, a), "<u8")
        tail = np.frombuffer(source.read_at(8 * (2 * self.docs + 1), b), "<i8")
        self.starts = tail[: self.docs + 1]
        self.names = [None if x == _NO_ID else x for x in tail[self.docs + 1 :].tolist()]

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        lo, hi = start // self.block, -(-end // self.block)
        at = int(self.offsets[lo])
        data = self.source.read_at(int(self.offsets[hi]) - at, at)
        if self.block * self.bits % 8 == 0:
            got = unpack(data, min(hi * self.block, self.n) - lo * self.block, self.bits)
        else:
            cut = [data[int(self.offsets[k]) - at : int(self.offsets[k + 1]) - at] for k in range(lo, hi)]
            got = np.concatenate([unpack(c, min(self.block, self.n - (lo + i) * self.block), self.bits) for i, c in enumerate(cut)])
        return got[start - lo * self.block : end - lo * self.block]

    def documents(self, batch: int = 1 << 20):
        """(index, ids) of all documents in order, read in runs of about `batch` ids."""
        k = 0
        while k < self.docs:
            to = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + batch, "right")) - 1)
            to = min(to, self.docs)
            base = int(self.starts[k])
            got = self.ids(base, int(self.starts[to]))
            for i in range(k, to):
                yield i, got[int(self.starts[i]) - base : int(self.starts[i + 1]) - base]
            k = to


# A space before one of these characters always begins a new pre-token of byte-level BPE, so the text may be encoded piece by piece.
_CUT = re.compile(r"(?= [!-~¡-ʯ])")
_OTHER = re.compile(r" (?![!-~¡-ʯ])")


# Latin letters, then ASCII punctuation but the apostrophe: two pre-tokens (or one).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


class _Memory(dict):
    """Values by piece from `fn`, kept in two generations: what is met again moves to the young one, and the old one goes when that is full."""

    def __init__(self, fn, most: int):
        super().__init__()
        self.fn, self.most, self.old = fn, most, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.fn(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """Ids of a text by a tokenizers file, exact, with a bounded memory of pieces that were encoded before.

    Byte-level BPE files only are taken apart, at spaces that begin a pre-token, and a plain word there is given to the file's BPE model as such; other
    tokenizers encode each text whole.
    """

    def __init__(self, path: str, memory: int = 350_000):
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.bits = max(1, (self.tok.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.apart = '"pre_tokenizer":{"type":"ByteLevel","add_prefix_space":false' in self.tok.to_str() and self.tok.normalizer is None
        self.model = self.tok.model
        # byte-level letters: printable bytes stand for themselves, the others follow from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in plain]
        self.letters = [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]
        self.marks = _Memory(self.whole, memory)
        self.after_space = _Memory(self._piece, memory)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Of a space and letters, which are one pre-token."""
        spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])  # ASCII letters stand for themselves
        return array("I", [t.id for t in self.model.tokenize(self.letters[32] + spelt)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self._word(piece)
        m = _PLAIN.fullmatch(piece)
        if m is None:
            return self.whole(" " + piece)
        return self.after_space[m[1]] + self.marks[m[2]] if m[2] else self._word(piece)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.apart:
            return self.whole(text)
        if _OTHER.search(text):
            first, *rest = _CUT.split(text)
            rest = [p[1:] for p in rest]
        else:
            first, *rest = text.split(" ")
        return (self.whole(first) if first else b"") + b"".join(map(self.after_space.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str, memory: int) -> Encoder:
    """One for all tasks of a Python worker, so that pieces it has met stay known."""
    return Encoder(path, memory)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", memory: int = 350_000) -> DataFrame:
    """Writes the documents' ids to files in `folder`; (part, path, documents, n) of each file, from the attempts that succeeded.

    One range shuffle orders the texts by id; each task encodes its sorted rows as they stream by and appends them to its file. `tokenizer` is a path
    that every executor has. Parts ascend with the ids; document ids are integers. `memory` bounds how many encoded pieces a Python worker keeps.
    """

    def run(batches):
        enc, w, path = None, None, None
        part = TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes() if end_id is not None else b""
        for b in pieces(batches, limit=4_000_000):
            if w is None:
                enc = encoder(tokenizer, memory)
                path = f"{folder}/{attempt_name('tokens', '.bits')}"
                system, at = opened(path)
                system.create_dir(at.rpartition("/")[0], recursive=True)
                w = Writer(system.open_output_stream(at), enc.bits)
            for name, text in zip(values(b, id_col), values(b, "text"), strict=True):
                w.add(name.as_py(), np.frombuffer(enc(text.as_py()) + tail, "<u4"))
        if w:
            w.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(w.names)], pa.int64()), pa.array([w.n], pa.int64())], names=["part", "path", "documents", "n"])

    rows = clean_text(docs, id_col).withColumn(id_col, F.col(id_col).cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, id_col).sortWithinPartitions(id_col, "text").mapInArrow(run, "part int, path string, documents long, n long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", fn=None, extra: str = "", memory: int = 350_000) -> DataFrame:
    """Writes the token files and reads them back: (id, start, n_tokens, and what `fn(ids)` returns, a tuple as in the schema `extra`) of each document.

    start counts the ids of all documents before it. Nothing but one row a file is joined or ordered after the files are written.
    """
    files = written(write_tokens(docs, tokenizer, new_path(docs.sparkSession, "tokens"), end_id, id_col, memory), "token-files")
    before = files.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = [f.strip().split()[0] for f in extra.split(",") if f.strip()]

    def read(batches):
        for b in batches:
            for path, base in zip(values(b, "path").to_pylist(), values(b, "base").to_pylist(), strict=True):
                system, at = opened(path)
                with system.open_input_file(at) as source:
                    r = Reader(source)
                    rows = []
                    for i, ids in r.documents():
                        rows.append((r.names[i], base + int(r.starts[i]), len(ids), *(fn(ids) if fn else ())))
                        if len(rows) == 20_000 or i == r.docs - 1:
                            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), *(pa.array(x) for x in list(zip(*rows, strict=True))[1:])], names=[id_col, "start", "n_tokens", *names])
                            rows = []

    return before.repartition(max(1, files.count()), "path").mapInArrow(read, f"{id_col} long, start long, n_tokens long" + (", " + extra if extra else ""))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, fn=lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), extra="ids_crc32 long")
