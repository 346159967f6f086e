"""What the corpus operators share: shared-folder tables, Arrow text buffers, vectorised words and hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contract word class: anything but space and \x09-\x0D. bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master (tests) gets a temporary folder; a cluster is refused, as its machines share none.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, so a lost executor costs no recomputation of what stands before."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and text, null as the empty text."""
    return df.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


# --- Arrow text ---------------------------------------------------------------------------------------------------------------


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column, and the len+1 offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches, column: str = "text", limit: int = 2_000_000):
    """The batches, cut so that a piece holds about `limit` bytes of the text column, or one longer row. Bounds the memory of what follows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            hi = min(hi, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def values(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def key_runs(batches, keys: list[str], least: int = 200_000):
    """Tables of whole runs of equal keys, about `least` rows each, from batches that are sorted by the keys.

    A run longer than that comes as one table.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(tab: pa.Table) -> int:
        """First row of the last run."""
        n = tab.num_rows
        same = np.ones(n, bool)
        for k in keys:
            col = tab.column(k).to_numpy(zero_copy_only=False)
            same &= col == col[-1]
        return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            tab = pa.Table.from_batches(held).combine_chunks()
            at = cut(tab)
            if at:
                yield tab.slice(0, at)
                held = tab.slice(at).combine_chunks().to_batches()
                rows = tab.num_rows - at
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


# --- words and hashes ---------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers, by shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte at each of 64 places: words are told apart by sums of these, which no repeating pattern of letters defeats.
_CHUNK = 64
_AT = mix(np.arange(1, 256 * _CHUNK + 1, dtype=np.uint64))


def run_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes (at least one), sound for any content: tabulated sums of 64 bytes, each mixed with its place, then added up."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    values64 = _AT[((place & (_CHUNK - 1)) << 8) | data[np.repeat(start, size) + place]]
    if size.max() <= _CHUNK:
        sums = mix(np.add.reduceat(values64, first) + np.uint64(1))
    else:
        each = -(-size // _CHUNK)
        head = np.cumsum(each) - each
        k = np.arange(int(each.sum())) - np.repeat(head, each)
        sums = np.add.reduceat(mix(np.add.reduceat(values64, np.repeat(first, each) + _CHUNK * k) + (k + 1).astype(np.uint64)), head)
    return mix(sums + size.astype(np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            out = np.ones(size, np.uint64)
            done, step = 1, base
            while done < size:  # doubling: out[done:2*done] = out[:done] * base**done
                m = min(done, size - done)
                out[done : done + m] = out[:m] * step
                step = np.uint64(int(step) ** 2 % (1 << 64))
                done += m
            _powers[name] = out
    return _powers["up"], _powers["down"]


def span_hash(values64: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a sequence of 64-bit values: differences of one running polynomial sum, so any span costs O(1)."""
    up, down = powers(len(values64) + 1)
    sums = np.zeros(len(values64) + 1, np.uint64)
    np.cumsum(values64 * up[: len(values64)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a piece of rows: start and end byte of each, its row, and the first word of each row.

    Words are the maximal runs of bytes other than space and 0x09-0x0D, as in the contracts; texts are whole.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offs = offs
        n = len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before[edge[:-1]] = False
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        after[edge[1:]] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offs)  # first word of each row, and the total
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return run_hash(self.data, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def shingles(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all n-word shingles, repeats included; a row of fewer words (but some) gives its whole sequence."""
    count, first = words.counts(), words.first[:-1]
    full = np.maximum(count - n + 1, 0)
    short = (count > 0) & (count < n)
    each = np.where(short, 1, full)
    row = np.repeat(np.arange(len(count)), each)
    at = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each))
    end = at + np.where(short, count, n)[row]
    return span_hash(hashes, at, end), row
