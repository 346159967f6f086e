"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits and bias correction.

Nulls are empty texts. A text of fewer words than a shingle is one shingle; a text without words has the empty fingerprint, which is like another
empty one (1.0) and unlike any other (0.0). Equal texts have equal fingerprints. Ids may repeat or be null (nulls first); extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffers, clean_text, mix, pieces, shingles, table, values

BINS, KEEP = 256, 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SALT = mix(np.arange(7001, 7001 + BINS, dtype=np.uint64))
#: For each bin, all bins in an order of its own.
_TURNS = np.argsort(mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS), axis=1)


def sketch(data: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Low-order KEEP bits of each bin's minimum, rows x BINS, and whether a row has any shingle.

    Each shingle is hashed once: its high bits name the bin, its low bits compete for the bin's minimum. An empty bin takes the value of the first
    filled bin in an order of bins drawn for it alone, the same for all texts (optimal densification). The bits are those of the value mixed with the bin,
    so that two shingles that fill many bins of short texts don't agree by chance in all of these at once.
    """
    words = Words(data, offs)
    hashes, row = shingles(words, words.hashes(), n)
    rows = len(offs) - 1
    shift = np.uint64(64 - BINS.bit_length() + 1)
    low = np.full(rows * BINS, _NONE)
    np.minimum.at(low, row * BINS + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    low = low.reshape(rows, BINS)
    filled = low != _NONE
    some = filled.any(axis=1)
    out = low.copy()
    r, b = np.nonzero(~filled & some[:, None])
    for t in range(12):  # most bins find a filled one soon
        ok = filled[r, _TURNS[b, t]]
        out[r[ok], b[ok]] = low[r[ok], _TURNS[b[ok], t]]
        r, b = r[~ok], b[~ok]
    for at in range(0, len(r), 1 << 15):
        x, y = r[at : at + (1 << 15)], b[at : at + (1 << 15)]
        to = _TURNS[y, np.argmax(filled[x[:, None], _TURNS[y]], axis=1)]
        out[x, y] = low[x, to]
    bits = (mix(out ^ _SALT) & np.uint64((1 << KEEP) - 1)).astype(np.uint8)
    bits[~some] = 0
    return bits, some


def packed(bits: np.ndarray, some: np.ndarray) -> list[str]:
    """Hex fingerprints: a leading byte 01 (00: no words), then the bins' bits, packed."""
    wide = np.unpackbits(bits[:, :, None], axis=2)[:, :, 8 - KEEP :].reshape(len(bits), -1)
    flat = np.concatenate([some.astype(np.uint8)[:, None], np.packbits(wide, axis=1)], axis=1)
    return [x.tobytes().hex() for x in flat]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of fingerprints' rows: the share of equal bins, less the share 2**-KEEP of unlike bins that agree by chance."""
    chance = 2.0**-KEEP
    raw = ((a == b).mean(axis=1) - chance) / (1 - chance)
    both = a_some & b_some
    return np.where(both, np.clip(raw, 0, 1), (a_some == b_some).astype(float))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", shingle: int = 5) -> DataFrame:
    """(id, fingerprint) of every whole text, without a shuffle."""

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([values(b, id_col), pa.array(packed(*sketch(*buffers(values(b, "text")), shingle)))], names=[id_col, "fingerprint"])

    return clean_text(docs, id_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, fingerprint string")


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def with_successor(docs: DataFrame, fn, schema: str, id_col: str = "doc_id", rows_per_block: int = 400, max_blocks: int = 10_000) -> DataFrame:
    """Runs fn(ids, texts, next_texts) over all documents in ascending order of id, cyclic: one shuffle of the texts and no window over everything.

    Ids are cut into blocks at values that occur; the first document of each block also goes to the block before, as its end. Blocks are many, so
    they spread evenly over tasks; a task streams its sorted rows.
    """
    count = docs.count()
    n = max(1, min(max_blocks, count // rows_per_block))
    cuts = docs.select(F.percentile_approx(id_col, [i / n for i in range(n)], 100 * n).alias("q"), F.min(id_col).alias("low")).first()
    edges = np.unique(np.array([cuts["low"], *(cuts["q"] or [])][: n + 1] if cuts["low"] is not None else [0], np.int64))
    last = len(edges) - 1
    has_null = docs.where(F.col(id_col).isNull()).limit(1).count() > 0

    @F.pandas_udf("array<int>")
    def blocks(ids: pd.Series) -> pd.Series:
        """The id's block, and, for a block's first id, -1 - the block before."""
        x = ids.fillna(np.iinfo(np.int64).min).astype(np.int64).to_numpy() if ids.isna().any() else ids.to_numpy(np.int64)
        at = np.maximum(np.searchsorted(edges, x, "right") - 1, 0)
        starts = (x == edges[at]) & (not has_null or at > 0) | ids.isna().to_numpy()
        return pd.Series([[b, -1 - (b - 1 if b else last)] if s else [b] for b, s in zip(at.tolist(), starts.tolist(), strict=True)])

    rows = clean_text(docs, id_col).withColumn("b", F.explode(blocks(id_col)))
    rows = rows.select(id_col, "text", (F.col("b") < 0).alias("extra"), F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")).alias("block"))

    def run(batches):
        held = None  # the last row so far: block, extra, id, text
        for b in pieces(batches):
            rows = list(zip(values(b, "block").to_pylist(), values(b, "extra").to_pylist(), values(b, id_col).to_pylist(), values(b, "text").to_pylist(), strict=True))
            rows = ([held] if held else []) + rows
            held = rows[-1]
            take = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            if take:
                yield fn([rows[i][2] for i in take], [rows[i][3] for i in take], [rows[i + 1][3] for i in take])

    return rows.repartition("block").sortWithinPartitions("block", "extra", id_col, "text").mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(ids, texts, following):
        new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        raw = [t.encode() for t in texts]
        # rows follow each other, so the next row's text is mostly the next one's own
        n = len(ids)
        chain = [*raw]
        ahead = []
        for i, f in enumerate(following):
            if i + 1 < n and texts[i + 1] is f:
                ahead.append(i + 1)
            else:
                ahead.append(len(chain))
                chain.append(f.encode())
        fp, some = sketch(*_join(chain))
        efp, esome = sketch(*_join([t.encode() for t in new]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                pa.array(packed(fp[:n], some[:n])),
                pa.array(packed(efp, esome)),
                pa.array(likeness(fp[:n], some[:n], efp, esome)),
                pa.array(likeness(fp[:n], some[:n], fp[ahead], some[ahead])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(table(spark, sf_dir, "documents").select("doc_id", "text"), run, schema)
