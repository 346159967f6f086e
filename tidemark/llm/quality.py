"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then both score every document.

Nulls: a null text is empty, a null language or source is a value of its own, null labels are left out. Without labels of both classes a target
cannot be learned: its probability is constant, and it rejects nothing. Repeated rows score alike; extra columns pass through, but for names of results.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, buffers, pieces, table, values, written

TARGETS = ("quality", "toxic")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "mark": b"#$%&*", "cry": b"!?", "bar": b"|", "line": b"\n", "point": b".,;:", "wide": range(128, 256), "other": b"<>{}[]()=\"'/\\@^~`_+-"}
_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate(_CLASSES.values()):
    _CLASS[list(_set)] = _i + 1


def letter_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the lower-cased letter runs of each row, repeats included."""
    words = Words(np.where(_LETTER[data], data, 32).astype(np.uint8), offs, lower=True)
    return words.row, words.hashes()


def chosen_words(data: np.ndarray, offs: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the chosen words that each row has, once each, in order. `chosen` is sorted."""
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, h = letter_words(data, offs)
    maybe = np.zeros(1 << 16, bool)
    maybe[(chosen & np.uint64(0xFFFF)).astype(int)] = True
    some = maybe[(h & np.uint64(0xFFFF)).astype(np.int64)]
    row, h = row[some], h[some]
    at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
    hit = chosen[at] == h
    own = np.unique(row[hit] * len(chosen) + at[hit])
    return own // len(chosen), own % len(chosen)


KINDS = len(_CLASSES)


def char_shares(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Roots of the shares of kinds of characters."""
    n, size = len(offs) - 1, np.diff(offs)
    kind = np.bincount(np.repeat(np.arange(n), size) * (KINDS + 1) + _CLASS[data], minlength=n * (KINDS + 1)).reshape(n, -1)[:, 1:]
    return np.sqrt(kind / np.maximum(size, 1)[:, None]).astype(np.float32)


NUMBERS, LANGS, SOURCES = 4, 8, 16
META = NUMBERS + LANGS + SOURCES


def layout(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Length, mean word, share of distinct words, words a line."""
    n = len(offs) - 1
    words = Words(data, offs)
    count, size = words.counts(), np.diff(offs)
    # a row's words told apart by 40 bits of their hash, which is enough for a share
    key = np.sort((words.row.astype(np.uint64) << np.uint64(40)) | (words.hashes() >> np.uint64(24)))
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    lines = np.bincount(np.repeat(np.arange(n), size)[data == 10], minlength=n)
    return np.stack([np.log1p(size) / 10, np.minimum(size / np.maximum(count, 1), 40) / 10, distinct / np.maximum(count, 1), np.log1p(count / (lines + 1)) / 5], 1).astype(np.float32)


def slot(x: str | None, width: int) -> int:
    """Place of a name among `width`; null is a name of its own."""
    return zlib.crc32(b"\0" if x is None else b"\1" + x.encode()) % width


def features(b: pa.RecordBatch, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (text, lang, source): rows and places of chosen words, numbers (kinds of characters, then layout), and slots of language and source."""
    data, offs = buffers(values(b, "text"))
    row, at = chosen_words(data, offs, chosen)
    names = [[slot(x, width) for x in values(b, c).to_pylist()] for c, width in (("lang", LANGS), ("source", SOURCES))]
    return row, at, np.hstack([char_shares(data, offs), layout(data, offs)]), np.array(names, np.uint8).reshape(2, -1).T


def views(n: int, words: int, row: np.ndarray, at: np.ndarray, numbers: np.ndarray, slots: np.ndarray) -> list[np.ndarray]:
    """The text view (chosen words, kinds of characters) and the metadata view (layout, language, source) as matrices."""
    text, meta = np.zeros((n, words + KINDS), np.float32), np.zeros((n, META), np.float32)
    text[row, at] = 1
    text[:, words:] = numbers[:, :KINDS]
    meta[:, :NUMBERS] = numbers[:, KINDS:]
    meta[np.arange(n), NUMBERS + slots[:, 0].astype(int)] = 1
    meta[np.arange(n), NUMBERS + LANGS + slots[:, 1].astype(int)] = 1
    return [text, meta]


# --- fitting: labelled rows on the driver, all others by sums from Spark ---------------------------------------------------------


def sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, w: float | np.ndarray = 1.0, step: int = 2048) -> np.ndarray:
    """Gradient (first row) and curvature of the log likelihood at beta, bias last; rows in bounded pieces."""
    out = np.zeros((len(beta) + 1, len(beta)))
    for lo in range(0, len(x), step):
        z = np.hstack([x[lo : lo + step].astype(np.float64), np.ones((len(x[lo : lo + step]), 1))])
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        out[0] += z.T @ (w * (y[lo : lo + step] - p))
        out[1:] += (z * (w * p * (1 - p))[:, None]).T @ z
    return out


def newton(beta: np.ndarray, total: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A bounded Newton step of a ridge logistic regression, and its size."""
    pull = np.full(len(beta), ridge)
    pull[-1] = 1e-3
    step = np.linalg.solve(total[1:] + np.diag(pull), total[0] - pull * beta)
    return beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max())), float(np.abs(step).max())


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 12) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        beta, size = newton(beta, sums(x, y, beta), ridge)
        if size < 1e-6:
            break
    return beta


def logit(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.clip(x @ beta[:-1].astype(np.float32) + np.float32(beta[-1]), -30, 30)


@dataclass
class CoModel:
    """Of one target: a weight vector for each view, and the combination of their calibrated logits."""

    views: list[np.ndarray]
    joint: np.ndarray

    def scores(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of the views, and the combined probability."""
        z = [logit(x, b) for x, b in zip(xs, self.views, strict=True)]
        return z[0], z[1], 1 / (1 + np.exp(-np.clip(np.stack(z, 1) @ self.joint[:-1] + self.joint[-1], -30, 30)))


def start(xs: list[np.ndarray], y: np.ndarray, sure: float, least: int = 20) -> tuple[CoModel, list[list[float]]] | None:
    """Both views from the labels alone, their calibrated combination, and for each view and class the logit from which on it may label for the other.

    Calibration and cuts rest on logits of rows that the fit had not seen: two halves, each scored by the other's model. A view's labels of a class count
    from the least logit (3 at least) at which, among at least `least` such rows, a share of `sure` was right; infinite where there is none.
    """
    if len(y) < 10 or y.min() == y.max():
        return None
    half = np.arange(len(y)) % 2 == 0
    out = np.zeros((len(y), 2))
    for rows in (half, ~half):
        for v in (0, 1):
            out[~rows, v] = logit(xs[v][~rows], fit_logit(xs[v][rows], y[rows]))
    cuts = []
    for v in (0, 1):
        cuts.append([])
        for label in (0, 1):
            z = out[:, v] if label else -out[:, v]
            order = np.argsort(-z, kind="stable")
            n = np.arange(1, len(z) + 1)
            good = (n >= least) & (np.cumsum(y[order] == label) >= sure * n) & (z[order] >= 3)
            cuts[v].append(float(z[order][np.flatnonzero(good)[-1]]) if good.any() else float("inf"))
    return CoModel([fit_logit(x, y) for x in xs], fit_logit(out, y, ridge=0.01)), cuts


@dataclass
class QualityModel:
    chosen: np.ndarray
    targets: dict[str, CoModel | None]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_labels: int = 10_000, max_words: int = 256, rounds: int = 2, steps: int = 2, weight: float = 0.3, sure: float = 0.99, ridge: float = 2.0) -> QualityModel:
    """Fits on at most `max_labels` labelled documents, taken in order of a hash of the id, and on all other documents by what the views label for each other.

    Only the labelled sample's features come to the driver; words are chosen by Spark counts over it. Every document's features, some 150 bytes, are
    written once. In each round every unlabelled document is scored by both views; where one is sure, the document counts for the other, in Newton steps
    whose gradient and curvature are summed by Spark: what comes to the driver has the size of the model. What a view labels with a class weighs at most
    `weight` times the labelled rows of that class, however many documents there are, and counts only where the view is sure of some of the other class too.
    """
    order = F.xxhash64(id_col)
    labelled = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.min(t).cast("int").alias(t) for t in TARGETS]).orderBy(order, id_col).limit(max_labels)
    sample = written(labelled, "labels")
    plain = docs.select(id_col, F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang", "source")).alias("m")  # of several texts of an id always the same
    rows = written(plain.join(F.broadcast(sample), id_col).groupBy(id_col, *TARGETS).agg(one).select(id_col, *TARGETS, "m.text", "m.lang", "m.source"), "sample-docs")  # at most max_labels rows

    def words(batches):
        for b in pieces(batches):
            r, h = letter_words(*buffers(values(b, "text")))
            own = np.unique(np.stack([r.astype(np.uint64), h], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
            cols = [pa.array(own[:, 1].copy().view(np.int64))] + [values(b, t).take(pa.array(own[:, 0].astype(np.int64))) for t in TARGETS]
            yield pa.RecordBatch.from_arrays(cols, names=["h", *TARGETS])

    n = rows.agg(*[F.count(t).alias(f"n_{t}") for t in TARGETS], *[F.coalesce(F.sum(t), F.lit(0)).alias(f"p_{t}") for t in TARGETS]).first()
    counts = written(rows.select("text", *TARGETS).mapInArrow(words, "h long, quality int, toxic int").groupBy("h").agg(*[F.count(t).alias(f"n_{t}") for t in TARGETS], *[F.coalesce(F.sum(t), F.lit(0)).alias(f"p_{t}") for t in TARGETS]), "words")
    picked: set[int] = set()
    for t in TARGETS:
        if not n[f"n_{t}"] or n[f"p_{t}"] in (0, n[f"n_{t}"]):
            continue
        rate = n[f"p_{t}"] / n[f"n_{t}"]
        z = (F.col(f"p_{t}") - F.col(f"n_{t}") * rate) / F.sqrt(F.col(f"n_{t}") * rate * (1 - rate) + 1)
        best = counts.where(F.col(f"n_{t}") >= 4).select("h", F.abs(z).alias("z")).where("z >= 4").orderBy(F.desc("z"), "h").limit(max_words).collect()
        picked |= {r["h"] for r in best}
    chosen = np.sort(np.array(sorted(picked), np.int64).view(np.uint64))

    def compact(batches):
        """A document's features in few bytes: places of its chosen words, numbers, slots."""
        for b in pieces(batches):
            row, at, numbers, slots = features(b, chosen)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            at = at.astype("<u2")
            cols = [values(b, c) for c in (id_col, *TARGETS)]
            cols += [pa.array([at[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary()), pa.array([x.tobytes() for x in numbers], pa.binary()), pa.array([x.tobytes() for x in slots], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *TARGETS, "words", "numbers", "slots"])

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, quality int, toxic int, words binary, numbers binary, slots binary"
    marked = sample.select(F.col(id_col).alias("__id"))

    def matrices(tab) -> list[np.ndarray]:
        n = tab.num_rows
        own = [np.frombuffer(x, "<u2") for x in tab.column("words").to_pylist()]
        row = np.repeat(np.arange(n), [len(x) for x in own])
        at = np.concatenate([*own, np.zeros(0, np.uint16)]).astype(np.int64)
        numbers = np.frombuffer(b"".join(tab.column("numbers").to_pylist()), np.float32).reshape(n, KINDS + NUMBERS)
        slots = np.frombuffer(b"".join(tab.column("slots").to_pylist()), np.uint8).reshape(n, 2)
        return views(n, len(chosen), row, at, numbers, slots)

    got = rows.select(id_col, *TARGETS, "text", "lang", "source").mapInArrow(compact, schema).toArrow().sort_by(id_col)
    xs = matrices(got)
    models, cuts, truth = {}, {}, {}
    for t in TARGETS:
        y = np.array([-1 if v is None else v for v in got[t].to_pylist()], int)
        use = y >= 0
        begun = start([x[use] for x in xs], y[use].astype(float), sure) if use.any() else None
        models[t] = begun[0] if begun else None
        if begun:
            cuts[t], truth[t] = begun[1], (use, y[use].astype(float))
    model = QualityModel(chosen, models)
    teaching = [t for t in cuts if any(c < float("inf") for view in cuts[t] for c in view)]
    if not teaching or not rounds:
        return model
    rest = plain.join(F.broadcast(marked), plain[id_col] == marked["__id"], "left_anti").select(F.lit(None).cast(dict(docs.dtypes)[id_col]).alias(id_col), *[F.lit(None).cast("int").alias(t) for t in TARGETS], "text", "lang", "source")
    pool = written(rest.mapInArrow(compact, schema).select("words", "numbers", "slots"), "pool")
    for _ in range(rounds):
        teachers = {t: list(models[t].views) for t in teaching}
        for _ in range(steps):
            totals = taught(pool, matrices, teachers, cuts, models)
            for t in teaching:
                use, y = truth[t]
                for v in (0, 1):
                    total = sums(xs[v][use], y, models[t].views[v])
                    both = [totals.get((t, v, label)) for label in (0, 1)]
                    if all(both):  # a view that is sure of one class only would shift the other's balance
                        for label, (n_rows, more) in enumerate(both):
                            total += more * (weight * min(1.0, (y == label).sum() / n_rows))
                    models[t].views[v] = newton(models[t].views[v], total, ridge)[0]
    return model


def taught(pool: DataFrame, matrices, teachers: dict, cuts: dict, models: dict) -> dict[tuple[str, int, int], tuple[int, np.ndarray]]:
    """For each target, learning view and class: how many documents the other view is sure of, and their sums at the learner's weights.

    Tasks add up their documents; Spark adds up the tasks, some rows of a matrix at a time.
    """
    betas = {t: list(models[t].views) for t in teachers}
    names = list(teachers)

    def run(batches):
        acc: dict[tuple[int, int, int], np.ndarray] = {}
        count: dict[tuple[int, int, int], int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            xs = matrices(b)
            for i, t in enumerate(names):
                for v in (0, 1):
                    z = logit(xs[1 - v], teachers[t][1 - v])
                    for label in (0, 1):
                        sure = (z if label else -z) >= cuts[t][1 - v][label]
                        if sure.any():
                            k = (i, v, label)
                            got = sums(xs[v][sure], np.full(sure.sum(), float(label)), betas[t][v])
                            acc[k] = acc[k] + got if k in acc else got
                            count[k] = count.get(k, 0) + int(sure.sum())
        for k, total in acc.items():
            for at in range(0, len(total), 64):
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in k), pa.array([at]), pa.array([count[k]], pa.int64()), pa.array([total[at : at + 64].tobytes()], pa.binary())], names=["target", "view", "label", "at", "n", "part"])

    def added(key: tuple, tab: pa.Table) -> pa.Table:
        total = None
        for x in tab["part"]:
            part = np.frombuffer(x.as_py(), np.float64)
            total = part.copy() if total is None else total + part
        return pa.table({"target": pa.array([key[0].as_py()], pa.int32()), "view": pa.array([key[1].as_py()], pa.int32()), "label": pa.array([key[2].as_py()], pa.int32()), "at": [key[3].as_py()], "n": pa.array([sum(tab["n"].to_pylist())], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

    schema = "target int, view int, label int, at long, n long, part binary"
    got = pool.mapInArrow(run, schema).groupBy("target", "view", "label", "at").applyInArrow(added, schema).collect()  # as many numbers as eight curvature matrices have
    out: dict = {}
    for r in sorted(got, key=lambda r: (r["target"], r["view"], r["label"], r["at"])):
        d = len(betas[names[r["target"]]][r["view"]])
        part = np.frombuffer(r["part"], np.float64).reshape(-1, d)
        key = (names[r["target"]], r["view"], r["label"])
        out[key] = (r["n"], np.vstack([out[key][1], part]) if key in out else part)
    return out


def _scored(b: pa.RecordBatch, model: QualityModel) -> tuple[list[np.ndarray], np.ndarray]:
    """Both views' logits and the probability of each target, and whether a row is good and not toxic."""
    xs = views(b.num_rows, len(model.chosen), *features(b, model.chosen))
    cols, keep = [], np.ones(b.num_rows, bool)
    for t in TARGETS:
        m = model.targets[t]
        z = m.scores(xs) if m else (np.zeros(b.num_rows),) * 2 + (np.full(b.num_rows, 1.0 if t == "quality" else 0.0),)
        keep &= (z[2] >= 0.5) == (t == "quality")
        cols += [np.asarray(v, np.float64) for v in z]
    return cols, keep


ADDED = [f"{t}_{x}" for t in TARGETS for x in ("text", "meta", "p")]


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with, for each target, both views' logits and the combined probability, and `keep`: good by quality and not toxic.

    A column of docs that has the name of one of these is replaced by it.
    """
    docs = docs.drop(*ADDED, "keep")

    def run(batches):
        for b in pieces(batches):
            cols, keep = _scored(b, model)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in cols), pa.array(keep)], names=[*b.schema.names, *ADDED, "keep"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ADDED], T.StructField("keep", T.BooleanType())]))


def kept(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs' rows that are good and not toxic, with all columns as they are."""

    def run(batches):
        for b in pieces(batches):
            yield b.filter(pa.array(_scored(b, model)[1]))

    return docs.mapInArrow(run, docs.schema)


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).drop("text", "lang", "source")
