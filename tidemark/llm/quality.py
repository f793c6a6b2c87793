"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are bounded in number. Cosine features approximate a Gaussian kernel over the
standardised statistics; each task sums its rows' normal equations (a fixed square matrix), the driver adds them and
solves the ridge system; a histogram of raw scores, summed the same way, is calibrated by pooling adjacent violators.

Defined results: null text scores as empty; labels that are null, or of no document, are ignored, and repeated ones
count each; without any label all scores are the prior 0.5; an empty table gives an empty result. Label columns and
others never enter a score, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.common import arrow_rows, materialize, table

_CLASS = np.zeros(256, np.uint8)  # byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence marks, 7 other ASCII marks, 8 beyond ASCII
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, 0x09, 0x0B, 0x0C]] = 4
_CLASS[[0x0A, 0x0D]] = 5
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 6
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS[128:] = 8
KINDS = 9
STATS = KINDS + 12


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATS numbers for each text; off begins at 0."""
    rows = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(rows), size)
    share = np.bincount(row * KINDS + _CLASS[raw], minlength=rows * KINDS).reshape(rows, KINDS) / np.maximum(size, 1)[:, None]
    marks = np.bincount(row * 256 + raw, minlength=rows * 256).reshape(rows, 256) / np.maximum(size, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(marks * np.log2(marks), axis=1)
    top_mark = marks[:, _CLASS == 7].max(axis=1, initial=0)
    starts, ends, woff = K.words(raw, off)
    words = np.diff(woff)
    wrow = np.repeat(np.arange(rows), words)
    length = ends - starts
    safe = np.maximum(words, 1)
    mean = np.bincount(wrow, length, rows) / safe
    spread = np.sqrt(np.maximum(np.bincount(wrow, length.astype(float) ** 2, rows) / safe - mean**2, 0))

    def repeats(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of distinct values and of the most frequent one, by row."""
        n = np.maximum(np.bincount(at, minlength=rows), 1)
        if not len(hashes):
            return np.ones(rows), np.zeros(rows)
        o = np.lexsort((hashes, at))
        new = np.ones(len(o), bool)
        new[1:] = (hashes[o][1:] != hashes[o][:-1]) | (at[o][1:] != at[o][:-1])
        f = np.flatnonzero(new)
        most = np.zeros(rows)
        np.maximum.at(most, at[o][f], np.diff(np.append(f, len(o))))
        return np.bincount(at[o][f], minlength=rows) / n, most / n

    hashes = K.word_hashes(raw, starts, ends)
    distinct, top = repeats(hashes, wrow)
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) else hashes
    inner = np.flatnonzero(wrow[:-1] == wrow[1:]) if len(hashes) else np.zeros(0, np.int64)
    distinct2, top2 = repeats(pairs[inner], wrow[inner])
    tail = ends - 1
    ends_marked = np.bincount(wrow, _CLASS[raw[tail]] == 7, rows) / safe if len(tail) else np.zeros(rows)
    shout = np.bincount(wrow, (_CLASS[raw[starts]] == 2) & (length > 1) & (_CLASS[raw[np.minimum(starts + 1, len(raw) - 1)]] == 2), rows) / safe if len(tail) else np.zeros(rows)
    lines = np.bincount(row, raw == 0x0A, rows) + 1 if len(raw) else np.ones(rows)
    return np.column_stack([share, np.log1p(size), np.log1p(words), mean, spread, entropy / 8, top_mark, distinct, top, distinct2, top2, ends_marked + 2 * shout, np.log1p(size / lines)])


def document_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, columns of keep, and stats array<double> of each row."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, raw = K.texts(b.column(b.num_columns - 1))
            for i, j in K.chunks(off):
                x = statistics(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(b.num_columns - 1)), flat], names=[doc_id, *keep, "stats"])

    arrow_rows(docs.sparkSession)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (doc_id, *keep)) + ", stats array<double>"
    return docs.select(doc_id, *keep, text).mapInArrow(run, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # STATS x features
    phase: np.ndarray
    ridge: np.ndarray
    edges: np.ndarray  # of raw scores
    level: np.ndarray  # calibrated score of each cell

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.weight + self.phase) * np.sqrt(2 / len(self.phase)), z, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.level), 0, 1)


def pool_adjacent_violators(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to value by weighted squares."""
    out: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        out.append([v, w, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            v2, w2, n2 = out.pop()
            v1, w1, n1 = out[-1]
            out[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in out]) if out else np.zeros(0)


def _stacked(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column("stats").flatten()).reshape(-1, STATS)


def _sums(rows: DataFrame, f, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over tasks of f(stats, label), a fixed-size array; Spark adds them up by place, the driver gets one."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += f(_stacked(b), b.column("label").to_numpy(zero_copy_only=False).astype(float))
        flat = total.ravel()
        for i in range(0, size, 4096):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([flat[i : i + 4096].tolist()])], names=["at", "part"])

    parts = rows.select("stats", "label").mapInArrow(run, "at long, part array<double>")
    added = parts.select("at", F.posexplode("part").alias("i", "x")).groupBy((F.col("at") + F.col("i")).alias("at")).agg(F.sum("x").alias("x"))
    out = np.zeros(size)
    for at, x in added.collect():  # `size` numbers, whatever the input
        out[at] = x
    return out.reshape(shape)


def fit(rows: DataFrame, features: int = 192, gamma: float = 0.05, ridge: float = 1.0, cells: int = 400, seed: int = 7) -> Model | None:
    """A model from rows (stats, label 0 or 1); None if there are none. Sums run over all rows."""
    m = _sums(rows, lambda x, _: np.stack([np.full(STATS, len(x)), x.sum(0), (x**2).sum(0)]), (3, STATS))
    n = m[0, 0]
    if not n:
        return None
    mean = m[1] / n
    scale = np.sqrt(np.maximum(m[2] / n - mean**2, 1e-6))
    r = np.random.default_rng(seed)
    model = Model(mean, scale, r.normal(0, np.sqrt(2 * gamma), (STATS, features)), r.uniform(0, 2 * np.pi, features), np.zeros(features + STATS + 1), np.zeros(0), np.zeros(0))
    d = len(model.ridge)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        return np.vstack([f.T @ f, f.T @ y])

    a = _sums(rows, normal, (d + 1, d))
    model.ridge = np.linalg.solve(a[:d] + ridge * np.eye(d), a[d])
    low, high = -0.5, 1.5
    edges = np.linspace(low, high, cells + 1)

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cell = np.clip(((model.raw(x) - low) / (high - low) * cells).astype(int), 0, cells - 1)
        return np.stack([np.bincount(cell, minlength=cells), np.bincount(cell, y, cells)])

    h = _sums(rows, histogram, (2, cells))
    model.edges = (edges[1:] + edges[:-1]) / 2
    prior = h[1].sum() / n
    model.level = pool_adjacent_violators((h[1] + 0.5 * prior) / (h[0] + 0.5), h[0] + 1e-3)
    return model


def classify(stats: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """stats with score (0 to 1) and predicted (1 if score >= threshold)."""
    names = [c for c in stats.columns if c != "stats"]
    schema = ", ".join(f"`{c}` {dict(stats.dtypes)[c]}" for c in names) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_stacked(b)) if model is not None and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return stats.mapInArrow(run, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    labels(doc_id, label). Rows whose crc32(id as text) modulo folds is `held` are never learned from.
    """
    stats = materialize(document_statistics(docs, text, doc_id), "statistics")
    held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == held, F.lit(False))
    known = labels.select(F.col(doc_id), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    model = fit(materialize(stats.where(~held_out).join(known, doc_id).select("stats", "label"), "labelled"))
    return classify(stats, model, threshold).select(doc_id, held_out.alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, as they are, that the classifier does not reject; it learns as in quality_classifier."""
    stats = document_statistics(docs, text, doc_id)
    known = labels.select(F.col(doc_id), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == held, F.lit(False))
    model = fit(materialize(stats.where(~held_out).join(known, doc_id).select("stats", "label"), "labelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, raw = K.texts(b.column(text))
            for i, j in K.chunks(off):
                score = model.score(statistics(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
                yield b.slice(i, j - i).filter(pa.array(score >= threshold))

    return docs if model is None else docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.3 on) of each document."""
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
