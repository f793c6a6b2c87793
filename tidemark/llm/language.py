"""Language identification by rank-order profiles.

A profile is a language's `size` most frequent n-grams in order. A document's own n-grams are ranked the same way;
its out-of-place distance to a profile is the sum of the rank differences, with the largest difference for an n-gram
that the profile lacks. The nearest profile wins. N-grams are runs of 1 to 3 letters of lower-cased words with their
word bounds. Counts cover all documents learned from: each task adds up its texts, Spark adds up the tasks.

Defined results: text that is null or has no letter gives `und` with score 0; equal distances go to the language first
in order; null lang is not learned from; with no language learned all results are `und`; an empty table gives an empty
result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.common import arrow_rows, table

BITS = 21  # a code point
N = 3


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 32."""
    out = np.full(0x110000, 32, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0])
    return out


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte each begins at."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    b = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int32)
    x, b1, b2, b3 = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
    return np.select([x < 0x80, x < 0xE0, x < 0xF0], [x, (x & 31) << 6 | b1, (x & 15) << 12 | b1 << 6 | b2], (x & 7) << 18 | b1 << 12 | b2 << 6 | b3), lead


def letter_runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as lower-case letters with one space before, between and after words, and the rows' offsets into them."""
    points, at = code_points(raw)
    x = _letters()[points]
    poff = np.searchsorted(at, off)
    # a space before each row, then runs of spaces cut to one
    rows = len(off) - 1
    y = np.full(len(x) + rows + 1, 32, np.int32)
    y[np.arange(len(x)) + np.repeat(np.arange(rows), np.diff(poff)) + 1] = x
    begin = poff[:-1] + np.arange(rows)
    keep = np.ones(len(y), bool)
    keep[1:] = (y[1:] != 32) | (y[:-1] != 32)
    keep[begin] = True
    place = np.cumsum(keep)
    return y[keep], np.append(place[begin] - 1, place[-1])


def ngrams(x: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of one text (letters and single spaces), with no space inside and not all space."""
    space = x == 32
    y = x.astype(np.int64)
    out = [y[~space]]
    if len(x) > 1:
        two = y[:-1] << BITS | y[1:]
        out.append((two | 1 << (2 * BITS))[~(space[:-1] & space[1:])])
    if len(x) > 2:
        three = y[:-2] << (2 * BITS) | y[1:-1] << BITS | y[2:]
        out.append(-three[~space[1:-1]])
    return np.concatenate(out)


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in order; equally frequent ones by code."""
    value, count = np.unique(codes, return_counts=True)
    return value[np.lexsort((value, -count))[:size]]


def learn(docs: DataFrame, text: str, lang: str, size: int) -> dict[str, np.ndarray]:
    """Each language's profile, at most `size` codes; counts over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            off, raw = K.texts(b.column("text"))
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            for i, j in K.chunks(off):
                x, xoff = letter_runs(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                for name in dict.fromkeys(langs[i:j]):
                    rows = np.flatnonzero(langs[i:j] == name)
                    v, n = np.unique(ngrams(np.concatenate([x[xoff[r] : xoff[r + 1]] for r in rows])), return_counts=True)
                    if name in total:
                        v0, n0 = total[name]
                        v, at = np.unique(np.concatenate([v0, v]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([n0, n])).astype(np.int64)
                    total[name] = (v, n)
                    if len(v) > 200_000:  # send what has gathered; Spark adds the parts
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(v), pa.array(n)], names=["lang", "code", "n"])
                        del total[name]
        for name, (v, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(v), pa.array(n)], names=["lang", "code", "n"])

    counts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null").mapInArrow(run, "lang string, code long, n long")
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    out: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():  # size rows for each language
        out.setdefault(r["lang"], []).append(r["code"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def classify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str, doc_id: str, size: int) -> DataFrame:
    names = sorted(profiles)
    codes = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.zeros(0, np.int64)
    place = np.full((len(names), len(codes) + 1), -1, np.int64)  # rank of each code in each profile; last column: unknown
    for i, k in enumerate(names):
        place[i, np.searchsorted(codes, profiles[k])] = np.arange(len(profiles[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, raw = K.texts(b.column("text"))
            pred, score = [], []
            for i, j in K.chunks(off):
                x, xoff = letter_runs(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                for r in range(j - i):
                    own = x[xoff[r] : xoff[r + 1]]
                    if not names or not (own != 32).any():
                        pred.append("und"), score.append(0.0)
                        continue
                    top = ranked(ngrams(own), size)
                    at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
                    at = np.where(codes[at] == top, at, len(codes))
                    there = place[:, at]
                    far = np.where(there < 0, size, np.abs(there - np.arange(len(top)))).sum(axis=1) / (size * len(top))
                    best = int(far.argmin())
                    near = np.exp(-20 * (far - far[best]))
                    pred.append(names[best]), score.append(float(near[best] / near.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), "held_out", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", folds: int = 4, held: int = 2, size: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; rows whose crc32(id as text) modulo folds is `held` are not learned from."""
    arrow_rows(docs.sparkSession)
    held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == held, F.lit(False))
    profiles = learn(docs.where(~held_out), text, lang, size)
    return classify(docs.select(doc_id, text, held_out.alias("held_out")), profiles, text, doc_id, size)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    return language_id(table(spark, sf_dir, "documents"))
