"""Substring dedup by seed and extend.

Documents meet on winnowed anchors (seeds.py). Within an anchor's group the documents are aligned at the anchor and
extended by words to the left and to the right; what agrees with an earlier document over at least `window` words is a
repeat, and overlapping repeats join to maximal ones.

Defined results: null text counts as empty, with zero words; texts under `window` words lose nothing; a null doc_id
counts as the largest; rows with equal doc_id never remove words from each other; identical rows get equal results;
an empty table gives an empty result. Columns other than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.common import table
from tidemark.llm.seeds import LAST, Plan, keyed, ranges, repeated, runs, whole_keys

_OTHER = 0xA0761D6478BD642F | 1


def _extend(plan: Plan):
    """Windows of each anchor group, as far as the extensions reach, against the smallest document that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches):
            off, raw = K.texts(t.column("snippet").combine_chunks().view(pa.string()) if t.num_rows else pa.array([], pa.string()))
            raw, off = raw[off[0] : off[-1]], off - off[0]
            starts, ends, woff = K.words(raw, off)
            values = K.word_hashes(raw, starts, ends)
            n = t.column("n").to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = woff[row] + step
            one, two = K.grams(values, plan.window)[at], K.grams(values, plan.window, _OTHER)[at]
            key, doc, rk = (t.column(c).to_numpy() for c in ("key", "doc", "rk"))
            o = np.lexsort((doc[row], two, one, key[row]))
            new = np.ones(len(o), bool)
            new[1:] = (one[o][1:] != one[o][:-1]) | (two[o][1:] != two[o][:-1]) | (key[row][o][1:] != key[row][o][:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
            later = np.zeros(len(o), bool)
            later[o] = doc[row][o] > doc[row][o][first]
            place = t.column("place").to_numpy()[row] + step
            a, z = runs(later, row, place)
            yield ranges(rk[row[a]], place[a], place[z] + plan.window)

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words in their ranges."""
    for b in batches:
        off, raw = K.texts(b.column("text"))
        spans = b.column("spans")
        soff = np.asarray(spans.offsets)
        s0, s1 = (np.asarray(spans.values.field(c)).astype(np.int64) for c in ("s0", "s1"))
        null = np.asarray(spans.is_null())
        out: list[list] = [[], [], []]
        for i, j in K.chunks(off):
            base = raw[off[i] : off[j]]
            data = base.tobytes()
            starts, ends, woff = K.words(base, off[i : j + 1] - off[i])
            for r in range(i, j):
                x, y = woff[r - i], woff[r - i + 1]
                us, ue, n = starts[x:y], ends[x:y], int(y - x)
                if null[r] or soff[r] == soff[r + 1]:
                    keep = np.ones(n, bool)
                else:
                    keep = ~K.covered(n, s0[soff[r] : soff[r + 1]], s1[soff[r] : soff[r + 1]])
                out[0].append(n)
                out[1].append(n - int(keep.sum()))
                out[2].append(b" ".join([data[p:q] for p, q in zip(us[keep].tolist(), ue[keep].tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 50, anchor: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space, as UTF-8 bytes) of each row.

    A word goes if a run of `window` words that covers it also starts in a document with a smaller id.
    anchor: words in an anchor, under window.
    """
    plan = Plan("word", window, anchor, within=False)
    named = keyed(docs, text, doc_id)
    spans = repeated(named, plan, _extend).groupBy("rk").agg(F.collect_list(F.struct("s0", "s1")).alias("spans"))
    out = named.join(spans, "rk", "left").select("doc", "text", "spans").mapInArrow(_keep, "doc long, n_words long, n_removed long, kept binary")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by spaces) of each document, with windows of 50 words."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
