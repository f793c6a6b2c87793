"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

The corpus is sharded by content first (seeds.py): all occurrences of a repeated 100-byte string meet in the shard of
its seed, as snippets. A shard's snippets get a suffix array and its Burrows-Wheeler transform. Breadth-first backward
extension then turns the intervals of all strings of length l into those of length l + 1: the rows whose preceding
byte is c, in the order of the last-to-first mapping, are the interval of c before the string. A boundary that first
shows at length l + 1 is a common prefix of l; intervals of one row go no further, and the expansion stops at the minimum
length, where the intervals left are the repeated strings; longer common prefixes are never computed.

Repeats whose whole surroundings (all windows of one seed) are alike are told by their 64-bit hash before any transform;
the expansion decides where surroundings differ.

Defined results: null text counts as empty; texts under `window` bytes lose nothing; a null doc_id counts as the
largest; identical rows (id and text) get equal results; rows with one id and different texts are ordered by a hash of
the text; an empty table gives an empty result. Other columns are ignored, so their names cannot clash.
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


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in order of their suffixes' first `depth` bytes, at least; for each row whether its first `known` bytes differ from the row's before; known, at most depth, from 8 on.

    Places double the bytes that they are sorted by; only those that equal another are sorted anew.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    have = 8
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    while True:
        known, at = new, have
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if have >= depth or not len(tied):
            return order, known, at
        ordered = np.cumsum(new)
        rank = np.empty(n, np.uint64)
        rank[order] = ordered
        place = order[tied]
        key = ordered[tied].astype(np.uint64) << np.uint64(32)
        further = place + have < n
        key[further] |= rank[place[further] + have]
        o = np.argsort(key, kind="stable")
        order[tied], key = place[o], key[o]
        new = new.copy()
        new[tied[1:]] |= key[1:] != key[:-1]
        have *= 2
        if have > depth:
            return order, known, at


def intervals(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of text (0 parts its strings) and, for each row, its interval of strings equal over `length` bytes.

    The array gives the intervals of the longest strings, up to `length`, whose order its sorting went through; they are
    extended from there. Only rows in intervals of two or more go on: what precedes a string that stands once stands once
    as well.
    """
    order, new, known = suffix_array(text, length)
    bwt = text[order - 1]
    before = np.empty(len(text), np.int64)  # row of the suffix that starts one byte earlier
    before[np.argsort(bwt, kind="stable")] = np.arange(len(text))
    live, group = np.arange(len(text)), np.zeros(len(text), np.int64)
    for have in range(known, length + 1):
        # a row goes on unless it and the next are both first of their intervals
        several = ~new
        several[:-1] |= ~new[1:]
        live, new = live[several], new[several]
        if have == length or not len(live):
            break
        group = np.cumsum(new)
        symbol = bwt[live]
        o = np.argsort(symbol, kind="stable")
        symbol, group, live = symbol[o], group[o], before[live[o]]
        new = np.ones(len(live), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
    out = np.arange(len(text))
    out[live] = len(text) + np.cumsum(new)
    return order, out


def _expand(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, 1 << 20):
            key = t.column("key").to_numpy()
            _, where, size = np.unique(key, return_inverse=True, return_counts=True)
            t = t.filter(pa.array(size[where] > 1)).combine_chunks()
            if not t.num_rows:
                continue
            off, raw = K.texts(t.column("snippet").combine_chunks().view(pa.string()))
            n, doc, rk, first = (t.column(c).to_numpy() for c in ("n", "doc", "rk", "place"))
            # bytes from 1, so that 0 can part the snippets; 255 never stands in UTF-8
            size = np.diff(off)
            begin = np.cumsum(size + 1) - (size + 1)
            text = np.zeros(int((size + 1).sum()), np.uint8)
            row_of = np.repeat(np.arange(len(size)), size)
            text[np.arange(len(row_of)) + row_of] = raw[off[0] : off[-1]] + 1
            order, group = intervals(text, plan.window)
            row = np.searchsorted(begin, order, "right") - 1
            step = order - begin[row]
            live = np.flatnonzero(step < n[row])
            row, step, group = row[live], step[live], group[live]
            place = first[row] + step
            o = np.lexsort((place, rk[row], doc[row], group))
            new = np.ones(len(o), bool)
            new[1:] = group[o][1:] != group[o][:-1]
            head = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
            later = (place[o] != place[head]) | (rk[row[o]] != rk[row[head]])
            hit = o[later]
            hit = hit[np.lexsort((place[hit], row[hit]))]
            if len(hit):
                a, z = runs(np.ones(len(hit), bool), row[hit], place[hit])
                yield ranges(rk[row[hit[a]]], place[hit[a]], place[hit[z]] + plan.window)

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes in their ranges."""
    for b in batches:
        off, raw = K.texts(b.column("text"))
        spans = b.column("spans")
        soff = np.asarray(spans.offsets)
        s0, s1 = (np.asarray(spans.values.field(c)).astype(np.int64) for c in ("s0", "s1"))
        null = np.asarray(spans.is_null())
        out: list[list] = [[], [], []]
        for r in range(b.num_rows):
            own = raw[off[r] : off[r + 1]]
            gone = np.zeros(len(own), bool)
            if not null[r] and soff[r] < soff[r + 1]:
                gone = K.covered(len(own), s0[soff[r] : soff[r + 1]], s1[soff[r] : soff[r + 1]])
            out[0].append(int(gone.sum()))
            out[1].append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
            out[2].append(own[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(np.diff(off), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 100, seed: int = 24) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs removed), kept (the bytes left) of each row.

    A byte goes if a string of `window` bytes that covers it also starts earlier: in a document with a smaller id, or
    in the same document before. seed: bytes in a seed, under window and at least 8.
    """
    plan = Plan("byte", window, seed, within=True)
    named = keyed(docs, text, doc_id)
    spans = repeated(named, plan, _expand).groupBy("rk").agg(F.collect_list(F.struct("s0", "s1")).alias("spans"))
    out = named.join(spans, "rk", "left").select("doc", "text", "spans").mapInArrow(_keep, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left) of each document, with strings of 100 bytes."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
