"""Winnowed seeds: repeats of at least `window` units (words or bytes) across a corpus, without pairs.

A k-gram is a seed where it is the smallest in some window of `window` units; equal windows have the same seed at the
same place. So the windows of one seed occurrence are a run of starts [s0, s1], and all that they can match lies
around occurrences of the same seed.

1. scan: each task finds its seed occurrences (seed, context, document, s0, s1), context being the hash of all units
   from s0 to s1 + window. Of a task's occurrences with one context only the earliest goes on; the rest are already
   known to repeat it. So a passage in a third of all documents leaves a row per task, not per document.
2. settle: rows dealt by seed, sorted by (seed, context, document) in Spark's spillable sort, stream through a state
   of one row. Later rows of a context repeat its earliest one whole. The earliest rows of a seed that has several
   contexts go on as representatives.
3. snippets: representatives meet their texts again and are dealt by (seed and the units on its heavier side), which
   parts the many documents that meet only at a passage's border; the caller compares them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.common import arrow_rows, materialize, partitions

ROWS = "seed long, ctx long, doc long, rk long, s0 int, s1 int, kind int"
SEED, REPEAT, REP = 0, 1, 2
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Plan:
    unit: str  # word or byte
    window: int
    k: int
    within: bool  # repeats within one document count

    @property
    def w(self) -> int:
        return self.window - self.k + 1

    @property
    def side(self) -> int:
        return (self.window - self.k) // 2


def units(plan: Plan, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each unit, the rows' offsets into units, the units' starts and ends in bytes."""
    if plan.unit == "byte":
        at = np.arange(len(raw))
        return K._BYTE[raw], off, at, at + 1
    starts, ends, woff = K.words(raw, off)
    return K.word_hashes(raw, starts, ends), woff, starts, ends


def _array(x: np.ndarray, kind) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x, kind)


def _batch(seed, ctx, doc, rk, s0, s1, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [_array(seed, pa.int64()), _array(ctx, pa.int64()), _array(doc, pa.int64()), _array(rk, pa.int64()), _array(s0.astype(np.int32), pa.int32()), _array(s1.astype(np.int32), pa.int32()), _array(kind.astype(np.int32), pa.int32())],
        names=["seed", "ctx", "doc", "rk", "s0", "s1", "kind"],
    )


def contexts(plan: Plan, raw: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the units [start, end); not by products of one base, so units cannot cancel each other."""
    return K.word_hashes(raw, starts, ends) if plan.unit == "byte" else K.run_hashes(values, starts, ends)


def occurrences(plan: Plan, values: np.ndarray, off: np.ndarray):
    """row, seed hash, seed place, s0, s1 of each seed occurrence; places count from the chunk's start."""
    g = K.grams(values, plan.k)
    at = K.sliding_argmin(g, plan.w)
    n = np.diff(off)
    live = np.flatnonzero(n >= plan.window)
    if not len(live) or not len(at):
        return (np.zeros(0, np.int64),) * 5
    count = n[live] - plan.window + 1
    row = np.repeat(live, count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(off[live], count)
    a = at[start]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    f = np.flatnonzero(new)
    p = a[f]
    return row[f], g[p], p, start[f], start[np.append(f[1:], len(a)) - 1]


def _repeats(plan: Plan, seed, ctx, doc, rk, s0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by seed, context, document, start: first of its seed, first of its context, repeat of an earlier row."""
    new_seed = np.ones(len(seed), bool)
    new_seed[1:] = seed[1:] != seed[:-1]
    new_ctx = new_seed.copy()
    new_ctx[1:] |= ctx[1:] != ctx[:-1]
    at = np.maximum.accumulate(np.where(new_ctx, np.arange(len(seed)), 0))
    later = doc > doc[at]
    if plan.within:
        later |= (rk != rk[at]) | (s0 != s0[at])
    return new_seed, new_ctx, later


def scan(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            o = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
            seed, ctx, doc, rk, s0, s1 = (c[o] for c in cols)
            later = _repeats(plan, seed, ctx, doc, rk, s0)[2]
            kind = np.where(later, REPEAT, SEED)
            seed = np.where(later, rk.view(np.uint64), seed)  # a repeat only passes through, so any task may have it
            for i in range(0, len(seed), 100_000):
                j = slice(i, i + 100_000)
                yield _batch(seed[j], ctx[j], doc[j], rk[j], s0[j], s1[j], kind[j])

        for b in batches:
            off, raw = K.texts(b.column("text"))
            doc, rk = b.column("doc").to_numpy(zero_copy_only=False), b.column("rk").to_numpy(zero_copy_only=False)
            for i, j in K.chunks(off):
                data = raw[off[i] : off[j]]
                values, uoff, _, _ = units(plan, data, off[i : j + 1] - off[i])
                row, seed, p, s0, s1 = occurrences(plan, values, uoff)
                if len(row):
                    ctx = contexts(plan, data, values, s0, s1 + plan.window) ^ K.mix((p - s0).astype(np.uint64))
                    held.append((seed, ctx, doc[i + row], rk[i + row], s0 - uoff[row], s1 - uoff[row]))
                    size += len(row)
            if size > 1_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def settle(plan: Plan):
    """Rows of one task in order of seed, context, document, start; carries one row from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = None, False  # the current seed's first row, or once several contexts came (sent) the current context's
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "ctx", "doc", "rk", "s0", "s1", "kind")]
            done = cols[6] == REPEAT
            if done.any():
                yield _batch(*(c[done] for c in cols))
                cols = [c[~done] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([np.array([x], c.dtype), c]) for x, c in zip(held, cols, strict=True)]
            seed, ctx, doc, rk, s0, s1, _ = cols
            new_seed, new_ctx, later = _repeats(plan, seed, ctx, doc, rk, s0)
            group = np.cumsum(new_seed) - 1
            several = np.bincount(group, new_ctx) > 1
            several[0] |= sent
            kind = np.where(later, REPEAT, np.where(several[group] | ~new_ctx, REP, SEED))
            out = kind != SEED
            if sent:
                out[0] = False
            yield _batch(*(c[out] for c in (seed, ctx, doc, rk, s0, s1, kind)))
            sent = bool(several[-1])
            at = int(np.flatnonzero(new_ctx if sent else new_seed)[-1])
            held = tuple(c[at] for c in cols)

    return run


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc (the id; null last), rk (names the row by id and text), text (null: empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(doc_id), t).alias("rk"), t.alias("text"))


def snippets(plan: Plan):
    """Text around each representative, by the heavier side of its windows: key, doc, rk, place, lead, n, snippet.

    place: the first window's start in its document; n windows start at the snippet's first n units.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, raw = K.texts(b.column("text"))
            doc, rk = b.column("doc").to_numpy(zero_copy_only=False), b.column("rk").to_numpy(zero_copy_only=False)
            reps = b.column("reps")
            roff, s0_all = np.asarray(reps.offsets), np.asarray(reps.values)
            for i, j in K.chunks(off):
                values, uoff, us, ue = units(plan, raw[off[i] : off[j]], off[i : j + 1] - off[i])
                row, seed, p, s0, s1 = occurrences(plan, values, uoff)
                if not len(row):
                    continue
                # which occurrences are representatives: by row and start
                want = np.concatenate([np.zeros(0, np.int64)] + [s0_all[roff[r] : roff[r + 1]].astype(np.int64) + uoff[r - i] for r in range(i, j)])
                hit = np.isin(s0, want)
                row, seed, p, s0, s1 = (x[hit] for x in (row, seed, p, s0, s1))
                if not len(row):
                    continue
                sums, data = K.prefix(values, K._Q), raw[off[i] : off[j]].tobytes()
                cut = p - plan.side  # windows that start at cut or before hold `side` units before the seed
                for lo, hi, a, z in ((s0, np.minimum(s1, cut), p - plan.side, p + plan.k), (np.maximum(s0, cut + 1), s1, p, p + plan.window - plan.side + 1)):
                    ok = np.flatnonzero(lo <= hi)
                    if not len(ok):
                        continue
                    key = K.spans(sums, a[ok], z[ok], K._Q) ^ K.mix(seed[ok])
                    lo_, hi_ = lo[ok], hi[ok] + plan.window
                    texts = [data[x:y] for x, y in zip(us[lo_].tolist(), ue[hi_ - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [_array(key, pa.int64()), pa.array(doc[i + row[ok]], pa.int64()), pa.array(rk[i + row[ok]], pa.int64()), pa.array((lo_ - uoff[row[ok]]).astype(np.int32), pa.int32()), pa.array((hi[ok] - lo[ok] + 1).astype(np.int32), pa.int32()), pa.array(texts, pa.binary())],
                        names=["key", "doc", "rk", "place", "n", "snippet"],
                    )

    return run


def whole_keys(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.Table]:
    """Tables of all rows of some keys, from batches sorted by key; about size bytes, or one key that has more."""
    held: list[pa.RecordBatch] = []
    have = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        have += b.nbytes
        if have < size or b.column("key")[-1].as_py() == held[0].column("key")[0].as_py():  # one key as yet
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            have = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(mask: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of marked windows that are neighbours in one row."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (row[at[1:]] != row[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + 1)
    f = np.flatnonzero(new)
    return at[f], at[np.append(f[1:], len(at)) - 1]


def ranges(rk: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(s0.astype(np.int32), pa.int32()), pa.array(s1.astype(np.int32), pa.int32())], names=["rk", "s0", "s1"])


SNIPPET = "key long, doc long, rk long, place int, n int, snippet binary"
RANGES = "rk long, s0 int, s1 int"


def repeated(docs: DataFrame, plan: Plan, solve) -> DataFrame:
    """Ranges [s0, s1) of units of rows rk that windows cover which repeat an earlier one, over keyed(docs).

    solve(plan): a mapInArrow function from all snippets of some keys, sorted by key, to RANGES.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    n = partitions(spark)
    found = docs.mapInArrow(scan(plan), ROWS).repartition(n, "seed").sortWithinPartitions("seed", "ctx", "doc", "rk", "s0")
    settled = materialize(found.mapInArrow(settle(plan), ROWS).select("rk", "s0", "s1", "kind"), "settled")
    reps = settled.where(F.col("kind") == REP).groupBy("rk").agg(F.collect_set("s0").alias("reps"))
    pieces = docs.join(reps, "rk").select("doc", "rk", "text", "reps").mapInArrow(snippets(plan), SNIPPET)
    pieces = pieces.repartition(n, "key").sortWithinPartitions("key")
    return settled.where(F.col("kind") == REPEAT).select("rk", "s0", (F.col("s1") + plan.window).alias("s1")).unionAll(pieces.mapInArrow(solve(plan), RANGES))
