"""Benchmark decontamination by CGK random-walk embedding and bit-sampling LSH, with exact edit verification.

Texts are sequences of words (runs of letters, digits and bytes beyond ASCII, A-Z lower-cased). A random walk copies a
sequence step by step and moves on or stays by a random bit of (step, word): sequences at small edit distance meet
again after each edit, so their walks are at small Hamming distance. Each repetition samples some steps of the walk
and hashes their words. Items are cut at every word into windows of about the shortest item's size (at most `window`
words), documents at every `stride`-th word, so some window of a copy stands at the same place of the item; equal
hashes in any repetition give a candidate place of the whole item, where the edit distance is computed exactly. An
unedited stretch of window + stride - 1 words is always found; the repetitions find most windows with an edit or two.

Items under `exact` words have few windows, and walks alone would miss a part of their copies (a tenth of those of 30
words with every fifth word deleted); so they are looked for by an exact means as well, the only one for items of
`window` words or less. Where the tolerance allows an item e edits, it is cut into e + 1 parts, of which one at least
stands unedited in a copy: each place of a part is a candidate place of the item, so every copy within the tolerance is
found. Items that may have no edit are matched as they are. The benchmark is read in blocks of bounded size, each in a
pass of its own over the documents, so a task holds one block's index whatever the benchmark's size.

Defined results: null or wordless items match nothing; null text counts as empty; repeated rows get equal results; items
that stand at one place all match it, and null ids of items or documents stay null; long texts go whole; an empty benchmark leaves all documents clean; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import kernels as K
from tidemark.llm.common import arrow_rows, materialize, table
from tidemark.llm.jaccard_join import _LOWER

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_values(raw: np.ndarray, off: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word with `pad` zeros after each row, where the rows begin, and how many words they have."""
    low = _LOWER[raw]
    starts, ends, woff = K.words(low, off, _APART)
    n = np.diff(woff)
    begin = woff[:-1] + pad * np.arange(len(n))
    out = np.zeros(len(starts) + pad * len(n), np.uint64)
    out[np.arange(len(starts)) + pad * np.repeat(np.arange(len(n)), n)] = K.word_hashes(low, starts, ends) | np.uint64(1)
    return out, begin, n


@dataclass
class Walk:
    steps: int
    picks: np.ndarray  # steps sampled by each repetition

    @classmethod
    def of(cls, window: int, repetitions: int, picked: int, seed: int = 5) -> Walk:
        steps = window * 3 // 2
        r = np.random.default_rng(seed)
        return cls(steps, np.stack([np.sort(r.choice(steps, min(picked, steps), replace=False)) for _ in range(repetitions)]))

    def hashes(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each repetition and start, the hash of the walk's sampled words."""
        at = starts.copy()
        out = np.zeros((len(self.picks), len(starts)), np.uint64)
        chosen = [np.flatnonzero((self.picks == s).any(axis=1)) for s in range(self.steps)]
        for s in range(self.steps):
            word = values[at]
            for r in chosen[s]:
                out[r] = (out[r] ^ word) * np.uint64(K._Q)
            if s + 1 < self.steps:
                at += ((word >> np.uint64(1 + s % 60)) & np.uint64(1)).view(np.int64)
        return out


def edit_distance(item: np.ndarray, place: np.ndarray) -> tuple[int, int]:
    """Least edits that turn item into some part of place, and where the part ends."""
    width = np.arange(len(place) + 1)
    row = np.zeros(len(place) + 1, np.int64)
    for i, w in enumerate(item):
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (place != w))
        step[0] = i + 1
        row = np.minimum.accumulate(step - width) + width
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """A block of the benchmark, ready for look-up."""

    def __init__(self, rows: list[tuple], window: int, exact: int, repetitions: int, picked: int, stride: int, tolerance: float):
        data = [(t or "").encode() for _, t in rows]
        off = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        values, begin, n = word_values(np.frombuffer(b"".join(data), np.uint8), off, 2 * window)
        self.ids = [i for i, _ in rows]
        self.kind = pa.array([i for i in self.ids if i is not None][:1] or [0]).type
        self.words = [values[b : b + k] for b, k in zip(begin, n, strict=True)]
        long = [i for i, k in enumerate(n) if k > window]
        # so that one of the document's windows stands at a place of the item whatever the shift
        self.window = min([window, *(int(n[i]) - stride + 1 for i in long)])
        self.walk = Walk.of(self.window, repetitions, picked)
        item = np.array([i for i in long for _ in range(n[i] - self.window + 1)], np.int64)
        place = np.array([p for i in long for p in range(n[i] - self.window + 1)], np.int64)
        self.tables = []
        hashes = self.walk.hashes(values, begin[item] + place) if len(item) else np.zeros((0, 0), np.uint64)
        for h in hashes:
            o = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[h >> np.uint64(48)] = True
            self.tables.append((seen, h[o], item[o], place[o]))
        # by length of the part: by its hash, the items that have it, and where
        self.short: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.parts: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, k in enumerate(n):
            if 0 < k < exact:
                cuts = np.linspace(0, k, min(int(tolerance * k), int(k) - 1) + 2).astype(int)
                held = self.short if len(cuts) == 2 else self.parts
                for a, z in zip(cuts, cuts[1:], strict=False):
                    held.setdefault(int(z - a), {}).setdefault(int(K.grams(self.words[i][a:z], int(z - a))[0]), []).append((i, int(a)))

    @staticmethod
    def places(held: dict[int, dict[int, list[tuple[int, int]]]], values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        """Row, item, and place where the item would begin, of each part of an item that stands in a row."""
        out = []
        for k, keys in held.items():
            g = K.grams(values, k)
            for p in np.flatnonzero(np.isin(g, np.array(list(keys), np.uint64))).tolist():
                r = int(np.searchsorted(begin, p, "right")) - 1
                s = p - int(begin[r])
                if s + k <= n[r]:
                    out += [(r, it, s - a) for it, a in keys[int(g[p])]]
        return out

    def candidates(self, values: np.ndarray, starts: np.ndarray):
        """Start, item, and place in the item of windows with equal hashes."""
        out = []
        if self.tables and len(starts):
            for h, (seen, keys, item, place) in zip(self.walk.hashes(values, starts), self.tables, strict=True):
                hit = np.flatnonzero(seen[h >> np.uint64(48)])
                a, z = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
                own = np.repeat(hit, z - a)
                at = np.arange(len(own)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + np.repeat(a, z - a)
                out.append(np.stack([starts[own], item[at], place[at]]))
        return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


FOUND = "item int, start int, stop int, edits int"


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", tolerance: float = 0.2, window: int = 12, exact: int = 45, stride: int = 2, repetitions: int = 8, picked: int = 7, block_bytes: int = 1 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, rest (struct of the columns of keep), matches array<struct<item_id, start, stop, edits>> of each row of docs.

    An item matches where its word edit distance to a part of the document is at most tolerance times its words.
    start and stop count the document's words. block_bytes: benchmark text whose index a task holds, some 30 times as large.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = dict(items.dtypes)["item_id"]
    rest = F.struct(*(F.col(c) for c in keep) or (F.lit(0).alias("none"),)).alias("rest")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), rest)
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL(f"matches array<struct<item_id:{kind},start:int,stop:int,edits:int>>")])

    def one(n: int) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()  # about block_bytes
        index = Items([(r[0], r[1]) for r in part], window, exact, repetitions, picked, stride, tolerance)
        return rows.mapInArrow(_find(index, tolerance, stride), schema)

    if blocks == 1:
        return one(0)
    rk = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    found = [materialize(one(n).select(rk.alias("rk"), F.explode("matches").alias("m")), "matches") for n in range(blocks)]
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    gathered = every.groupBy("rk").agg(F.array_sort(F.collect_set("m")).alias("matches"))
    none = F.array().cast(schema["matches"].dataType)
    return rows.withColumn("rk", rk).join(gathered, "rk", "left").select("doc_id", "text", "rest", F.coalesce("matches", none).alias("matches"))


def _find(index: Items, tolerance: float, stride: int):
    pad = 2 * index.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text")
            off, raw = K.texts(column)
            found: list[list] = [[] for _ in range(b.num_rows)]
            for i, j in K.chunks(off):
                values, begin, n = word_values(raw[off[i] : off[j]], off[i : j + 1] - off[i], pad)
                count = -(-n // stride)
                row = np.repeat(np.arange(j - i), count)
                starts = begin[row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
                at, item, place = index.candidates(values, starts)
                owner = np.searchsorted(begin, at, "right") - 1
                # windows at one place of an item are one candidate
                tried = np.unique(np.column_stack([owner, item, at - begin[owner] - place]), axis=0)
                for r, it, s in tried.tolist() + sorted(set(index.places(index.parts, values, begin, n))):
                    words = index.words[it]
                    most = int(tolerance * len(words))
                    if any(m["item_id"] == index.ids[it] and m["start"] <= s + most and s - most <= m["start"] for m in found[i + r]):
                        continue
                    lo, hi = max(0, s - most), min(int(n[r]), s + len(words) + most)
                    if hi <= lo:
                        continue
                    edits, end = edit_distance(words, values[begin[r] + lo : begin[r] + hi])
                    if edits <= most:
                        _, length = edit_distance(words[::-1], values[begin[r] + lo : begin[r] + lo + end][::-1])
                        found[i + r].append({"item_id": index.ids[it], "start": lo + end - length, "stop": lo + end, "edits": edits})
                for r, it, s in index.places(index.short, values, begin, n):
                    found[i + r].append({"item_id": index.ids[it], "start": s, "stop": s + len(index.words[it]), "edits": 0})
            struct = pa.list_(pa.struct([("item_id", index.kind), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))
            names = ["doc_id", "text", "rest"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, struct)], names=[*names, "matches"])

    return run


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, items (the benchmark items found, in order) of each document."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_sort(F.array_distinct("matches.item_id")).alias("items"))
