"""Best-two-fit packing of token sequences.

Documents are tokenized where they lie; only lengths travel. Each task packs its share of the pieces (dealt by a hash,
`share` pieces to a task) on its own: a bin is filled greedily with the longest piece that fits, then its smallest
piece gives way to the two unpacked pieces that fit the expanded gap most tightly, if they fill more of it. A task
works on counts by length, so its memory is its share of short rows; at most a bin or two of each share are not full.

Defined results: null text counts as empty and gives one piece of the end token; repeated rows are packed each; a null
doc_id stays null; texts of any length are tokenized whole and cut at the capacity alone; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, materialize, table
from tidemark.llm.tokens import bpe


def token_pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and with_ids the ids, of each document's tokens and its end token.

    Documents over the capacity are cut; their first piece takes the remainder.
    """
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = bpe(path).ids
        for b in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                x = get(t.as_py() or "") + last
                n = len(x) // 4
                cut = n % capacity or capacity
                for p, (s, e) in enumerate([(0, cut), *((s, s + capacity) for s in range(cut, n, capacity))]):
                    y = x[4 * s : 4 * e]
                    at.append(i), piece.append(p), start.append(s), length.append(len(y) // 4), crc.append(zlib.crc32(y))
                    if with_ids:
                        ids.append(y)
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    arrow_rows(docs.sparkSession)
    return docs.select(doc_id, text).mapInArrow(run, schema)


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by best-two-fit."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    begin = np.cumsum(count) - count  # a length's items are order[begin : begin + count], taken from the end
    place = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(count > 0, place, 0))  # the longest that is left and no longer
    bins, offsets, left, b = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), len(lengths), 0

    def change(n: int, by: int) -> None:
        nonlocal below
        was = count[n]
        count[n] += by
        if not was or not count[n]:
            below = np.maximum.accumulate(np.where(count > 0, place, 0))

    while left:
        held, gap = [], capacity
        while n := int(below[gap]):
            held.append(n)
            gap -= n
            change(n, -1)
        small = held[-1]
        room = gap + small
        if gap:
            one = np.flatnonzero(count[1:room]) + 1
            two = below[np.minimum(room - one, one)]
            two = np.where((two == one) & (count[one] < 2), below[one - 1], two)
            both = np.where(two > 0, one + two, 0)
            if len(both) and both.max() > small:
                best = int(both.argmax())
                change(small, 1)
                change(int(one[best]), -1)
                change(int(two[best]), -1)
                held[-1:] = [int(one[best]), int(two[best])]
        at = 0
        # the items themselves: each length's next unused one
        for n in held:
            i = order[begin[n]]
            begin[n] += 1
            bins[i], offsets[i] = b, at
            at += n
        left -= len(held)
        b += 1
    return bins, offsets


def best_two_fit(pieces: DataFrame, capacity: int = 1024, share: int = 50_000) -> DataFrame:
    """pieces with sequence_id and offset: their places in sequences of at most `capacity` tokens.

    pieces has a column length, 1 to capacity. share: about how many pieces one task packs.
    """
    schema = pieces.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        bins, offsets = fill(t.column("length").to_numpy(), capacity)
        bins += TaskContext.get().partitionId() << 40
        yield from t.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets)).to_batches(10_000)

    pieces = materialize(pieces, "pieces")
    n = max(1, -(-pieces.count() // share))
    schema = ", ".join(x.replace(":", " ", 1) for x in schema.split(","))
    # sorted, so that a task that runs again packs alike
    return pieces.repartition(n, F.xxhash64(*pieces.columns)).sortWithinPartitions(*pieces.columns).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end: int = 2) -> DataFrame:
    return best_two_fit(token_pieces(docs, path or default_vocabulary(), capacity=capacity, end=end), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece, in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
