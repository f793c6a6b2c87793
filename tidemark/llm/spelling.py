"""Groups of spelling variants by wildcard keys, without pairs.

Two words are near if one inserted, deleted or replaced code point turns one into the other. A word has a wildcard key
for each of its places (place, what stands before, what stands after), which it shares with the words that differ there
only, and a deletion key for each text that it leaves with a code point less, under which that text itself also stands
if it is a word. A key's group keeps its size and its two foremost words; each member takes from it how many others
there are and the foremost of them, so the work is one row a key and word and no pair is ever made. Words go by their
place in the order of frequency (ties: code points), which is both their name and their rank.

Keys are two hashes modulo 2 ** 61 - 1 of the code points left, with length and place, so a word of a million code
points has keys of 16 bytes as well; two different texts of a million agree in both with probability 1e-24.

Defined results: null texts have no words; a null id counts as an empty one; ties between near words of equal
frequency go to the smaller in code-point order; repeated rows count each; an empty table gives an empty result.
Columns besides the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.common import arrow_rows, discard, materialize, numbered, table
from tidemark.llm.language import code_points

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
HELD = 200_000  # words, or 64 times as many code points, that a task gathers before it sends them
BASES = (0x1B4E81B4E81B4E81 % K.P61, 0x0D2A98B26625EEE7 % K.P61)
REPLACED, SHORTER, WHOLE = 0, 1, 2  # a place left open; a code point less; a word as it is


def words_of(doc_id: str, text: str, least: int, drop: int) -> Iterator[tuple[str, int]]:
    """Words of a text and how often each comes; a run whose crc32 with the id is a multiple of drop (0: none) loses a code point."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().translate(LOWER).decode())).items():
        if len(run) >= least:
            if drop and (h := zlib.crc32(run.encode(), start)) % drop == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
                if len(run) < least:
                    continue
            yield run, n


def word_counts(docs: DataFrame, text: str, doc_id: str, least: int, drop: int) -> DataFrame:
    """word, n over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        size = 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column("id"), b.column("text"), strict=True):
                for w, n in words_of(i.as_py(), t.as_py(), least, drop):
                    total[w] += n
                    size += len(w)
                if len(total) > HELD or size > 64 * HELD:
                    yield sent()
                    total.clear()
                    size = 0
        yield sent()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keys(words: DataFrame) -> DataFrame:
    """a, b, mark of each key of words(word, idx): mark is idx * 4 and the kind of key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, raw = K.texts(batch.column("word"))
            rank = batch.column("idx").to_numpy() << 2
            for i, j in K.chunks(off):
                points, at = code_points(raw[off[i] : off[j]])
                start = np.searchsorted(at, off[i : j + 1] - off[i])
                size = np.diff(start)
                word = np.repeat(np.arange(j - i), size)
                place = np.arange(len(points)) - start[word]
                fresh = np.ones(len(points), bool)  # a run of one letter leaves the same text whichever of it goes
                fresh[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
                tag = lambda length, place: K.mix((length.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
                open_, cut, whole = tag(size[word], place + 1), tag(size[word] - 1, 0 * place)[fresh], tag(size, 0 * size)
                out = []
                for turn, base in enumerate(BASES):
                    terms = K.mul61(points.astype(np.uint64), K.powers61(base, int(size.max(initial=0)))[place])
                    sums = K.cumsum61(terms)
                    full = K.sub61(sums[start[1:]], sums[start[:-1]])
                    before = K.sub61(sums[:-1], sums[start[word]])
                    left = K.sub61(full[word], terms)
                    short = K.add61(before, K.mul61(K.sub61(left, before), np.uint64(pow(base, -1, K.P61))))[fresh]
                    salt = np.uint64(turn * 29)
                    out.append(np.concatenate([K.add61(h, (t << salt | t >> (np.uint64(64) - salt) if turn else t) & np.uint64(K.P61)) for h, t in ((left, open_), (short, cut), (full, whole))]).astype(np.int64))
                own = rank[i:j]
                marks = np.concatenate([own[word] + REPLACED, own[word][fresh] + SHORTER, own + WHOLE])
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(marks)], names=["a", "b", "mark"])

    return words.select("word", "idx").mapInArrow(run, "a long, b long, mark long")


def near(words: DataFrame) -> DataFrame:
    """idx, n_near (its near words), best (the foremost of them) of each of words(word, idx) that has one."""
    group = Window.partitionBy("a", "b").orderBy(F.col("kind") == WHOLE, "idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = keys(words).select("a", "b", F.shiftright("mark", 2).alias("idx"), F.col("mark").bitwiseAND(3).alias("kind"))
    seen = rows.select(
        "idx", "kind", F.count("*").over(group).alias("size"), F.first("idx").over(group).alias("first"), F.nth_value("idx", 2).over(group).alias("second"),
        F.last(F.when(F.col("kind") == WHOLE, F.col("idx"))).over(group).alias("whole"),
    ).where("size > 1")
    kind, others = F.col("kind"), F.col("size") - 1
    count = F.when((kind == SHORTER) & F.col("whole").isNull(), 0).when(kind == SHORTER, 1).otherwise(others)
    best = F.when(kind == SHORTER, F.col("whole")).when((kind == REPLACED) & (F.col("first") == F.col("idx")), F.col("second")).otherwise(F.col("first"))
    return seen.select("idx", count.alias("n_near"), best.alias("best")).where("n_near > 0").groupBy("idx").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """idx, root for forms(idx, form): form after form to the last, by doubling the step until no word moves."""
    now = materialize(forms.select("idx", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("idx").alias("root"), F.col("root").alias("next"))
        then = materialize(now.join(ahead, "root", "left").select("idx", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = then
        if not now.where("moved").limit(1).count():
            return now.drop("moved")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 7, often: int = 2, times: int = 10, drop: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of at least `least` code points that comes `often` times.

    A word's form is its most frequent near word if that comes at least `times` as often; root follows forms to the
    last. drop > 0 plants slips: one run in `drop`, told by crc32, loses a code point.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    counted = materialize(word_counts(docs, text, doc_id, least, drop).where(F.col("n") >= often), "words")
    rows = counted.count()
    ranked = numbered(counted.select(F.lit("").alias("all"), "word", F.col("n").alias("count")), "all", [F.col("count").desc(), F.col("word")], rows)
    words = materialize(ranked.select("idx", "word", F.col("count").alias("n")), "ranked")
    discard(counted)
    linked = materialize(near(words), "near")
    own = words.join(linked, "idx", "left")
    other = words.select(F.col("idx").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    is_form = F.col("best_n") >= times * F.col("n")
    formed = own.join(other, "best", "left").select("idx", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(is_form, F.col(c)).alias(d) for c, d in (("best", "at"), ("best_word", "form"), ("best_n", "form_n"))))
    formed = materialize(formed, "formed")
    last = roots(formed.where("at is not null").select("idx", F.col("at").alias("form")))
    names = words.select(F.col("idx").alias("root"), F.col("word").alias("root_word"))
    return formed.join(last.join(names, "root").select("idx", "root_word"), "idx", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all documents; one run in 31 loses a code point first."""
    return spelling_variants(table(spark, sf_dir, "documents"), drop=31)
