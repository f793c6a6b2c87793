"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, exact and recursive.

Jaccard distance is a metric, but nearly all documents are at distance 1 from any document, so documents as first
pivots would part nothing. The first pivots are therefore the shingles themselves, as sets of one: the pivots nearest
to a document are its own shingles, all at one distance, and a total order breaks the ties (rare first, by a fixed-size
count sketch summed over all tasks). A document's region is its first shingle; the window within which a partner at
distance at most 1 - t can lie reaches over its first n - ceil(t n) + 1 shingles, and it is replicated to those regions
(as prefix filters do). Set sizes part regions further: partners' sizes have a ratio of t at least.

Within regions documents are pivots. First all members of a region meet the one with the smallest hash (so overlapping
regions agree on it). Then, turn by turn, pivots are chosen from the regions that hold several components: a few of the
first component, which most of the rest link to, then up to `pivots` of the rest. A pivot meets the members of other
components in all its regions and leaves them; the join goes on with what is left until no region holds two components.
A pair is left out before any text travels if its distances to the region's first pivot differ by more than 1 - t, or
if sizes and parity bitmaps show more differing elements than t allows. What is left is compared exactly, on texts that
stream past the pivot's set; a pivot with many partners is dealt out in several parts.

`jaccard_components` prunes pairs within a component, so it knows no links; `jaccard_links` counts each row's links, from
all pairs of sets that share a shingle of their windows and that sizes and bitmaps allow, each compared exactly. Its
work grows with the number of such pairs.

Equal sets are one node from the start. Shingles and sets are told apart by 64-bit hashes. Defined results: null text
and text without words have no shingles and link with nothing; repeated rows each get a row; a null doc_id counts as the
largest; an empty table gives an empty result. Columns other than the id and the text are ignored, so their names cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.common import arrow_rows, bucketed, discard, joined, materialize, partitions, table
from tidemark.llm.seeds import LAST, keyed, whole_keys

PARITY = 1024  # bits
LONGS = PARITY // 64
SIGNED = "doc long, rk long, n int, fp long, pivots array<long>, parity array<long>"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, by row and hash; off begins at 0."""
    low = _LOWER[raw]
    starts, ends, woff = K.words(low, off)
    values = K.word_hashes(low, starts, ends)
    count = np.diff(woff)
    full = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    full[short] = 1
    ends = np.cumsum(full)
    begin = ends - full
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(woff[:-1] - begin, full)
    grams = K.grams(values, k)
    token = grams[np.minimum(at, max(0, len(grams) - 1))] if len(grams) else np.zeros(len(at), np.uint64)
    if len(short):
        token[begin[short]] = K.spans(K.prefix(values, K._Q), woff[short], woff[short + 1], K._Q)
    sort_rows(token, begin, ends)
    row = np.repeat(np.arange(len(count)), full)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    return row[new], token[new]


def sort_rows(values: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> None:
    """Sorts each row's values in place: one by one, or all together where rows are short."""
    if len(values) >= 32 * len(begin):
        for s, e in zip(begin.tolist(), ends.tolist(), strict=True):
            values[s:e].sort()
    else:
        values[:] = values[np.lexsort((values, np.repeat(np.arange(len(begin)), ends - begin)))]


def _each(batches: Iterator[pa.RecordBatch], k: int):
    for b in batches:
        off, raw = K.texts(b.column("text"))
        for i, j in K.chunks(off):
            row, token = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
            yield b, i, j, row, token


def sketch(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """Counts of shingles by their lowest `bits` bits over all documents, as steps of a logarithm (2 bytes each)."""
    part = 1 << min(bits, 14)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for *_, token in _each(batches, k):
            total += np.bincount((token & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        if total.any():
            at = range(0, len(total), part)
            total = total.astype(np.min_scalar_type(total.max()))  # mostly a byte each
            kind = total.dtype.itemsize
            yield pa.RecordBatch.from_arrays([pa.array([i // part for i in at], pa.int32()), pa.array([kind] * len(at), pa.int32()), pa.array([total[i : i + part].tobytes() for i in at], pa.binary())], names=["part", "kind", "counts"])

    def add(key, rows):
        total = np.zeros(part, np.uint64)
        for x, kind in zip(rows.column("counts"), rows.column("kind").to_pylist(), strict=True):
            total += np.frombuffer(x.as_py(), f"u{kind}")
        steps = (np.log2(1 + total.astype(float)) * 1000).astype(np.uint16)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["part", "counts"])

    out = np.zeros(1 << bits, np.uint16)
    for r in docs.select("text").mapInArrow(count, "part int, kind int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():  # a fixed size
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["counts"], np.uint16)
    return out


def _signatures(counts: np.ndarray, k: int, t: Fraction):
    """doc, rk, n, fp (names the set), the shingles of the document's window (48 bits each: chance meetings fall to the comparison), and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, row, token in _each(batches, k):
            n = np.bincount(row, minlength=j - i)
            ends = np.cumsum(n)
            begin = ends - n
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(token ^ np.uint64(0x5851F42D4C957F2D)))])
            fp = sums[ends] - sums[begin]
            fp = K.mix(fp ^ n.astype(np.uint64)).view(np.int64)
            # parity bitmap: bits that differ between two sets are at most the elements that differ
            flip = (np.bincount(row * PARITY + (token >> np.uint64(40)).astype(np.int64) % PARITY, minlength=(j - i) * PARITY) & 1).astype(np.uint8).reshape(j - i, PARITY)
            parity = np.packbits(flip, axis=1).view(np.int64).ravel()
            window = n - -(-n * t.numerator // t.denominator) + 1
            window[n == 0] = 0
            # rare first, then by the shingle's upper bits
            ranked = counts[(token & np.uint64(len(counts) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | token >> np.uint64(16)
            sort_rows(ranked, begin, ends)
            keep = np.arange(len(ranked)) - begin[row] < window[row]
            ends = np.concatenate([[0], np.cumsum(window)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").slice(i, j - i), b.column("rk").slice(i, j - i), pa.array(n.astype(np.int32)), pa.array(fp), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((ranked[keep] & np.uint64((1 << 48) - 1)).view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(0, len(parity) + 1, LONGS, dtype=np.int32)), pa.array(parity))],
                names=["doc", "rk", "n", "fp", "pivots", "parity"],
            )

    return run


def _regions(t: Fraction):
    """Members of each shingle's region by size, with the region's pivot; regions with the same members are one."""
    width = np.log(float(1 / t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[b.column(c).to_numpy() for c in ("token", "fp", "n")] for b in batches if b.num_rows]
        if not cols:
            return
        token, fp, n = (np.concatenate(c) for c in zip(*cols, strict=True))
        _, at, size = np.unique(token, return_inverse=True, return_counts=True)
        many = size[at] > 1
        group, fp, n = at[many], fp[many], n[many]
        if not len(group):
            return
        band = np.floor(np.log(n) / width + 1e-9).astype(np.int64)
        # a document with size band b meets those of b - 1, b and b + 1 in the regions b and b + 1
        group, fp, band = np.concatenate([group, group]), np.concatenate([fp, fp]), np.concatenate([band, band + 1])
        order = K.mix(fp.view(np.uint64))
        o = np.lexsort((order, band, group))
        group, fp, band, order = group[o], fp[o], band[o], order[o]
        new = np.ones(len(o), bool)
        new[1:] = (group[1:] != group[:-1]) | (band[1:] != band[:-1])
        again = np.zeros(len(o), bool)
        again[1:] = ~new[1:] & (fp[1:] == fp[:-1])
        group, fp, band, order, new = (x[~again] for x in (group, fp, band, order, new))
        f = np.flatnonzero(new)
        size = np.diff(np.append(f, len(fp)))
        rid = K.mix(np.add.reduceat(K.mix(order), f) ^ size.astype(np.uint64)).view(np.int64)
        _, one = np.unique(rid, return_index=True)
        keep = np.zeros(len(f), bool)
        keep[one] = True
        keep &= size > 1
        rows = np.repeat(keep, size)
        rid, pivot = np.repeat(rid, size)[rows], np.repeat(fp[f], size)[rows]
        out = pa.Table.from_arrays([pa.array(rid), pa.array(fp[rows]), pa.array(pivot)], names=["rid", "fp", "pivot"])
        yield from out.to_batches(20_000)

    return run


def _compare(k: int):
    """Rows (pivot, fp, text) sorted by pivot, its own text first: sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for b, i, j, row, token in _each(batches, k):
            pivot, fp = b.column("pivot").to_numpy()[i:j], b.column("fp").to_numpy()[i:j]
            cut = np.searchsorted(row, np.arange(j - i + 1))
            both, either = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
            for r in range(j - i):
                x = token[cut[r] : cut[r + 1]]
                if fp[r] == pivot[r]:
                    now, own = pivot[r], x
                elif now == pivot[r] and len(own):
                    at = np.minimum(np.searchsorted(own, x), len(own) - 1)
                    both[r] = int((own[at] == x).sum())
                    either[r] = len(own) + len(x) - both[r]
            ok = fp != pivot
            yield pa.RecordBatch.from_arrays([pa.array(fp[ok]), pa.array(pivot[ok]), pa.array(both[ok]), pa.array(either[ok])], names=["fp", "pivot", "both", "either"])

    return run


def _compared(texts: DataFrame, pairs: DataFrame, k: int, percent: int, parts: int, owners: DataFrame | None = None, share: int = 256) -> DataFrame:
    """pairs(fp, pivot) with both, either, and linked. A pivot's partners are dealt out in parts of about `share`, each with the pivot's text.

    texts(fp, text), or texts(rk, text) with owners(fp, rk): in buckets by rk they stay where they lie.
    """
    split = pairs.groupBy("pivot").agg(F.expr(f"cast(ceil(count(*) / {share}) as int)").alias("of"))
    own = split.select(F.col("pivot").alias("fp"), "pivot", F.explode(F.expr("sequence(0, of - 1)")).alias("deal"))
    others = pairs.join(split, "pivot").select("fp", "pivot", F.expr("cast(pmod(xxhash64(fp), of) as int)").alias("deal"))
    asked = others.unionAll(own)
    asked, key = (asked, "fp") if owners is None else (asked.join(owners, "fp"), "rk")
    sent = texts.join(asked.hint("merge"), key).select("fp", "pivot", "deal", "text")
    sent = sent.repartition(parts, "pivot", "deal").sortWithinPartitions("pivot", "deal", F.col("fp") != F.col("pivot"))
    return sent.mapInArrow(_compare(k), "fp long, pivot long, both long, either long").withColumn("linked", F.col("both") * 100 >= F.col("either") * percent)


def _differ(a: str, b: str, t: Fraction) -> Column:
    """Whether sizes and parity bits of the structs a and b allow the threshold."""
    bits = " + ".join(f"bit_count({a}.parity[{i}] ^ {b}.parity[{i}])" for i in range(LONGS))
    most = f"({a}.n + {b}.n) * {t.denominator - t.numerator} div {t.denominator + t.numerator}"
    return F.expr(f"abs({a}.n - {b}.n) <= {most} and {bits} <= {most}")


def _bits(rows: pa.Table) -> np.ndarray:
    column = rows.column("parity")
    return np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()).view(np.uint64).reshape(rows.num_rows, LONGS)


def _meeting(t: Fraction):
    """Pairs (fp < pivot) of the sets of each shingle, sorted by it, but those whose sizes or parity bitmaps show a similarity under t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(b.rename_columns(["key", *b.schema.names[1:]]) for b in batches):
            token, fp, n = (rows.column(c).to_numpy() for c in ("key", "fp", "n"))
            bits = _bits(rows)
            n = n.astype(np.int64)
            cut = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            for s, e in zip(cut, np.append(cut[1:], len(token)), strict=True):
                for i in range(s, e - 1):
                    most = (n[i + 1 : e] + n[i]) * (t.denominator - t.numerator) // (t.denominator + t.numerator)
                    near = i + 1 + np.flatnonzero(np.abs(n[i + 1 : e] - n[i]) <= most)
                    near = near[np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1) <= most[near - i - 1]]
                    if len(near):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[near], fp[i])), pa.array(np.maximum(fp[near], fp[i]))], names=["fp", "pivot"])

    return run


def jaccard_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 75, bits: int = 20) -> DataFrame:
    """doc_id, rk, n_shingles, n_links (other rows that the row links with, by the rule of jaccard_components) of each row."""
    spark = docs.sparkSession
    arrow_rows(spark)
    t, parts = Fraction(percent, 100), partitions(spark)
    named = keyed(docs, text, doc_id)
    counts = sketch(named, k, bits)
    signed = materialize(named.mapInArrow(_signatures(counts, k, t), SIGNED), "signatures")
    some = signed.where("n > 0")
    sets = some.dropDuplicates(["fp"]).select(F.explode("pivots").alias("token"), "fp", "n", "parity")
    pairs = materialize(sets.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(_meeting(t), "fp long, pivot long").distinct(), "pairs")
    owners = some.groupBy("fp").agg(F.min("rk").alias("rk")).join(pairs.select("fp").union(pairs.select("pivot")).distinct(), "fp")
    texts = materialize(named.select("rk", "text").dropDuplicates(["rk"]).join(owners, "rk").select("fp", "text"), "texts")
    links = materialize(_compared(texts, pairs, k, percent, parts).where("linked").select("fp", "pivot"), "links")
    copies = some.groupBy("fp").agg(F.count("*").alias("copies"))
    ends = links.unionAll(links.select("pivot", "fp").toDF("fp", "pivot"))
    others = ends.join(copies.withColumnRenamed("fp", "pivot"), "pivot").groupBy("fp").agg(F.sum("copies").alias("others"))
    counted = copies.join(others, "fp", "left").select("fp", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = signed.join(counted, (signed["fp"] == counted["fp"]) & (signed["n"] > 0), "left")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "rk", F.col("n").cast("long").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 75, bits: int = 20, pivots: int = 64) -> DataFrame:
    """doc_id, rk (names the row by id and text), n_shingles, component_id (the smallest id reachable by links) of each row.

    Two documents link when 100 * intersection >= percent * union of their distinct k-word shingles.
    bits: size of the count sketch, 2 ** bits counters of 2 bytes; pivots: new pivots of a region in each later round.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    t, parts = Fraction(percent, 100), partitions(spark)
    named = keyed(docs, text, doc_id)
    counts = sketch(named, k, bits)
    full = materialize(named.mapInArrow(_signatures(counts, k, t), SIGNED), "signatures")
    rows = full.where("n > 0").select(F.explode("pivots").alias("token"), "fp", "n").repartition(parts, "token")
    regions = materialize(rows.mapInArrow(_regions(t), "rid long, fp long, pivot long").distinct(), "regions")
    members = regions.select("fp").distinct()
    shapes = materialize(full.where("n > 0").select("fp", "n", "parity").join(members, "fp", "left_semi").dropDuplicates(["fp"]), "shapes")
    signed = materialize(full.select("doc", "rk", "n", "fp"), "sets")
    discard(full)
    # one row's text for each set that shares a region
    some = signed.where("n > 0")
    owners = materialize(some.groupBy("fp").agg(F.min("rk").alias("rk")).join(members, "fp"), "owners")
    texts = bucketed(named.select("rk", "text").dropDuplicates(["rk"]).join(owners.select("rk").hint("merge"), "rk"), "texts", "rk", parts)

    def compare(pairs: DataFrame) -> DataFrame:
        return materialize(_compared(texts, pairs, k, percent, parts, owners), "compared")

    shape = F.struct("n", "parity")
    first = regions.where("fp <> pivot").select("fp", "pivot").distinct()
    first = first.join(shapes.select("fp", shape.alias("a")), "fp").join(shapes.select(F.col("fp").alias("pivot"), shape.alias("b")), "pivot")
    pairs = materialize(first.where(_differ("a", "b", t)).select("fp", "pivot"), "pairs")
    known = compare(pairs)
    discard(pairs)
    linked = lambda t: t.where("linked").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    found = known
    # distance to the region's first pivot, where it was taken
    far = known.select("fp", "pivot", (1 - F.col("both") / F.col("either")).alias("far"))
    left = materialize(regions.where("fp <> pivot").join(far, ["fp", "pivot"], "left").select("rid", "fp", "far"), "left")
    discard(regions)
    turn, label = 0, None
    while True:
        turn += 1
        stale = [] if label is None else [label]
        label = joined(label, linked(found))
        discard(*stale)
        now = left.join(label, F.col("fp") == F.col("node"), "left").select("rid", "fp", "far", F.coalesce("component", "fp").alias("component"))
        # of each open region one component, that of a random member, so mostly the largest
        main = now.groupBy("rid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", F.xxhash64("fp", F.lit(turn))).alias("main")).where("low < high").select("rid", "main")
        now = materialize(now.join(main, "rid").withColumn("outside", F.col("component") != F.col("main")).drop("main"), "open")
        if now.isEmpty():
            break
        size = now.groupBy("rid").agg(F.count_if("outside").alias("out"), F.count_if(~F.col("outside")).alias("within"), F.min(F.when(F.col("outside"), F.col("fp"))).alias("first"))
        some_of = lambda n, of: F.pmod(F.xxhash64("fp", F.lit(-turn)), F.greatest(F.lit(1), F.floor(F.col(of) / n))) == 0
        later = some_of(8, "within") & ~F.col("outside") if turn == 1 else F.col("outside") & (some_of(pivots, "out") | (F.col("fp") == F.col("first")))
        chosen = now.join(size, "rid").where(F.when(F.col("out") <= pivots, F.col("outside")).otherwise(later)).select("fp").distinct().withColumn("pivot", F.lit(True))
        # a member's first regions: pairs that meet in one of them need not meet again
        lists = now.groupBy("fp").agg(F.expr(f"slice(array_sort(collect_set(rid)), 1, {LISTED})").alias("listed")).join(chosen, "fp", "left").join(shapes, "fp")
        lists = materialize(lists.withColumn("pivot", F.coalesce("pivot", F.lit(False))), "members")
        met = now.drop("outside").join(lists, "fp").repartition(parts, "rid").sortWithinPartitions("rid")
        pairs = materialize(met.mapInArrow(_pairs(float(1 - t) + 1e-9, t), "fp long, pivot long").distinct(), "pairs")
        spent, found = found, compare(pairs)
        before, left = left, materialize(now.join(lists.where("not pivot").select("fp"), "fp", "left_semi").select("rid", "fp", "far"), "left")
        discard(before, now, lists, pairs, spent)
        pivots = pivots if turn == 1 else 4 * pivots
    discard(texts, owners, shapes, left, now, found)
    node = some.select("fp", "doc").join(label, F.col("fp") == F.col("node"), "left").select("doc", "fp", F.coalesce("component", "fp").alias("root"))
    lowest = node.groupBy("root").agg(F.min("doc").alias("low"))
    root = node.select("fp", "root").distinct().join(lowest, "root").select("fp", "low")
    out = signed.join(root, "fp", "left")
    own = F.when((F.col("n") == 0) | F.col("low").isNull(), F.col("doc")).otherwise(F.col("low"))
    back = lambda c: F.when(c != LAST, c)
    return out.select(back(F.col("doc")).alias("doc_id"), "rk", F.col("n").cast("long").alias("n_shingles"), back(own).alias("component_id"))


LISTED = 16


def _pairs(slack: float, t: Fraction):
    """Pairs (fp, pivot) of the pivots of each region, sorted by rid, with its members of other components.

    A pair is left out if its distances to the region's first pivot exclude it, if sizes and parity bits show more
    differing elements than a similarity of t allows, or if both list a smaller region, where they meet as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(b.rename_columns(["key" if n == "rid" else n for n in b.schema.names]) for b in batches):
            rid, fp, far, comp, pivot, size = (rows.column(c).to_numpy() for c in ("key", "fp", "far", "component", "pivot", "n"))
            size, bits = size.astype(np.int64), _bits(rows)
            column = rows.column("listed").combine_chunks()
            listed = np.full((len(rid), LISTED), np.iinfo(np.int64).max)
            off = np.asarray(column.offsets).astype(np.int64)
            n = np.diff(off)
            listed[np.repeat(np.arange(len(rid)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(column.flatten())
            cut = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
            found: list[np.ndarray] = []
            for s, e in zip(cut, np.append(cut[1:], len(rid)), strict=True):
                here = rid[s]
                for i in range(s, e):
                    if not pivot[i]:
                        continue
                    # two pivots meet once, from the smaller
                    near = s + np.flatnonzero((comp[s:e] != comp[i]) & ~(pivot[s:e] & (fp[s:e] <= fp[i])) & ~(np.abs(far[s:e] - far[i]) > slack))
                    most = (size[near] + size[i]) * (t.denominator - t.numerator) // (t.denominator + t.numerator)
                    ok = np.abs(size[near] - size[i]) <= most
                    near, most = near[ok], most[ok]
                    near = near[np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1) <= most]
                    if len(near):
                        before = listed[i][listed[i] < here]
                        near = near[~np.isin(listed[near], before).any(axis=1)] if len(before) else near
                        found.append(np.column_stack([fp[near], np.full(len(near), fp[i])]))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["fp", "pivot"])

    return run


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of each document: distinct 5-word shingles, links at 75 %."""
    return jaccard_components(table(spark, sf_dir, "documents")).drop("rk")
