"""Line dedup by MinHash, in DataFrame and SQL functions only.

Lines are compared without outer white space and lower-cased. Each distinct line's character shingles (UTF-16 units) are hashed once
and their minima under `bands * rows` masks are its signature; the exploding and the minima stay in one generated
loop with a partial aggregate, so no array of shingles is ever held. Lines that agree on all rows of a band meet in
that band's bucket. First all lines of a bucket are compared to its smallest; then, as long as a bucket has lines of
different components, more of its lines are compared to the rest, so in the end each pair of lines that meet is
compared or of one component. Pairs whose shingles set too different bits are left out, the others are verified by the
exact Jaccard similarity of their shingle sets, and distributed union-find joins verified pairs to components. Of each
component one line stays: the first, by document and line number. Shingles and lines are told apart by 64-bit hashes.

Defined results: blank lines always stay and match nothing; lines shorter than a shingle are one shingle; null text
has no lines and stays null; a null doc_id counts as the largest, and rows with equal ids are ordered by a hash of the
text; identical rows count as one, so they keep the same lines; an empty table gives an empty result. Columns other
than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bucketed, discard, joined, materialize, partitions, spread, table
from tidemark.llm.seeds import LAST

BLANK = " \t\r\f\x0b"
WORDS = 32  # longs of a line's bitmap
BLOCK = 4  # shingles in a row
WIDE = 16  # the same where many minima are taken of them


def _units(line: str) -> str:
    return f"encode({line}, 'UTF-16BE')"


def _starts(units: str, k: int) -> str:
    """Where the shingles of units begin."""
    return f"sequence(0, greatest(cast(length({units}) div 2 as int) - {k}, 0))"


def _shingle(units: str, k: int, kind: str = "xxhash64") -> str:
    """Hash of the shingle of units that begins at i."""
    return f"{kind}(substring({units}, 2 * i + 1, {2 * k}))"


def _places(units: str, k: int) -> str:
    """The same in bytes of units, from 1: what substring() takes, without arithmetic on each."""
    return f"sequence(1, 2 * greatest(cast(length({units}) div 2 as int) - {k}, 0) + 1, 2)"


def _blocks(lines: DataFrame, k: int, *columns: str, block: int = BLOCK) -> DataFrame:
    """key, columns and h0, h1, ... (hashes of `block` shingles in turn) for all shingles of lines(key, line), so that an aggregate takes in `block` of them a row; a line's last block repeats its last shingle."""
    units = lines.select("key", *columns, F.expr(_units("line")).alias("u")).withColumn("last", F.expr(f"greatest(cast(length(u) div 2 as int) - {k}, 0)"))
    begins = units.select("key", *columns, "u", "last", F.explode(F.expr(f"sequence(0, last, {block})")).alias("i"))
    return begins.select("key", *columns, *(F.expr(f"hash(substring(u, 2 * least(i + {j}, last) + 1, {2 * k}))").alias(f"h{j}") for j in range(block)))


def signatures(lines: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """key and buckets array<long> of each key of lines(key, line), from all shingles of a line, whatever its length."""
    masks = np.random.default_rng(3).integers(-(1 << 31), (1 << 31) - 1, bands * rows)
    least = lambda m: "least(" + ", ".join(f"h{j} ^ {m}" for j in range(WIDE)) + ")"
    minima = _blocks(lines, k, block=WIDE).groupBy("key").agg(*(F.min(F.expr(least(m))).alias(f"m{i}") for i, m in enumerate(masks.tolist())))
    return minima.select("key", F.array(*(F.xxhash64(F.lit(b), *(f"m{b * rows + r}" for r in range(rows))) for b in range(bands))).alias("buckets"))


def _grams(units: str, k: int) -> str:
    return f"array_distinct(transform({_starts(units, k)}, i -> {_shingle(units, k)}))"


def similarity(k: int, known: bool = False) -> Column:
    """Exact Jaccard similarity of the shingle sets of columns line_a and line_b; known: grams_a and grams_b hold the sets, or null.

    transform() over one element names the units. Sets and their sizes are outside of it, in generated code; a projection
    works out once what is written twice here, a filter does not.
    """
    sets = [f"array_distinct(transform(array({_units(f'line_{c}')}), u -> transform({_places('u', k)}, i -> xxhash64(substring(u, i, {2 * k}))))[0])" for c in "ab"]
    if known:
        sets = [f"coalesce(grams_{c}, {x})" for c, x in zip("ab", sets, strict=True)]
    either = f"size(array_distinct(concat({sets[0]}, {sets[1]})))"
    return F.expr(f"(size({sets[0]}) + size({sets[1]}) - {either}) / {either}")


def counted(lines: DataFrame, k: int) -> DataFrame:
    """lines(key, line) with grams, the set of a line's shingles if most of its words repeat, else null; and n, the set's size or a bound of it."""
    n = f"greatest(cast(length(encode(line, 'UTF-16BE')) div 2 as int) - {k}, 0) + 1"
    exact = f"transform(array({_units('line')}), u -> {_grams('u', k)})[0]"
    out = lines.withColumn("words", F.split("line", " ")).withColumn("grams", F.expr(f"if(2 * size(array_distinct(words)) < size(words), {exact}, null)"))
    return out.withColumn("n", F.expr(f"coalesce(size(grams), {n})")).drop("words")


def bitmaps(lines: DataFrame, k: int) -> DataFrame:
    """key, n and w0, w1, ... (the bits that its shingles set) of each key of lines(key, line, n). Lines dealt by key stay where they are."""
    units = lines.select("key", "n", F.expr(_units("line")).alias("u")).select("key", "n", "u", F.explode(F.expr(_places("u", k))).alias("i"))
    bits = units.select("key", "n", F.expr(f"hash(substring(u, i, {2 * k}))").alias("h")).select("key", "n", F.expr(f"shiftrightunsigned(h, 6) & {WORDS - 1} AS word"), F.expr("shiftleft(1L, h & 63) AS bit"))
    # a word of a line is a row first: a shingle changes one number, not one of each word
    words = bits.groupBy("key", "n", "word").agg(F.expr("bit_or(bit)").alias("bits"))
    return words.groupBy("key").agg(F.max("n").alias("n"), *(F.expr(f"bit_or(if(word = {i}, bits, 0L))").alias(f"w{i}") for i in range(WORDS)))


def _may_link(threshold: float) -> str:
    """Whether sizes and bitmaps of p and m allow the threshold: two sets differ in at least as many shingles as their bitmaps do in bits."""
    differ = " + ".join(f"bit_count(p.w{i} ^ m.w{i})" for i in range(WORDS))
    return f"{differ} <= (p.n + m.n) * {(1 - threshold) / (1 + threshold)} + 1e-6"


def linked(members: DataFrame, texts: DataFrame, k: int, threshold: float, pivots: int = 128, few: int = 8) -> DataFrame:
    """node and component of each key that has a link: of the pairs in a bucket of members(bucket, key), those of lines at least threshold similar.

    First each line is compared to the smallest of each of its buckets. Then, as long as a bucket has lines of several
    components, its pivots are compared to its lines of other components and leave it. A bucket with at most `pivots`
    lines outside one component takes all of those as pivots; in others about `few` of that component come first, which
    most of the rest link to, then `pivots` of the rest, then eight times as many, and so on. A pair that meets in several
    buckets is compared in the smallest of them.
    """
    spark, rows, keys = members.sparkSession, members.count(), texts.count()
    texts = counted(texts, k) if "grams" not in texts.columns else texts
    shapes = bitmaps(texts.repartition(partitions(spark), "key"), k).join(members.groupBy("key").agg(F.collect_set("bucket").alias("all")), "key")
    shapes = materialize(shapes, "line-bitmaps")
    lines = [texts.select(F.col("key").alias(c), F.col("line").alias(f"line_{c}"), F.col("grams").alias(f"grams_{c}")) for c in "ab"]

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "line-pairs")
        n = pairs.count()
        # dealt by number of pairs, as their work does not follow their bytes
        both = spread(pairs.join(lines[0], "a"), max(n, keys)).repartition(min(-(-n // 1000) or 1, max(200, partitions(spark))), "b").join(lines[1], "b")
        scored = materialize(both.select("a", "b", similarity(k, known=True).alias("similarity")), "line-links")
        discard(pairs)
        links = scored.where(F.col("similarity") >= threshold).select("a", "b")
        links.stored = scored.stored
        return links

    # the smallest of each bucket
    first = materialize(spread(members.groupBy("bucket").agg(F.min("key").alias("a")), rows), "line-firsts")
    pairs = spread(spread(members.join(first, "bucket"), rows).where("key <> a").select("a", F.col("key").alias("b")).distinct(), rows)
    side = lambda c: shapes.drop("all").withColumnRenamed("key", c)
    near = spread(spread(side("a").alias("p").join(pairs, "a"), rows).join(side("b").alias("m"), "b"), rows).where(_may_link(threshold)).select("a", "b")
    found = verified(near)
    left = materialize(spread(members.join(first, "bucket"), rows).where("key <> a").select("bucket", "key"), "line-members")
    discard(first)
    turn, label = 0, None
    while True:
        turn += 1
        before, label = label, joined(label, found)
        now = spread(left.join(label, F.col("key") == F.col("node"), "left"), rows).select("bucket", "key", F.coalesce("component", "key").alias("component"))
        # one component of each open bucket: that of a random line, so mostly the largest
        main = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", F.xxhash64("key", F.lit(turn))).alias("main")).where("low < high")
        now = spread(now.join(spread(main, rows).select("bucket", "main"), "bucket"), rows).withColumn("outside", F.col("component") != F.col("main"))
        size = now.groupBy("bucket").agg(F.count_if("outside").alias("out"), F.count_if(~F.col("outside")).alias("within"), F.min(F.when(F.col("outside"), F.col("key"))).alias("first"), F.expr("cast(ceil(count(*) / 512) as int)").alias("of"))
        some = lambda n, of: F.pmod(F.xxhash64("key", F.lit(-turn)), F.greatest(F.lit(1), F.floor(F.col(of) / n))) == 0
        later = some(few, "within") & ~F.col("outside") if turn == 1 else F.col("outside") & (some(pivots, "out") | (F.col("key") == F.col("first")))
        pivot = F.when(F.col("out") <= pivots, F.col("outside")).otherwise(later)
        now = materialize(spread(now.join(spread(size, rows), "bucket"), rows).select("bucket", "key", "component", pivot.alias("pivot"), "of"), "line-members")
        discard(left, found, *([before] if before is not None else []))
        rows = now.count()
        if not rows:
            break
        # a bucket's lines are dealt out in parts, its pivots go to each
        full, parts = now.join(shapes, "key"), min(-(-rows // 1000), max(200, partitions(spark)))
        dealt = [full.where("pivot").withColumn("deal", F.explode(F.expr("sequence(0, of - 1)"))), full.withColumn("deal", F.expr("cast(pmod(xxhash64(key), of) as int)"))]
        p, m = (x.repartition(parts, "bucket", "deal").alias(c) for x, c in zip(dealt, "pm", strict=True))
        meet = F.expr(f"p.bucket = m.bucket and p.deal = m.deal and p.component <> m.component and not (m.pivot and m.key < p.key) and {_may_link(threshold)} and not exists(p.all, x -> x < p.bucket and array_contains(m.all, x))")
        met = p.join(m, meet).select(F.expr("least(p.key, m.key)").alias("a"), F.expr("greatest(p.key, m.key)").alias("b"))
        found = verified(met)
        left = materialize(now.where("not pivot").select("bucket", "key"), "line-members")
        discard(now)
        pivots = pivots if turn == 1 else 8 * pivots
    discard(shapes, now)
    return label


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 8, threshold: float = 0.8, bands: int = 8, rows: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, text (the lines that stay), rest (struct of the columns of keep) of each row.

    With the defaults lines of similarity 0.8 meet, and so are compared, with probability 0.997 by the formula, of 0.9
    with more than 0.9999. Measured at 0.8: 300 of 300 pairs of 155 to 200 shingles, 300 of 300 of 1,193 to 1,393.
    """
    raw = F.col(text)
    named = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(doc_id), raw).alias("rk"), raw.alias("text"), F.struct(*(F.col(c) for c in keep) or (F.lit(0).alias("none"),)).alias("rest"))
    plain = lambda line: F.lower(F.btrim(line, F.lit(BLANK)))
    spots = named.select("doc", "rk", F.posexplode(F.split("text", "\n")).alias("ln", "line")).withColumn("line", plain(F.col("line"))).where("line <> ''").withColumn("key", F.xxhash64("line"))
    # each distinct line once with its first place, in buckets by key: what follows by key reads it as it lies
    parts = partitions(docs.sparkSession)
    first = spots.groupBy("key").agg(F.min(F.struct("doc", "rk", "ln", "line")).alias("first"))
    lines = bucketed(first.select("key", "first.line", F.struct("first.doc", "first.rk", "first.ln").alias("first")), "line_distinct", "key", parts)
    solid = lines.select("key", "line")

    # stored in buckets, so that grouping and joining them needs one shuffle
    buckets = signatures(solid, k, bands, rows).select("key", F.explode(F.array_distinct("buckets")).alias("bucket")).repartition(parts, "bucket")
    buckets = bucketed(buckets, "line_signatures", "bucket", parts)
    shared = buckets.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("bucket")
    # the smaller sides of these joins are hashed, so that neither all buckets nor all texts are sorted
    members = materialize(buckets.join(shared.hint("shuffle_hash"), "bucket", "left_semi"), "line-buckets")
    discard(buckets)
    known = materialize(solid.join(members.select("key").distinct().hint("shuffle_hash"), "key", "left_semi").transform(counted, k), "line-texts")
    found = linked(members, known, k, threshold)
    discard(members, known)

    # of each component the first line stays: numbers of the lines that stay, by row
    firsts = lines.select("key", "first").join(found, F.col("key") == F.col("node"), "left")
    kept = firsts.where("component is null").select("first").unionAll(firsts.where("component is not null").groupBy("component").agg(F.min("first").alias("first")).select("first"))
    stays = materialize(kept.groupBy(F.col("first.rk").alias("rk")).agg(F.collect_list("first.ln").alias("firsts")), "line-stays")
    discard(lines)
    out = named.join(stays.hint("shuffle_hash"), "rk", "left").withColumn("lines", F.split("text", "\n"))
    out = out.withColumn("blank", F.filter(F.transform("lines", lambda x, i: F.when(F.ltrim(x, F.lit(BLANK)) == "", i)), lambda i: i.isNotNull()))
    out = out.withColumn("stay", F.array_sort(F.concat("blank", F.coalesce("firsts", F.array().cast("array<int>")))))
    out = out.withColumn("left", F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n"))
    return out.select(
        F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("stay"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("text").isNotNull(), F.col("left")).alias("text"),
        "rest",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the lines that stay, joined by newlines) of each document."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
