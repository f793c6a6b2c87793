from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from tidemark.llm import chat, common, decontamination, embeddings, jaccard_join, language, line_dedup, packing, quality, substring_dedup, suffix_dedup, tokens


@pytest.fixture(scope="module")
def rows():
    return X.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, X.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(rows):
    return {r[0]: r[1] for r in rows}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], X.SCHEMA)


def test_substring_dedup(docs, texts, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == X.repeated_words(texts, 50)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_suffix_dedup(docs, texts, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == X.repeated_bytes(texts, 100)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 0), (None, 80)]
    n = len(text.encode())
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(df).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 0), (None, n)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 2), (None, 1)]
    assert line_dedup.line_dedup(df).count() == 4 and packing.pack(df).count() == 4 and language.language_id(df.withColumn("lang", F.lit("en"))).count() == 4


def test_interval_expansion():
    r = np.random.default_rng(0)
    text = np.concatenate([np.append(r.integers(97, 99, 60), 0) for _ in range(8)]).astype(np.uint8)
    order, group = suffix_dedup.intervals(text, 12)
    data = text.tobytes() + b"\0" * 12
    strings = [data[i : i + 12] for i in order]
    assert all((group[i] == group[i + 1]) == (strings[i] == strings[i + 1]) for i in range(len(text) - 1) if 0 not in strings[i] and 0 not in strings[i + 1])


@pytest.mark.parametrize("length", [9, 16, 33, 64, 100])
def test_intervals_start_from_the_longest_sorted_strings(length):
    draw = np.random.default_rng(length)
    base = draw.integers(1, 4, 400).astype(np.uint8)
    parts = [base[a : a + n] for a, n in zip(draw.integers(0, 300, 60), draw.integers(1, 200, 60), strict=True)] + [np.full(150, 2, np.uint8)]
    text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint8)
    assert suffix_dedup.suffix_array(text, length)[2] == 1 << length.bit_length() - 1  # 64 for 100: 36 levels to go, not 92
    order, group = suffix_dedup.intervals(text, length)
    whole = [text[i : i + length].tobytes() for i in range(len(text) - length + 1) if text[i : i + length].all()]
    name = dict(zip(order.tolist(), group.tolist(), strict=True))
    named = [(text[i : i + length].tobytes(), name[i]) for i in range(len(text) - length + 1) if text[i : i + length].all()]
    assert len(set(named)) == len(set(whole)) == len({g for _, g in named})


def test_jaccard_join(docs, texts, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == X.jaccard_groups(texts)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_join_chains(spark):
    """Near copies of near copies: links at all distances around the threshold, so regions need several rounds."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts, now = {}, list(words)
    for i in range(70):
        if i % 10 == 0:
            now = list(words)
        now[r.randrange(len(now))] = f"x{i}"
        texts[i] = " ".join(now)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(df, pivots=2).collect()}
    assert got == X.jaccard_groups(texts)


def test_jaccard_links(spark, docs, texts, empty):
    """Links within a component count too."""
    sets = {i: X.shingle_set(t) for i, t in texts.items()}
    want = {i: (len(a), sum(j != i and bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in sets.items())) for i, a in sets.items()}
    assert max(n for _, n in want.values()) > 2
    assert {r.doc_id: (r.n_shingles, r.n_links) for r in jaccard_join.jaccard_links(docs).collect()} == want
    assert jaccard_join.jaccard_links(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_links) for r in jaccard_join.jaccard_links(df).collect()), key=str) == [(1, 2), (1, 2), (2, 0), (None, 2)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.component for x in common.components(df).collect()}
    pairs = {(max(e), min(e)) for e in edges}
    want = X.components({n for e in edges for n in e}, lambda a, b: (a, b) in pairs)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert common.components(df.limit(0)).count() == 0


def test_line_dedup(spark, docs, empty):
    a = "the quick brown fox jumps over the lazy dog near the river bank today"
    df = spark.createDataFrame([(1, f"{a}\n\nunique line here\n{a}"), (2, a.replace("today", "today!") + "\nother words entirely"), (3, None), (4, ""), (5, a.upper() + "\n \n" + a), (6, "ab\nab\nabc")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(df).collect()}
    assert got == {1: (4, 1, f"{a}\n\nunique line here"), 2: (2, 1, "other words entirely"), 3: (0, 0, None), 4: (1, 0, ""), 5: (3, 2, " "), 6: (3, 1, "ab\nabc")}
    assert line_dedup.line_dedup(empty).count() == 0
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_of_a_bucket_are_all_compared(spark):
    """Lines with shared boilerplate meet by chance: near copies that meet link whatever the bucket's smallest line is."""
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    plate, lines = some(60), []
    for _ in range(60):
        own = some(60)
        lines += [plate + own] + [plate + own[:at] + "#" + own[at + 1 :] for at in r.sample(range(60), 2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "key long, line string").coalesce(2)
    met: dict[int, list[int]] = {}
    for row in line_dedup.signatures(df, 8, 8, 3).collect():
        for b in row.buckets:
            met.setdefault(b, []).append(row.key)
    pairs = {(max(a, b), min(a, b)) for x in met.values() for a in x for b in x if a != b}
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in lines]
    want = X.components(range(len(lines)), lambda a, b: (a, b) in pairs and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = line_dedup.line_dedup(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")).where("n_removed = 0").select("doc_id").collect()
    assert {x.doc_id for x in kept} == set(want.values())
    members = spark.createDataFrame([(b, i) for b, x in met.items() for i in x], "bucket long, key long")
    got = {x.node: x.component for x in line_dedup.linked(members, df, 8, 0.8, pivots=2).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_long_lines_meet_as_often_as_short_ones(spark):
    """Pairs at Jaccard 0.8 and a little more, of 155 to 200 shingles: 0.997 of them meet at least."""
    r = random.Random(9)
    rows, pairs = [], 400
    for i in range(pairs):
        a = [r.choice("abcdefghijklmnop ") for _ in range(r.randint(162, 207))]
        b, grams = list(a), lambda x: {"".join(x[j : j + 8]) for j in range(len(x) - 7)}
        for at in r.sample(range(len(a)), len(a)):  # as many edits as leave 0.8
            c = [*b[:at], "#", *b[at + 1 :]]
            if len(grams(a) & grams(c)) >= 0.8 * len(grams(a) | grams(c)):
                b = c
        rows += [(2 * i, "".join(a)), (2 * i + 1, "".join(b))]
    got = {x.key: set(x.buckets) for x in line_dedup.signatures(spark.createDataFrame(rows, "key long, line string"), 8, 8, 3).collect()}
    assert sum(bool(got[2 * i] & got[2 * i + 1]) for i in range(pairs)) >= 0.99 * pairs


def test_shingles_go_four_a_row(spark):
    """An aggregate takes in a quarter as many rows as a line has shingles, and none is left out or made up."""
    draw = random.Random(9)
    lines = ["".join(draw.choice("abc \U0001f600é") for _ in range(n)) for n in (*range(1, 30), 200, 1001)]
    df = spark.createDataFrame(list(enumerate(lines)), "key long, line string")
    whole = df.select("key", F.expr(line_dedup._units("line")).alias("u")).select("key", "u", F.explode(F.expr(line_dedup._starts("u", 8))).alias("i")).select("key", F.expr(line_dedup._shingle("u", 8, "hash")).alias("h"))
    want, count = {}, {}
    for key, h in whole.collect():
        want.setdefault(key, set()).add(h)
        count[key] = count.get(key, 0) + 1
    blocks = line_dedup._blocks(df, 8)
    got, rows = {}, {}
    for key, *hs in blocks.collect():
        got.setdefault(key, set()).update(hs)
        rows[key] = rows.get(key, 0) + 1
    assert got == want and rows == {key: -(-n // 4) for key, n in count.items()}
    for r in line_dedup.bitmaps(line_dedup.counted(df, 8), 8).collect():
        bits = {64 * i + b for i in range(line_dedup.WORDS) for b in range(64) if (r[f"w{i}"] >> b) & 1}
        assert bits == {64 * (((h & 0xFFFFFFFF) >> 6) % line_dedup.WORDS) + (h & 63) for h in want[r.key]}


def test_each_distinct_line_is_signed_once(spark, monkeypatch):
    """Repeated lines are one row before they are signed, and lie by key, so that no shuffle follows."""
    seen, inner = [], line_dedup.signatures

    def signatures(lines, *rest):
        out = inner(lines, *rest)
        seen.append((lines.count(), lines.select("key").distinct().count(), out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(line_dedup, "signatures", signatures)
    rows = [(i, f"one line that all of the documents have\nline number {i // 2} that two of them have\n\n ONE line that all of the documents have") for i in range(40)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("n_removed < 3").collect()
    assert [x[:2] for x in seen] == [(21, 21)] and "Exchange" not in seen[0][2]
    assert {x.doc_id for x in got} and min(x.doc_id for x in got) == 0 and next(x for x in got if not x.doc_id).n_removed == 1


def test_line_similarity_is_exact(spark):
    pairs = [("abcdefghijkl", "abcdefghijkm"), ("short", "short"), ("é" * 12, "é" * 11 + "x")]
    df = spark.createDataFrame(pairs, "line_a string, line_b string")
    grams = lambda s: {s[i : i + 8] for i in range(max(1, len(s) - 7))}
    want = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a, b in pairs]
    assert [r[0] for r in df.select(line_dedup.similarity(8)).collect()] == pytest.approx(want)


def test_decontamination(spark, docs, empty):
    r = random.Random(4)
    items = [(i, " ".join(f"b{i}w{r.randrange(10**6)}" for _ in range(k))) for i, k in enumerate((3, 7, 8, 16, 30, 60))] + [(90, None), (91, "..."), (92, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], {}
    for k in range(60):
        i = k % 6
        w = items[i][1].split()
        edits = 0 if len(w) < 8 or k < 12 else max(0, int(0.1 * len(w)))
        for _ in range(edits):
            w[r.randrange(len(w))] = "zz"
        rows.append((k, "lead " * (k % 5) + ", ".join(w).upper() + " tail" * (k % 3)))
        want[k] = i
    rows += [(100 + i, t) for i, (_, t, *_) in enumerate(X.corpus(20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: {m.item_id for m in x.matches} for x in decontamination.matches(df, bench).collect()}
    assert all(not v for k, v in got.items() if k >= 100)
    assert all(got[k] == {want[k]} for k in range(12))
    assert sum(want[k] in got[k] for k in want) >= 0.95 * len(want)
    several = {x.doc_id: {m.item_id for m in x.matches} for x in decontamination.matches(df, bench, block_bytes=200).collect()}
    assert all(several[k] == {want[k]} for k in range(12))
    assert decontamination.matches(empty, bench).count() == 0
    assert decontamination.matches(df, bench.limit(0)).where("size(matches) > 0").count() == 0


def test_decontamination_of_short_items_with_an_edit(spark):
    """The tolerance of 20 % is an edit at 5 to 7 words and none below."""
    items = {k: [f"i{k}w{j}" for j in range(k)] for k in range(1, 8)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    rows, want = [], []
    for k, w in items.items():
        for at in range(k):
            for copy in (w[:at] + w[at + 1 :], [*w[:at], "zz", *w[at + 1 :]], [*w[:at], "zz", *w[at:]]):
                for lead, tail in (([], []), (["lead"] * 3, ["tail"] * 2)):
                    rows.append((len(rows), " ".join(lead + copy + tail)))
                    want.append({k} if k >= 5 or " ".join(w) in rows[-1][1] else set())
    df = spark.createDataFrame([*rows, (len(rows), "i7w0 zz i7w2 i7w3 yy i7w5 i7w6")], "doc_id long, text string")
    got = {x.doc_id: {m.item_id for m in x.matches} for x in decontamination.matches(df, bench).collect()}
    assert got == dict(enumerate([*want, set()]))


def test_edit_distance():
    values = lambda s: np.frombuffer(s.encode(), np.uint8)
    assert decontamination.edit_distance(values("abcd"), values("xxabcdxx")) == (0, 6)
    assert decontamination.edit_distance(values("abcd"), values("xxabdxx"))[0] == 1
    assert decontamination.edit_distance(values("abcd"), values(""))[0] == 4


def test_embedding_dedup(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 16))
    near = np.concatenate([base, base[:10] + r.normal(scale=0.05, size=(10, 16)), base[:5] * 2, base[:3], base[:3]])
    rows = [(i, [float(v) for v in x], 0, 1) for i, x in enumerate(near)] + [(200, None, 0, 1), (201, [0.0] * 16, 0, 1), (202, [float("nan")] * 16, 0, 1), (203, [None] * 16, 0, 1), (204, [1.0], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, id int").repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.embedding_dedup(df, per_list=10, block=7).collect()}
    f = near.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1)[:, None]
    links = f @ f.T >= 0.95
    found = X.components(range(len(f)), lambda a, b: links[a, b])
    want = {i: (int(links[i].sum()) - 1, found[i], found[i] == i) for i in range(len(f))}
    assert {k: v for k, v in got.items() if k < 200} == want
    assert {k: v for k, v in got.items() if k >= 200} == {k: (0, k, True) for k in range(200, 205)}
    assert embeddings.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_links_with_many_lists(spark):
    """Pairs near the threshold in one crowd, a list for every second vector: both ends find each link."""
    r = np.random.default_rng(6)
    base = np.append(1.0, np.zeros(31)) + r.normal(scale=0.08, size=(200, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = r.normal(size=base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = np.concatenate([base, 0.953 * base + np.sqrt(1 - 0.953**2) * side]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = {v.vec_id: (v.n_links, v.component_id) for v in embeddings.embedding_dedup(df, per_list=2, block=40).collect()}
    f = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = f @ f.T >= 0.95
    found = X.components(range(len(f)), lambda a, b: links[a, b])
    assert got == {i: (int(links[i].sum()) - 1, found[i]) for i in range(len(f))}


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    own = Tokenizer.from_file(path)
    got = packing.pack(docs, capacity=64).collect()
    pieces = {(r.doc_id, r.piece): r for r in got}
    for i, t in texts.items():
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            r = pieces.pop((i, p))
            assert (r.start, r.length, r.ids_crc32) == (a, z - a, zlib.crc32(ids[a:z].tobytes()))
    assert not pieces
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 64
    assert len(bins) <= sum(r.length for r in got) / 64 * 1.05 + 2
    assert packing.pack(empty).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # 60 leaves 40; greedy puts 30 there, 21 + 19 fill it whole
    bins, _ = packing.fill(np.array([60, 30, 21, 19]), 100)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_ids_match_the_library():
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(packing.default_vocabulary()), tokens.bpe(packing.default_vocabulary())
    for t in ["", " ", "a  b", "a\n b", "x<|endoftext|>y", "é ñ 12 3's 'S", "tab\tq  z", "a  b", "end ", "\n\n lead", "日本 語", "1 " * 300]:
        assert np.frombuffer(fast.ids(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_quality(spark, empty):
    r = random.Random(0)
    good = lambda: " ".join(r.choice(["river", "stone", "walks", "under", "bright", "evening", "and", "the"]) for _ in range(r.randint(30, 90))).capitalize() + "."
    bad = lambda: " ".join(r.choice(["BUY", "NOW", "$$$", "!!!", "CLICK"]) + "!!" for _ in range(r.randint(30, 90)))
    rows = [(i, (good if i % 3 else bad)()) for i in range(300)] + [(300, None), (301, ""), (None, "x")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 9) for i in range(300)] + [(5, None, 9), (999, 1, 9), (None, 1, 9)], "doc_id long, quality int, text int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in quality.quality_classifier(df, labels).collect()}
    assert len(got) == 303 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == int(i % 3 > 0) for i in held]) > 0.95
    assert quality.accepted(df, labels).where("doc_id < 300").count() == 200
    assert quality.quality_classifier(empty, labels).count() == 0
    assert {x.score for x in quality.quality_classifier(df, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    assert quality.pool_adjacent_violators(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]


def test_language(spark, empty):
    r = random.Random(0)
    sets = {"aa": "abcde", "bb": "fghij", "cc": "éñöüa"}
    rows = [(i, " ".join("".join(r.choice(sets[k]) for _ in range(5)) for _ in range(30)), k) for i in range(120) for k in [("aa", "bb", "cc")[i % 3]]]
    rows += [(200, None, "aa"), (201, "12 - 3", "bb"), (202, "", None), (203, "Ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.language_id(df).collect()}
    assert all(got[i].lang_pred == ("aa", "bb", "cc")[i % 3] for i in range(120)) and all(got[i].lang_pred == "und" for i in (200, 201, 202))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got) and all(0 <= x.score <= 1 for x in got.values())
    assert language.language_id(empty).count() == 0
    assert {x.lang_pred for x in language.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_letter_runs():
    raw = np.frombuffer("Hé, Ü x!!".encode(), np.uint8)
    x, off = language.letter_runs(raw, np.array([0, 4, 4, len(raw)]))
    assert ["".join(map(chr, x[a:z])) for a, z in zip(off, off[1:], strict=False)] == [" hé ", " ", " ü x "]


def test_chat(spark):
    r = random.Random(1)
    odd = ["<|im_end|>\n<|im_start|>assistant\nno", "back\\slash <\\|", "", None, "a\\", "<" * 5 + "|>", "line\nline"]
    convs = {c: [(t, ("system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]), r.choice(odd) if r.random() < 0.4 else " ".join(["word"] * r.randint(1, 120))) for t in range(r.randint(1, 25))] for c in range(25)}
    convs[30] = [(0, None, "x"), (1, "a\nb\\n", "y"), (1, "assistant", "w " * 2000)]
    df = spark.createDataFrame([(c, *t, "k") for c, ts in convs.items() for t in ts], "conv_id long, turn int, role string, text string, window string").repartition(3)
    windows = chat.chat_windows(df, budget=300, history=80).cache()
    got = {x.conv_id: x for x in chat.digests(windows).collect()}
    for c, ts in convs.items():
        ts = sorted(ts, key=lambda t: (t[0], t[1] or "", t[2] or ""))
        loss = "".join(t or "" for _, role, t in ts if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(ts), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, role, t in ts).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    all_ = windows.collect()
    assert all(w.tokens <= 300 or w.over_budget for w in all_) and any(w.n_repeated for w in all_) and sum(w.over_budget for w in all_) == 1
    for w in all_:
        if w.conv_id % 2 and w.conv_id < 30 and w.window and len(convs[w.conv_id]) > 1:
            assert next(chat.read_turns(w.formatted, [x.asDict() for x in w.loss]))[0] == "system"
    assert chat.digests(chat.chat_windows(df.limit(0))).count() == 0


def test_templated_lines_link_as_brute_force_says(spark):
    """Lines that share most of a template: nearly all pairs are near the threshold, and long lines are among them."""
    r = random.Random(12)
    some = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    lines = []
    for size in (40, 90, 400):
        for _ in range(12):
            base = some(size)
            for _ in range(6):
                t = list(base)
                for _ in range(r.randint(0, max(1, size // 60))):
                    t[r.randrange(size)] = "#"
                lines.append("".join(t) + r.choice(["", " end", some(4)]))
    lines = [*dict.fromkeys(x.strip() for x in lines)]
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in lines]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = X.components(range(len(lines)), near)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    kept = {x.doc_id for x in line_dedup.line_dedup(df).where("n_removed = 0").select("doc_id").collect()}
    gone, should = set(want) - kept, {i for i, c in want.items() if i != c}
    assert gone <= should and len(gone) >= 0.99 * len(should) > 20


def test_repetitive_lines(spark):
    """Few shingles, many times: bounds follow the distinct ones."""
    lines = ["onhe is " * k + t for k in (30, 60, 90) for t in ("", "a tail", "another tail here")]
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in (x.strip() for x in lines)]
    want = X.components(range(len(lines)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    assert {x.doc_id for x in line_dedup.line_dedup(df).where("n_removed = 0").collect()} == set(want.values())


def test_decontamination_recall_at_the_tolerance(spark):
    """Copies with 20 % of the words edited, of items of 8 to 60 words in one block."""
    r = random.Random(21)
    items = [(i, " ".join(f"k{r.randrange(3000)}" for _ in range(n))) for i, n in enumerate([8, 12, 20, 35, 60] * 4)]
    rows, want = [], {}
    for k in range(200):
        i = k % len(items)
        w = items[i][1].split()
        for at in r.sample(range(len(w)), len(w) // 5):
            w[at] = "zz"
        rows.append((k, " ".join(["lead"] * (k % 7) + w + ["tail"] * (k % 5))))
        want[k] = i
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: {m.item_id for m in x.matches} for x in decontamination.matches(df, bench).collect()}
    assert sum(want[k] in got[k] for k in want) >= 0.95 * len(want)
    blocks = {x.doc_id: {m.item_id for m in x.matches} for x in decontamination.matches(df, bench, block_bytes=1500).collect()}
    assert sum(want[k] in blocks[k] for k in want) >= 0.95 * len(want)


def test_embedding_recall_with_few_probes(spark):
    """Links right above the threshold among 2,000 random vectors in 100 lists: the margin finds nearly all, from both ends alike."""
    r = np.random.default_rng(4)
    base = r.normal(size=(1000, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = r.normal(size=base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = np.concatenate([base, 0.952 * base + np.sqrt(1 - 0.952**2) * side]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = {v.vec_id: v.n_links for v in embeddings.embedding_dedup(df, per_list=20, block=40, recall=0.998).collect()}
    f = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = f @ f.T >= 0.95
    want = links.sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum()
    assert all(got[i] == got[i + 1000] for i in range(1000) if want[i] == want[i + 1000] == 1)
    index = embeddings.Index(base[:50], [], np.array([0, 32]))
    own = embeddings.nearest(x[:200].astype(float), index.coarse, 1)[:, 0]
    can = embeddings.reachable(x[:200].astype(float), index.coarse, own, 0.1)
    far = np.stack([embeddings.plane(x[:200].astype(float), own, np.full(200, j), index.coarse) for j in range(50)], axis=1)
    assert (can == (far <= 0.1)).mean() > 0.999


def test_double_vectors_stay_double(spark):
    big = [1e300, 1e300]
    df = spark.createDataFrame([(1, big), (2, [x * 1.0000001 for x in big]), (3, [1e300, -1e300])], "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.embedding_dedup(df.withColumn("embedding", F.transform("embedding", lambda v: v / 1e200))).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_state_crosses_batches(spark, rows, docs, texts, monkeypatch):
    """Batches of two rows: what settle and whole_keys carry over decides as in one batch."""
    from tidemark.llm import seeds

    monkeypatch.setattr(seeds, "arrow_rows", lambda spark: common.arrow_rows(spark, 2))
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == X.repeated_words(texts, 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == X.repeated_bytes(texts, 100)


def test_whole_keys():
    import pyarrow as pa

    from tidemark.llm.seeds import whole_keys

    keys = [1] * 5 + [2] * 40 + [3, 4, 4, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([b"x" * 100])], names=["key", "v"]) for k in keys]
    out = [t.column("key").to_pylist() for t in whole_keys(iter(batches), 500)]
    assert sum(out, []) == keys and all({*a}.isdisjoint({*b}) for i, a in enumerate(out) for b in out[i + 1 :])


def test_packing_is_the_same_on_every_run(spark):
    df = spark.createDataFrame([(i % 40, "word " * (i % 9 + 1)) for i in range(200)], "doc_id long, text string").repartition(7)
    key = lambda r: (r.doc_id, r.piece, r.length, r.sequence_id, r.offset)
    runs = [sorted(map(key, packing.pack(df.repartition(n), capacity=16).collect())) for n in (3, 5)]
    assert runs[0] == runs[1]


def test_language_by_a_second_computation(spark):
    """Out-of-place distances of a plain re-statement: profiles of the most frequent n-grams by count, then by n-gram."""
    import re
    from collections import Counter

    r = random.Random(5)
    sets = {"aa": "abcdefg", "bb": "efghijk", "cc": "ijklmno"}
    rows = [(i, " ".join("".join(r.choice(sets[k]) for _ in range(r.randint(2, 6))) for _ in range(25)), k) for i in range(90) for k in [("aa", "bb", "cc")[i % 3]]]
    got = {x.doc_id: x.lang_pred for x in language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    def grams(text):
        out = Counter()
        for w in re.findall(r"[a-z]+", text):
            p = f" {w} "
            for n in (1, 2, 3):
                out.update(g for g in (p[i : i + n] for i in range(len(p) - n + 1)) if g.strip())
        return out

    rank = lambda c: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:400])}
    learned = {k: rank(sum((grams(t) for i, t, lang in rows if lang == k and zlib.crc32(str(i).encode()) % 4 != 2), Counter())) for k in sets}
    away = lambda a, b: sum(abs(i - b[g]) if g in b else 400 for g, i in a.items())
    want = {i: min(learned, key=lambda k: away(rank(grams(t)), learned[k])) for i, t, _ in rows}
    assert np.mean([got[i] == want[i] for i in got]) > 0.98


def test_texts_longer_than_a_chunk(spark):
    """A text over a megabyte is a chunk of its own; what it shares with short ones is found."""
    r = random.Random(31)
    words = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 9))) for _ in range(185_000)]
    long = " ".join(words)
    assert len(long) > 1 << 20
    texts = {1: long, 2: "start " + " ".join(words[90_000:90_120]) + " end", 3: long + " more", 4: None, 5: "", 6: " ".join(words[-60:])}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_words, x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in substring_dedup.substring_dedup(df).collect()}
    assert got == X.repeated_words(texts, 50)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in suffix_dedup.suffix_dedup(df).collect()}
    assert got == X.repeated_bytes(texts, 100)
    assert {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6}


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    """Names that operators use inside, a row twice, a null id: results are those of the columns asked for."""
    names = "rk long, key long, line string, matches string, rest string, stats string, score double, v string, id long, n int, piece int, label string"
    extra = (5, 6, "x", "y", "z", "s", 0.5, "v", 7, 8, 9, "l")
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"so {item} it is\nkeep"), (1, f"so {item} it is\nkeep"), (None, f"so {item} it is"), (2, "clean words only here"), (3, None), (4, "")]
    df = spark.createDataFrame([(*x, *extra) for x in rows], f"doc_id long, text string, {names}")
    bench = spark.createDataFrame([(9, item, "q"), (9, item, "q"), (None, None, "q")], "item_id long, text string, doc_id string")
    found = sorted(((x.doc_id, x.contaminated) for x in decontamination.matches(df, bench).selectExpr("doc_id", "size(matches) > 0 as contaminated").collect()), key=str)
    assert found == [(1, True), (1, True), (2, False), (3, False), (4, False), (None, True)]
    lines = sorted(((x.doc_id, x.n_lines, x.n_removed) for x in line_dedup.line_dedup(df).collect()), key=str)
    assert lines == [(1, 2, 0), (1, 2, 0), (2, 1, 0), (3, 0, 0), (4, 1, 0), (None, 1, 1)]
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x")], "doc_id long, quality int, text string")
    scored = quality.quality_classifier(df, labels).collect()
    assert len(scored) == 6 and len({x.score for x in scored if x.doc_id == 1}) == 1
    known = df.withColumn("lang", F.lit("en"))
    assert sorted((x.lang_pred for x in language.language_id(known.withColumn("doc_id", F.coalesce("doc_id", F.lit(50)))).collect())) == ["en"] * 4 + ["und"] * 2
    assert packing.pack(df, capacity=8).select("doc_id").distinct().count() == 5
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (1, [0.0, 1.0], "c")], "vec_id long, embedding array<float>, links string")
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in embeddings.embedding_dedup(vectors).collect()) == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
