"""Merkle manifest, spelling variants and personal data against plain re-statements of their contracts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from tidemark.llm import kernels as K
from tidemark.llm import decontamination, embeddings, jaccard_join, merkle, pii, spelling, substring_dedup, suffix_dedup


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return X.corpus() + [(7, "again", "en", None, 5, "x", "y", "z"), (7, "again", "en", None, 5, "x", "y", "z"), (None, "no id", "de", "s", None, "x", "y", "z"), (900, "x" * 1_200_000, "en", "s", 3, "x", "y", "z"), (901, "alone", "zz", "s", 2**63 - 1, "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, X.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], X.SCHEMA)


def manifest(rows, fanout: int) -> list[tuple]:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; every seventh id tampered."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        return H("".join(map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(tree, i):
        """For each level the run and the place in it."""
        out = []
        for level in tree[:-1]:
            first = i - i % fanout
            out.append((level[first : first + fanout], i - first))
            i //= fanout
        return out

    trees = {}
    for lang in sorted({r[2] or "" for r in rows}):
        own = sorted((r for r in rows if (r[2] or "") == lang), key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[lang] = (own, levels([leaf(r) for r in own]))
    crown = levels([t[-1][0] for _, t in trees.values()])
    out = []
    for at, (own, tree) in enumerate(trees.values()):
        for i, r in enumerate(own):
            steps = path(tree, i) + path(crown, at)
            now = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for run, k in steps:
                now = H("".join(run[:k] + [now] + run[k + 1 :]))
            proof = H("".join("".join(run[:k] + run[k + 1 :]) for run, k in steps))
            out.append((r[0], tree[0][i], tree[-1][0], crown[-1][0], proof, now, now == crown[-1][0]))
    return out


@pytest.mark.parametrize(("fanout", "height"), [(2, 9), (2, 2), (3, 1)])
def test_merkle_manifest(docs, rows, fanout, height):
    n = F.col("n_chars").cast("decimal(38,0)")
    claim = {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, n + 1).otherwise(n)}
    got = merkle.merkle_manifest(docs, claim=claim, fanout=fanout, height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = manifest(rows, fanout)
    assert X.tally(tuple(r) for r in got.collect()) == X.tally(want)
    assert any(not w[-1] for w in want)


def test_merkle_odd_tables(spark, empty):
    assert merkle.merkle_manifest(empty).count() == 0
    (r,) = merkle.merkle_manifest(spark.createDataFrame([(1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert r.leaf == r.subroot == r.root == H("1:1----") and r.proof_sha256 == H("") and r.verified
    many = spark.createDataFrame([(i, "t", f"l{i}", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.merkle_manifest(many, height=2).collect()
    assert len({r.root for r in got}) == 1 and all(r.leaf == r.subroot and r.verified for r in got)


def variants(rows, drop: int, least: int = 7, often: int = 2, times: int = 10) -> set[tuple]:
    n: Counter = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = sorted(w for w, c in n.items() if len(w) >= least and c >= often)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return len(b) == len(a) + 1 and a[k:] == b[k + 1 :]

    links = {w: [v for v in words if v != w and near(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in links.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= times * n[w]}
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return out


def slips() -> list[tuple]:
    """Words with near words of all three kinds, of forms of forms, equal frequencies, doubled letters and long runs."""
    r = random.Random(11)
    texts = ["grandfather " * 300, "Grandfater " * 20, "Grandfate grandfate ", "grandmother " * 12, "grandmothers GRANDMOTHERS", "aaaaaaaa " * 30, "aaaaaaa aaaaaaa", "aaaaaaaaa " * 3, "élévationÀ élévationÀ", "élévationà " * 25, "one,two;abcdefg×hij " * 2, None, ""]
    for _ in range(40):
        w = [r.choice("abé") for _ in range(r.randint(6, 9))]
        texts.append(("".join(w) + " ") * r.randint(1, 25))
    long_ = "".join(r.choice("abcdefgh") for _ in range(30_000))
    texts += [f"{long_} " * 2, f"{long_[:15_000]}z{long_[15_001:]} " * 20, f"{long_[:7]}{long_[8:]} " * 2]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "grandfather nobody nobodys nobody"), (3, "grandmother " * 12)]


@pytest.mark.parametrize("drop", [0, 3])
def test_spelling_variants(spark, drop):
    rows = slips()
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("word"), F.lit(1).alias("n"), F.lit(2).alias("idx")).repartition(3)
    got = spelling.spelling_variants(df, drop=drop)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {tuple(r) for r in got.collect()}
    assert got == variants(rows, drop)
    if not drop:
        form = {r[0]: r[1:3] for r in got}
        assert form["grandfate"] == ("grandfater", "grandfather") and form["grandfater"] == ("grandfather", "grandfather")


def test_spelling_odd_tables(spark, docs, rows, empty):
    assert {tuple(r) for r in spelling.spelling_variants(docs, drop=31).collect()} == variants(rows, 31)
    assert spelling.spelling_variants(empty).count() == 0


def test_kernels_modulo_a_prime():
    r = random.Random(1)
    a, b = ([r.randrange(K.P61) for _ in range(500)] + [0, 1, K.P61 - 1] for _ in range(2))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert K.mul61(x, y).tolist() == [p * q % K.P61 for p, q in zip(a, b, strict=True)]
    assert K.add61(x, y).tolist() == [(p + q) % K.P61 for p, q in zip(a, b, strict=True)]
    assert K.sub61(x, y).tolist() == [(p - q) % K.P61 for p, q in zip(a, b, strict=True)]
    assert K.cumsum61(x).tolist() == [sum(a[:k]) % K.P61 for k in range(len(a) + 1)]
    assert K.powers61(a[0], 70).tolist() == [pow(a[0], k, K.P61) for k in range(70)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text: str) -> list[tuple]:
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for form, kind in ((CARD, 2), (PHONE, 3)):
        for m in form.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if (14 <= len(d) <= 19 and luhn(d)) if kind == 2 else 10 <= len(d) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def odd_texts(n: int = 3000) -> list[str]:
    r = random.Random(4)
    parts = ["a@b.c", "a@b", "@", ".", "..", "x.y@z-1.co.uk", "1.2.3.4", "1.2.3", "256.1.1.1", "0001.2.3.04", "1.2.3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "4845168114407329", "+1 (555) 555-0100", "+49", "+", " ", "  ", "-", "é", "日本", "(", ")", "12", "7", "word", "%", "_", "\n", "٣"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(n)]


def test_base_spans(spark):
    texts = [*odd_texts(), "9" * 2000, "1." * 2000, "a@" * 2000, "+1" + "(" * 2000, None, "", "é" * 10 + "me@mail.example.com"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", F.lit("e").alias("spans"), F.lit("k").alias("found"))
    got = {r.doc_id: [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.base] for r in pii.pii_spans(df).collect()}
    assert got == {i: base_spans(t or "") for i, t in enumerate(texts)}


def test_candidates_in_linear_time():
    for text in ("9" * 400_000, "1." * 400_000, "a@" * 300_000, "+1" + "(" * 400_000, " at " * 200_000, "(at)" * 200_000, "1-" * 300_000, "x" * 900_000 + "@"):
        pii.candidates(text.encode())


def test_reliabilities():
    """EM finds how often labelers are right from their votes alone."""
    r = np.random.default_rng(0)
    truth = r.random(40_000) < 0.3
    right, abstain = np.array([0.95, 0.8, 0.9, 0.7, 0.75]), np.array([0.0, 0.2, 0.1, 0.5, 0.0])
    votes = np.where(r.random((40_000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[r.random(votes.shape) < abstain] = 0
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    model = pii.reliabilities(np.zeros(len(patterns), int), patterns, count.astype(float))
    assert abs(model.share[0] - 0.3) < 0.03
    assert np.abs(model.vote[0, 1, :, 2] - right * (1 - abstain)).max() < 0.04
    assert ((model.posterior(np.zeros(40_000, int), votes) > 0.5) == truth).mean() > 0.95


def test_added_spans(spark, docs, empty):
    """Base spans train it, looser forms are found, numbers that fail their check are not."""
    r = random.Random(9)
    card = lambda: next(c for _ in iter(int, 1) if pii.luhn((c := "4" + "".join(r.choice("0123456789") for _ in range(15))).encode()))
    texts = [f"write to ann{i}@mail.example.com or call +1 (212) 555-{1000 + i}" for i in range(60)] + [f"host {r.randint(1, 200)}.7.7.{i} pays by card {card()} today" for i in range(60)]
    texts += [f"order number 98079157628044{i} shipped" for i in range(10, 60) if not pii.luhn(f"98079157628044{i}".encode())]
    loose = "mail joe.doe [at] example [dot] com or call (212) 555-0100 soon; at noon dots are at example"
    texts += [loose, f"cards {card()} {card()} both"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.pii_spans(df).collect()}
    assert [loose[s.start : s.end] for s in got[len(texts) - 2] if not s.base] == ["joe.doe [at] example [dot] com", "(212) 555-0100"]
    assert [(s.kind, s.base) for s in got[len(texts) - 1]] == [("card", False)] * 2
    assert not any(got[i] for i in range(120, len(texts) - 2))
    assert all([s.kind for s in got[i] if s.base] == (["email", "phone"] if i < 60 else ["ip", "card"]) and len(got[i]) == 2 for i in range(120))
    assert pii.pii_spans(empty).count() == 0
    assert pii.pii_spans(docs).count() == docs.count()


def doubled(n: int) -> tuple[str, str]:
    """Two texts of n letters, each the other with letters swapped; a polynomial of any odd base modulo 2 ** 64 gives them one hash from 1,024 on."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [128, 1024, 2048])
def test_words_that_cancel(spark, n):
    one, other = doubled(n)
    head = " ".join(f"w{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {other}"), (3, f"p q r s {one}"), (4, f"p q r s {other}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.substring_dedup(df).collect()} == {0}
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == X.repeated_bytes(texts, 100)


def test_hashes():
    r = np.random.default_rng(3)
    raw = r.integers(97, 99, 5000).astype(np.uint8)
    starts = r.integers(0, 4900, 3000)
    ends = starts + r.integers(1, 60, 3000)
    h, data = K.word_hashes(raw, starts, ends), raw.tobytes()
    seen = {}
    for a, z, x in zip(starts, ends, h.tolist(), strict=True):
        assert seen.setdefault(data[a:z], x) == x
    assert len(set(seen.values())) == len(seen)
    assert (K.run_hashes(raw.astype(np.uint64), starts, ends) == K.run_hashes(np.append(raw, raw).astype(np.uint64), starts + 5000, ends + 5000)).all()


def edited(r, words: list[str], kind: str, regular: bool) -> list[str]:
    """A fifth of the words replaced, deleted or preceded by another, at every fifth place or at random ones."""
    e = len(words) // 5
    at = set(range(2, 5 * e, 5) if regular else r.sample(range(len(words)), e))
    out = []
    for i, w in enumerate(words):
        if i in at:
            out += {"replace": ["zz%d" % r.randrange(10**6)], "delete": [], "insert": ["zz%d" % r.randrange(10**6), w]}[kind]
        else:
            out.append(w)
    return out


def test_decontamination_recall(spark):
    """Copies with a fifth of the words edited, of each kind and size: at least 0.95 of each are found, and nothing else."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda k: [r.choice(vocabulary) for _ in range(k)]
    sizes = (8, 12, 16, 20, 25, 30, 35, 40, 44, 48, 54, 60)
    items = [(i, text(sizes[i % len(sizes)])) for i in range(240)]
    docs, want, doc = [], {}, 0
    for kind in ("replace", "delete", "insert"):
        for regular in (False, True):
            for i, words in items:
                docs.append((doc, " ".join(text(30) + edited(r, words, kind, regular) + text(30))))
                want[doc] = (i, kind, regular)
                doc += 1
    docs += [(doc + k, " ".join(text(200))) for k in range(100)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {x.doc_id: {m.item_id for m in x.matches} for x in decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).collect()}
    assert not any(got[doc + k] for k in range(100))
    hits = Counter()
    for d, (i, kind, regular) in want.items():
        hits[kind, regular, sizes[i % len(sizes)] < 45] += i in got[d]
    total = Counter((kind, regular, sizes[i % len(sizes)] < 45) for i, kind, regular in want.values())
    share = {k: hits[k] / n for k, n in total.items()}
    assert all(s == 1 if short else s >= 0.95 for (_, _, short), s in share.items()), share


def test_embeddings_of_any_scale(spark):
    """Doubles whose squares overflow or vanish link by their cosine as others do; rows without a usable vector stay."""
    r = np.random.default_rng(7)
    base = r.normal(0, 1, (6, 8))
    rows = [(10 * i + k, [float(x) for x in v * s]) for i, v in enumerate(base) for k, s in enumerate((1.0, 1e200, 1e-200, 5e-310 / np.abs(v).min()))]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0] * 3)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows if i < 900}
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    links = {i: {j for j in unit if j != i and cosine(unit[i], unit[j]) >= 0.95} for i in unit}
    assert all(got[i][0] == len(links[i]) >= 3 for i in unit)
    assert all(got[i] == (0, i, True) for i in range(900, 904))
