"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the base matches of four kinds, base matches that fail their check, and looser forms (spelled-out
addresses, numbers without a plus, split octets, odd separators). Labelers vote 1, 0 or -1 on each: two regexes (the
checked base form, the usual layout), gazetteers (top-level domains, country codes, issuer digits, reserved networks),
the context before it and its edges. Expectation-maximisation over the counts of vote patterns estimates, kind by kind,
how often each labeler votes how on personal data and on other text. The posteriors are the soft labels of the span
classifier, a ridge logistic regression on features of the span, fitted by Newton steps over sums that Spark adds up.
Base spans always stay; the classifier adds other candidates that overlap none of those chosen.

Each text is read once; what is kept of it are its candidates. The driver sees vote patterns (at most 3 ** 5 a kind)
and sums of a fixed size. Work on a text is linear in its length.

Defined results: null and empty texts have no spans; equal rows get equal rows; spans of one kind never overlap; of
candidates at one place the longer goes first; without candidates, or of one vote pattern alone, nothing is added; an
empty table gives an empty result. Columns besides the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, materialize, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "layout", "gazetteer", "context", "edges")

# The base forms. A lookbehind or a possessive part only spares starts that cannot match; a form that
# begins with one character of a set is searched fastest.
DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(rb"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

# Looser forms, with the same four kinds; what may stand before one is looked for at its place.
SPELLED = re.compile(rb"\x20(?:at|AT)\x20|[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?")
SPELLED_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]+)+")
SPLIT_IP = re.compile(rb"[0-9](?<![0-9][0-9])[0-9]{0,2}(?:(?:\[\.\]|\(\.\)|\x20?\.\x20?)[0-9]{1,3}){3}(?![0-9])")
LONE_CARD = re.compile(rb"[0-9](?<![0-9][0-9])(?:[0-9]{3}(?:[./_\x20-]{1,3}[0-9]{4}){2}[./_\x20-]{1,3}[0-9]{2,7}|[0-9]{13,18})(?![0-9])")
LONE_PHONE = re.compile(rb"[0-9](?<![0-9][0-9])[0-9]{2}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{4}(?![0-9])")
CODE = re.compile(rb"(?:(?:\+|(?<![0-9])00)[1-9][0-9]{0,2}[\x20.-]?)?\(?$")

# Gazetteers and cues, fixed values.
TOP_LEVEL = frozenset(b"com org net edu gov mil int info biz io dev app ai co uk de fr es it nl eu us ca au jp cn in br ru ch at be se no dk fi pl pt ie nz za mx".split())
CALLING = tuple(b"1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972".split())
CUES = (
    re.compile(rb"mail|contact|write|reach|courriel|correo|kontakt|from|sender|reply", re.I),
    re.compile(rb"\bips?\b|address|host|server|login|client|adresse|direcci|logged", re.I),
    re.compile(rb"card|visa|credit|debit|payment|carte|karte|tarjeta|account", re.I),
    re.compile(rb"phone|call|tel|mobile|cell|fax|whatsapp|appel|anruf|llam", re.I),
)
AGAINST = re.compile(rb"version|release|isbn|issn|doi|section|figure|page|build|firmware|chapter|order|serial|invoice|sku", re.I)
INSIDE = re.compile(rb"[A-Za-z0-9_\x80-\xff]")
REACH = 40  # bytes of context before a span
FEATURES = 9
SIZE = len(KINDS) * FEATURES


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = (c - 48) << (k & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def number(text: bytes) -> bytes:
    return re.sub(rb"[^0-9]", b"", text)


def octets(text: bytes) -> list[bytes]:
    return re.findall(rb"[0-9]+", text)


def holds(kind: int, text: bytes) -> bool:
    """Whether a base match passes its check."""
    if kind == 1:
        return all(len(x.lstrip(b"0")) < 4 and int(x.lstrip(b"0") or b"0") <= 255 for x in octets(text))
    digits = number(text) if kind else b""
    return kind == 0 or (kind == 2 and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == 3 and 10 <= len(digits) <= 15)


def emails(t: bytes) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find(b"@")
    while at >= 0:
        size = len(t[done:at]) - len(t[done:at].rstrip(LOCAL))
        m = DOMAIN.match(t, at) if size else None
        if m:
            yield at - size, m.end()
        done = m.end() if m else at + 1
        at = t.find(b"@", done)


def spelled(t: bytes) -> Iterator[tuple[int, int]]:
    done = 0
    for m in SPELLED.finditer(t):
        if m.start() >= done:
            until = m.start() - (t[m.start() - 1 : m.start()] == b" ")
            size = len(t[done:until]) - len(t[done:until].rstrip(LOCAL))
            d = SPELLED_DOMAIN.match(t, m.end()) if size > 0 else None
            if d and (m[0].strip() != b"at" or re.search(rb"dot|DOT|\.[A-Za-z]", d[0])):
                yield until - size, d.end()
                done = d.end()
            else:
                done = m.end()


def phones(t: bytes) -> Iterator[tuple[int, int]]:
    for m in LONE_PHONE.finditer(t):
        yield m.start() - len(CODE.search(t[max(0, m.start() - 8) : m.start()])[0]), m.end()


def base(t: bytes) -> Iterator[tuple[int, int, int, bool]]:
    """kind, start, end, whether its check holds, of each base match."""
    for start, end in emails(t):
        yield 0, start, end, True
    for kind, form in ((1, IP), (2, CARD), (3, PHONE)):
        for m in form.finditer(t):
            if kind != 2 or m.end() - m.start() > 10:  # shorter digit runs are no candidates
                yield kind, m.start(), m.end(), holds(kind, m[0])


def candidates(t: bytes) -> list[tuple[int, int, int, bool, bool]]:
    """kind, start, end, base (kept whatever the model says), failed (its check does not hold); none but base ones overlap a base one."""
    found = [(k, a, z, ok, not ok) for k, a, z, ok in base(t)]
    kept = sorted((a, z) for _, a, z, ok, _ in found if ok)
    starts, reach = [a for a, _ in kept], list(accumulate((z for _, z in kept), max))
    free = lambda a, z: not (i := bisect_left(starts, z)) or reach[i - 1] <= a
    out = [c for c in found if c[3] or free(*c[1:3])]
    there = {c[:3] for c in out}
    for kind, spans in ((0, spelled(t)), (1, (m.span() for m in SPLIT_IP.finditer(t))), (2, (m.span() for m in LONE_CARD.finditer(t))), (3, phones(t))):
        out.extend((kind, a, z, False, not holds(kind, t[a:z])) for a, z in spans if (kind, a, z) not in there and free(a, z))
    return sorted(out, key=lambda c: (c[1], c[0], -c[2]))


def votes(t: bytes, kind: int, start: int, end: int, kept: bool, failed: bool) -> tuple[int, ...]:
    s = t[start:end]
    digits = number(s)
    form = 1 if kept else -1 if failed else 0
    if kind == 0:
        layout = 1 if re.fullmatch(rb"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", s) else 0
        known = 1 if re.split(rb"[^A-Za-z0-9-]+", s)[-1].lower() in TOP_LEVEL else -1
    elif kind == 1:
        parts = octets(s)
        layout = 1 if re.fullmatch(rb"(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}", s) else -1
        known = 1 if 0 < int(parts[0][-4:]) < 224 and parts[0] != b"127" else -1
    elif kind == 2:
        layout = 1 if re.fullmatch(rb"[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{2,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5}", s) else 0
        known = 1 if digits[:1] in b"3456" and holds(kind, s) else -1
    else:
        layout = 1 if re.search(rb"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^\+[0-9]{10,15}$|^\+[0-9]{1,3}(?:[\x20.-][0-9]{2,4}){3,5}$", s) else 0
        bare = digits[2:] if s.startswith(b"00") else digits
        known = (1 if bare.startswith(CALLING) else -1) if s[:1] == b"+" or s.startswith(b"00") else 0
    before = t[max(0, start - REACH) : start]
    context = 1 if CUES[kind].search(before) else -1 if AGAINST.search(before) else 0
    return form, layout, known, context, edges(t, start, end)


def edges(t: bytes, start: int, end: int) -> int:
    """-1 if a letter or digit touches the span, or a dot and a digit follow."""
    inside = sum(bool(INSIDE.match(t, i)) for i in (start - 1, end) if 0 <= i < len(t)) + (t[end : end + 1] == b"." and t[end + 1 : end + 2].isdigit())
    return -1 if inside else 1


def features(t: bytes, kind: int, start: int, end: int, failed: bool) -> list[float]:
    """Of the span itself, and what stands beside it."""
    s = t[start:end]
    digits = len(number(s))
    marks = sum(c in b" ()[]{}./_" for c in s) if kind != 0 else sum(c in b" ()[]{}" for c in s)
    before = t[max(0, start - REACH) : start]
    return [1.0, digits / len(s), min(len(s), 60) / 60, min(marks, 8) / 8, float(failed), float(s[:1] == b"+"), float(CUES[kind].search(before) is not None), float(AGAINST.search(before) is not None), float(edges(t, start, end) > 0)]


FOUND = "array<struct<kind:tinyint,start:int,end:int,base:boolean,votes:array<tinyint>,x:array<float>>>"
_FOUND = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int8())), ("x", pa.list_(pa.float32()))]))


def labelled(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, found: the candidates of each text, places in code points, with their votes and features."""

    def one(text: str) -> list[dict]:
        t = text.encode()
        found = candidates(t)
        if not found:
            return []
        # code points before each byte
        place = np.arange(len(t) + 1) if len(t) == len(text) else np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
        return [{"kind": k, "start": int(place[a]), "end": int(place[z]), "base": kept, "votes": votes(t, k, a, z, kept, failed), "x": features(t, k, a, z, failed)} for k, a, z, kept, failed in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([one(x.as_py() or "") for x in b.column("text")], _FOUND)], names=["doc_id", "found"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, found {FOUND}")


@dataclass
class Model:
    """share: of personal data among a kind's candidates; vote[kind]: class x labeler x (-1, 0, 1); weight of each feature."""

    share: np.ndarray
    vote: np.ndarray
    weight: np.ndarray

    def posterior(self, kind: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Probability of personal data by the votes (-1, 0, 1) of each row."""
        log = np.log(np.stack([1 - self.share, self.share], 1))[kind]
        for k in range(len(LABELERS)):
            log = log + np.log(self.vote[kind, :, k, given[:, k] + 1])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))

    def probability(self, kind: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.weight[kind] * x).sum(1), -50, 50)))


def reliabilities(kind: np.ndarray, given: np.ndarray, count: np.ndarray, rounds: int = 100, prior: float = 1.0) -> Model:
    """EM over vote patterns with their counts; it begins at the mean vote. A labeler is taken to be right more often than not (prior)."""
    agree = np.array([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]])  # pseudo-counts of -1, 0, 1 by class
    share = np.full(len(KINDS), 0.5)
    vote = np.tile(agree[None, :, None, :], (len(KINDS), 1, len(LABELERS), 1))
    model = Model(share, vote, np.zeros((len(KINDS), FEATURES)))
    p = 1 / (1 + np.exp(-3 * given.mean(1)))
    for _ in range(rounds):
        for k in range(len(KINDS)):
            n = count * (kind == k)
            share[k] = (n @ p + prior / 2) / (n.sum() + prior)
            for c, q in ((0, 1 - p), (1, p)):
                for j in range(len(LABELERS)):
                    seen = np.array([n @ (q * (given[:, j] == v)) for v in (-1, 0, 1)]) + 3 * prior * agree[c]
                    vote[k, c, j] = seen / seen.sum()
        new = model.posterior(kind, given)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return model


def fit(spans: DataFrame, steps: int = 8, ridge: float = 0.1) -> Model:
    """EM on the vote patterns of spans(kind, votes, x), then the classifier on its posteriors."""
    seen = spans.groupBy("kind", "votes").count().collect()  # at most 3 ** 5 patterns a kind
    seen.sort(key=lambda r: (r["kind"], r["votes"]))
    kind, given = np.array([r["kind"] for r in seen], np.int64), np.array([r["votes"] for r in seen], np.int64).reshape(-1, len(LABELERS))
    model = reliabilities(kind, given, np.array([r["count"] for r in seen], float))
    shape = (FEATURES + 1, FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(KINDS), *shape))
        for b in batches:
            kind = b.column("kind").to_numpy().astype(np.int64)
            x = np.asarray(b.column("x").flatten(), float).reshape(-1, FEATURES)
            y = model.posterior(kind, np.asarray(b.column("votes").flatten(), np.int64).reshape(-1, len(LABELERS)))
            p = model.probability(kind, x)
            for k in range(len(KINDS)):
                own = kind == k
                total[k, :-1] += (x[own] * (p * (1 - p))[own, None]).T @ x[own]
                total[k, -1] += x[own].T @ (y - p)[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "part"])

    for _ in range(steps if seen else 0):
        added = np.zeros((len(KINDS), *shape))
        for r in spans.select("kind", "votes", "x").mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("part")).collect():  # a fixed number of sums
            added.flat[r["at"]] = r["part"]
        move = [np.linalg.solve(a[:-1] + ridge * np.eye(FEATURES), a[-1] - ridge * w) for a, w in zip(added, model.weight, strict=True)]
        model.weight = np.round(model.weight + move, 9)
        if np.abs(move).max() < 1e-4:
            break
    return model


def chosen(found: list[dict], model: Model, least: float) -> list[tuple[int, str, int, float | None]]:
    """start, kind, end, probability (null for base spans) of what stays of a text's candidates, in order."""
    out = [(c["start"], c["kind"], c["end"], None) for c in found if c["base"]]
    rest = [c for c in found if not c["base"]]
    if rest:
        p = model.probability(np.array([c["kind"] for c in rest]), np.array([c["x"] for c in rest], float))
        last = 0
        for c, q in zip(rest, p.tolist(), strict=True):
            if q >= least and c["start"] >= last:
                out.append((c["start"], c["kind"], c["end"], q))
                last = c["end"]
    return [(a, KINDS[k], z, q) for a, k, z, q in sorted(out, key=lambda s: s[:3])]


def pii_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.9) -> DataFrame:
    """doc_id, spans of each row: start, end (code points, end exclusive), kind, base, and the classifier's probability of those that it adds (from `least` on)."""
    arrow_rows(docs.sparkSession)
    stored = materialize(labelled(docs, text, doc_id), "candidates")
    model = fit(stored.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.x"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": a, "end": z, "kind": k, "base": q is None, "probability": q} for a, k, z, q in chosen(f, model, least)] if f else [] for f in b.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return stored.mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, spans array<struct<start:int,end:int,kind:string,base:boolean,probability:double>>")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document."""
    found = pii_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))
