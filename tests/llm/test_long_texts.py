"""Texts over a megabyte, longer than the chunks that kernels work in: nothing is cut, whichever operator reads them."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SMALL
from tests.llm import fixtures as X
from tidemark.llm import chat, decontamination, language, line_dedup, packing, quality, tokens

VOCABULARY = [f"w{i}" for i in range(5000)]


@pytest.fixture(scope="module")
def long():
    r = random.Random(1)
    return "\n".join(" ".join(r.choice(VOCABULARY) for _ in range(r.randint(8, 14))) for _ in range(20_000))


@pytest.fixture(scope="module")
def docs(spark, long):
    assert len(long) > 1_200_000
    r = random.Random(2)
    short = [" ".join(r.choice(VOCABULARY) for _ in range(60)) for _ in range(20)]
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(i, t) for i, t in enumerate(short)] + [(100, long), (101, f"{long}\n{item}"), (102, item)]
    return spark.createDataFrame([(i, t, "en", "s", len(t), "x", "y", "z") for i, t in rows], X.SCHEMA).repartition(3).cache()


def test_decontamination(spark, docs, long):
    """An item at the very end of a long text is found, at its place."""
    bench = spark.createDataFrame([(7, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string")
    got = {r.doc_id: [(m.item_id, m.start, m.edits) for m in r.matches] for r in decontamination.matches(docs, bench).collect() if r.matches}
    assert got == {101: [(7, len(X.words(long)), 0)], 102: [(7, 0, 0)]}


def test_line_dedup(docs, long):
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    kept = got[100].text.split("\n")
    assert got[100].n_lines == 20_000 and got[100].n_removed == 20_000 - len(kept) and set(kept) <= set(long.split("\n")) and len(kept) > 19_000
    assert got[101].n_lines == 20_001 and got[101].text == " ".join(f"q{i}" for i in range(20)) and got[102].text == ""


def test_packing(docs, long):
    ids = tokens.bpe(packing.__dict__.get("VOCABULARY") or __import__("public_tokenizers").path("byte_bpe_50k.json")).ids(long)
    rows = [r for r in packing.pack(docs).collect() if r.doc_id == 100]
    assert sum(r.length for r in rows) == len(ids) // 4 + 1 and sorted(r.piece for r in rows) == list(range(len(rows))) and all(r.length <= 1024 for r in rows)


def test_scores(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality_classifier(docs, labels).collect()}
    assert len(got) == 23 and all(0 <= s <= 1 for s in got.values())
    found = {r.doc_id: r.lang_pred for r in language.language_id(docs).collect()}
    assert found[100] == "en" and found[101] == "en"


def test_chat(spark, long):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "user", long[:50]), (1, 3, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    df.coalesce(1).write.mode("overwrite").parquet((base := f"file:///tmp/tidemark-test-{random.getrandbits(60):x}") + "/conversations.parquet")
    got = {r.conv_id: r for r in chat.op10_chat_formatting(spark, base).collect()}[1]
    digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in turns).encode()).hexdigest()
    answers = long + "<|im_end|>"
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (4, digest, len(answers), hashlib.sha256(answers.encode()).hexdigest())


def test_pipeline(spark, docs):
    left = docs
    for _, stage in P.STAGES:
        left = stage(spark, left, SMALL)
    assert left.agg(F.sum("length")).first()[0] > 0
