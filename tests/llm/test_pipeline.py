from __future__ import annotations

import corpus_pipeline as P
from tests.conftest import SMALL
from tests.llm import fixtures as X
from tidemark.llm.common import materialize, table


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    before = docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        given = {r.doc_id: r.text for r in docs.collect()}
        docs = materialize(stage(spark, docs, SMALL), name)
        if k < len(P.STAGES) - 1:
            assert docs.columns == list(P.COLUMNS)
            left = {r.doc_id: r.text for r in docs.collect()}
            assert set(left) <= set(given)
        if name == "line_dedup":
            lines = [x for t in left.values() for x in t.split("\n") if x.strip()]
            assert len(lines) == len({x.strip().lower() for x in lines})
        if name == "ngram_jaccard_join":
            groups = X.jaccard_groups(given)
            assert set(left) == {i for i, (_, c) in groups.items() if c == i} and all(left[i] == given[i] for i in left)
        if name == "benchmark_decontamination":
            items = [" ".join(X.words(r.text)).lower() for r in table(spark, SMALL, "benchmark").collect()]
            assert not any(b in " ".join(X.words(t)).lower() for t in left.values() for b in items)
    assert 0 < docs.select("doc_id").distinct().count() < before
    assert set(docs.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_odd_rows(spark):
    rows = X.corpus(40) + [(7, None, None, None, None, "x", "y", "z"), (None, "alone here", None, None, None, "x", "y", "z")]
    docs = spark.createDataFrame(rows, X.SCHEMA)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() > 0
    none = spark.createDataFrame([], X.SCHEMA)
    for _, stage in P.STAGES:
        none = stage(spark, none, SMALL)
    assert none.count() == 0
