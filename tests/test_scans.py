"""Scans over runs against the window forms; ranks, Holm and the bootstrap over scopes that lie in several tasks."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators import long_series as L
from tidemark.operators import resampling as B
from tidemark.operators import runs as R
from tidemark.operators import signals as S
from tidemark.operators import statistics as P


@pytest.fixture(scope="module")
def frames(spark):
    r = random.Random(2)
    out = []
    for e, n, share in (("hot", 900, 0.6), ("none", 5, 0.0), ("one", 7, 0.0), ("all", 40, 1.0), (None, 12, 0.5)):
        for i in range(n):
            if i % 41 != 40:  # some frames have no row
                out.append((e, i, r.random() < share or (e == "one" and i == 3), r.uniform(0, 9), r.uniform(0, 9), float(r.randint(0, 4))))
    r.shuffle(out)
    return spark.createDataFrame(out, "episode string, frame_idx int, detected boolean, x double, y double, pinch double").cache()


def table(df, *columns):
    return sorted((tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("run", [1, 37, 10_000])
def test_long_series(frames, run):
    for gap in (True, False):
        assert table(L.detected_speed(frames, gap, run), "episode", "frame_idx", "speed") == table(S.detected_speed(frames, gap), "episode", "frame_idx", "speed")
    assert table(L.interpolated_speed(frames, 0.5, run), "episode", "frame_idx", "speed") == table(S.interpolated_speed(frames, 0.5), "episode", "frame_idx", "speed")
    for segmented in (True, False):
        assert table(L.minima(frames, segmented, run), "episode", "frame_idx", "pinch") == table(C.minima(frames, segmented), "episode", "frame_idx", "pinch")
    assert L.minima(frames.limit(0)).count() == 0 and L.detected_speed(frames.limit(0)).count() == 0


def test_a_hot_series_lies_in_many_tasks(frames):
    placed = R.in_runs(frames, ["episode"], ["frame_idx"], 100)
    assert placed.where("episode = 'hot'").select(R.RUN).distinct().count() >= 4
    out = R.carried(placed, ["episode"], ["frame_idx"], {"n": ("sum", F.lit(1)), "most": ("max", F.col("x"))})
    got = out.where("episode = 'hot'").toPandas().sort_values("frame_idx")
    assert got["n"].tolist() == list(range(len(got)))
    want = got["x"].cummax().shift(1)
    assert np.allclose(got["most"].astype(float).iloc[1:], want.iloc[1:]) and math.isnan(got["most"].astype(float).iloc[0])


def average_ranks(values):
    order = sorted(values)
    return [sum(i + 1 for i, x in enumerate(order) if x == v) / order.count(v) for v in values]


def test_signed_ranks_and_probabilities(spark):
    r = random.Random(5)
    scopes = {"hot": [r.randint(-60, 70) for _ in range(800)], "short": [1.5, -2.5, 3.5], "zero": [0.0, 0.0], "ties": [1, 1, -1, 2, 0]}
    rows = [(s, float(d)) for s, v in scopes.items() for d in v] + [("hot", None), ("hot", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "scope string, difference double")
    for run in (10, 10_000):
        ranks = {x.scope: x for x in P.signed_ranks(df, "scope", run=run).collect()}
        for s, v in scopes.items():
            d = [x for x in v if x]
            if d:
                rank = average_ranks([abs(x) for x in d])
                assert ranks[s].positive == sum(k for k, x in zip(rank, d, strict=True) if x > 0) and ranks[s].n == len(d)
                assert ranks[s].negative == sum(k for k, x in zip(rank, d, strict=True) if x < 0)
        assert set(ranks) == {"hot", "short", "ties"}
        got = {x.scope: (x.statistic, x.p) for x in P.wilcoxon(df, "scope", run=run).collect()}
        assert set(got) == set(scopes)
        for s, v in scopes.items():
            w, p = P.wilcoxon_p(np.array(v, float))
            assert got[s][0] == w and math.isclose(got[s][1], p, rel_tol=1e-12)
    assert R.in_runs(P.size_counts(df, "scope"), ["scope"], ["size"], 10).where("scope = 'hot'").select(R.RUN).distinct().count() >= 4


def test_holm_over_runs(spark):
    r = random.Random(6)
    rows = [("big", i, r.random() / 50) for i in range(500)] + [("small", 1, 0.04), ("small", 2, 0.01), ("small", 3, 0.03), ("small", 4, None), ("small", 5, float("nan")), (None, 1, 0.2)]
    df = spark.createDataFrame(rows, "family string, id int, p double")
    want = {}
    for f in ("big", "small", None):
        fine = sorted((p, i) for g, i, p in rows if g == f and p is not None and not math.isnan(p))
        most = 0.0
        for k, (p, i) in enumerate(fine):
            most = max(most, min(1.0, (len(fine) - k) * p))
            want[(f, i)] = most
    for run in (20, 10_000):
        got = {(x.family, x.id): x.adjusted for x in P.holm(df, "family", run=run).collect()}
        assert len(got) == len(rows) and all((v is None) == (k not in want) and (v is None or math.isclose(v, want[k])) for k, v in got.items())


def test_bootstrap_is_one_however_rows_are_dealt(spark):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"scope": ["hot"] * 3000 + ["b"] * 40 + ["single"] + ["none"], "id": range(3042), "v": [*np.round(r.normal(10, 4, 3000)), *np.round(r.normal(0, 1, 40)), 7.0, np.nan]})
    df = spark.createDataFrame(pdf)
    runs = [{x.scope: (x.mean, x.n, x.low, x.high) for x in B.merged_bootstrap(df.repartition(k, "id"), "scope", "v", ["id"], 11, 400).collect()} for k in (1, 7)]
    assert runs[0] == runs[1] and set(runs[0]) == {"hot", "b", "single"}
    assert runs[0]["single"] == (7.0, 1, 7.0, 7.0)
    mean, n, low, high = runs[0]["hot"]
    half = 1.96 * 4 / math.sqrt(3000)
    assert n == 3000 and abs((high - low) / 2 - half) < 0.15 * half and low < mean < high
    assert {x.scope: x.low for x in B.merged_bootstrap(df, "scope", "v", ["id"], 12, 400).collect()}["hot"] != low


def test_bootstrap_covers(spark):
    """Of 300 samples of 60 values the interval holds the true mean about 95 times in 100."""
    r = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"sample": np.repeat(np.arange(300), 60), "id": np.tile(np.arange(60), 300), "v": r.exponential(1.0, 18_000)}))
    got = B.merged_bootstrap(df, "sample", "v", ["sample", "id"], 1, 300).agg(F.avg(((F.col("low") <= 1) & (F.col("high") >= 1)).cast("double"))).first()[0]
    assert 0.89 < got < 0.98


def test_poisson_counts():
    c = B.counts(np.arange(20_000, dtype=np.uint32), 50)
    share = np.bincount(c.ravel(), minlength=6)[:6] / c.size
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(6)], atol=0.003)
    assert abs(np.corrcoef(c[:, 0], c[:, 1])[0, 1]) < 0.03 and abs(c.mean() - 1) < 0.01
