"""Small cases with known answers."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.functions import scalars as X
from tidemark.operators import audit as A
from tidemark.operators import candidates as C
from tidemark.operators import kernels as N
from tidemark.operators import relations as R
from tidemark.operators import rollups as U
from tidemark.operators import signals as S
from tidemark.operators import statistics as P
from tidemark.plans import audits
from tidemark.plans import series as Z
from tidemark.sources.store import ResultStore, content_hash, inventory, markdown, read_jsonl, speed_series, torn_files
from tidemark.streaming.intake import intake


def series(spark, rows):
    return spark.createDataFrame(rows, "episode long, frame_idx int, detected boolean, x double, y double")


def test_gap_speed(spark):
    seen = {0: (0.0, 0.0), 1: (3.0, 4.0), 6: (18.0, 24.0)}
    df = series(spark, [(1, i, i in seen, *seen.get(i, (None, None))) for i in range(7)])
    out = {r.frame_idx: r.speed for r in S.detected_speed(df).collect()}
    assert out == {0: 0, 1: 5, 2: 0, 3: 0, 4: 0, 5: 0, 6: 5}
    assert {r.frame_idx: r.speed for r in S.detected_speed(df, per_gap=False).collect()}[6] == 25
    assert {r.frame_idx: r.speed for r in S.reset_speed(df).collect()}[6] == 0


@pytest.mark.parametrize(("points", "want"), [([(1, 3.0), (2, 1.0), (7, 2.0), (8, 1.5)], [2, 8]), ([(1, 3.0), (2, 1.0), (3, 2.0), (8, 4.0)], [2, 8])])
def test_minima_split_at_gaps(spark, points, want):
    df = spark.createDataFrame([(1, f, True, p) for f, p in points], "episode long, frame_idx int, detected boolean, pinch double")
    assert sorted(r.frame_idx for r in C.minima(df).collect()) == want


@pytest.mark.parametrize(
    ("candidates", "after", "start", "relaxed"), [([18, 20, 18], None, 15, False), ([0], None, 0, False), ([39], None, 31, False), ([20], 20, 21, False), ([38], 38, 31, True), ([], None, 15, False)]
)
def test_consecutive_grid(spark, candidates, after, start, relaxed):
    df = spark.createDataFrame([(candidates, 40, after)], "candidates array<int>, num_frames int, after int")
    r = C.consecutive_grid(df, min_index=None if after is None else "after").first()
    assert (r.start, r.relaxed) == (start, relaxed)


@pytest.mark.parametrize(("values", "want"), [([1, 2], 2), ([2, 3], 2), ([1, None, -1, 3], 2), ([None, -1], None)])
def test_rounded_mean(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "prediction int")
    assert df.agg(U.rounded_mean()).first()[0] == want


def test_statistics(spark):
    df = spark.createDataFrame([(1, 0, 0.01), (2, 0, 0.04), (3, 0, 0.03), (4, 0, None)], "id int, family int, p double")
    got = {r.id: r.adjusted for r in P.holm(df, "family").collect()}
    assert [round(got[i], 9) for i in (1, 2, 3)] == [0.03, 0.06, 0.06] and got[4] is None
    df = spark.createDataFrame([(s, s * float(v)) for s in (1, -1) for v in (1, 2, 3)], "g int, difference double")
    assert {r.g: r.r for r in P.signed_ranks(df, "g").select("g", P.rank_biserial().alias("r")).collect()} == {1: 1.0, -1: -1.0}
    assert P.bootstrap(np.array([1.0, 1, 1]), 3) == (1.0, 1.0) and P.bootstrap(np.array([]), 3) == (None, None) and P.bootstrap(np.array([4.0]), 3) == (4.0, 4.0)
    assert P.bootstrap(np.arange(9), 5) == P.bootstrap(np.arange(9), 5)
    assert P.wilcoxon_p(np.zeros(4)) == (0.0, 1.0) and P.wilcoxon_p(np.array([])) == (None, None)
    assert P.wilcoxon_p(np.array([1.0, 2, 3])) == (0.0, 0.25)


def test_answers(spark):
    texts = ['so {"points": [4]}', '{"points": [2]} correction {"points": [7]}', "none", '{"points": [2, 3]}', '{"points": [-1]}', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.parse_cell("t")).collect()] == [4, 7, None, None, -1, None]
    assert [r[0] for r in df.select(X.parse_point_first("t")).collect()] == [4, 2, -1, 2, -1, -1]
    df = spark.createDataFrame([(c, 5) for c in (None, -1, 0, 10, 5, 6)], "cell int, gt int")
    assert [round(r[0], 6) for r in df.select(X.gaussian_reward("cell", "gt")).collect()] == [0, 0, 0, 0, 1, round(float(np.exp(-0.5)), 6)]


def test_pairs_and_spacing_match_a_walk(spark):
    r = np.random.default_rng(1)
    rows = [(e, ["Contact", "Separation", "Neither"][k], f, float(s)) for e in range(30) for f, (k, s) in enumerate(zip(r.integers(0, 3, 25), r.integers(1, 6, 25), strict=True))]
    got = sorted(map(tuple, C.pair_events(spark.createDataFrame(rows, "episode long, event string, frame_idx int, speed double")).collect()))
    want = []
    for e in range(30):
        kept = []
        for _, event, f, s in (x for x in rows if x[0] == e):
            if event == "Contact" and (not kept or s < kept[-1][1]):
                kept.append((f, s))
            if event == "Separation" and kept:
                want.append((e, min(kept, key=lambda x: x[1])[0], f))
                kept = []
    assert got == sorted(want)


def test_direct_grid_matches_a_walk(spark):
    r = np.random.default_rng(2)
    rows = [(i, [int(x) for x in r.permutation(n)[: r.integers(0, 6)]], [int(x) for x in r.permutation(n)[: r.integers(0, 12)]], int(n)) for i, n in enumerate(r.integers(9, 40, 60))]
    df = spark.createDataFrame(rows, "i long, candidates array<int>, pool array<int>, num_frames int")
    for anchor in ("start", "end"):
        got = {x.i: x.grid for x in C.direct_grid(df, anchor).collect()}
        for i, cand, pool, n in rows:
            half = (lambda f, n=n: f < n // 2) if anchor == "start" else (lambda f, n=n: f >= n // 2)
            seed = list(dict.fromkeys(f for f in cand if half(f)))[:9] or list(dict.fromkeys(cand))[:9]
            out = list(seed)
            steps = ([round(float(np.mean(seed)))] if seed else []) + [f for f in pool if half(f)] + pool
            out = list(dict.fromkeys(out + steps))[:9]
            center = sorted(seed or out)
            for radius in range(1, n + 1):
                out = list(dict.fromkeys(out + [f for c in center for f in (c - radius, c + radius) if 0 <= f < n]))
            out = list(dict.fromkeys(out + list(range(n))))[:9]
            assert got[i] == sorted(out), (i, anchor)


def test_kernels():
    assert list(N.peaks(np.array([0, 1, 1, 0, 2, 0]))) == [1, 4]
    assert np.allclose(N.gaussian_smooth(np.ones(20), 3), 1) and np.allclose(N.savitzky_golay(np.arange(9.0) ** 2, 5, 2)[2:-2], np.arange(2, 7) ** 2)
    x = np.arange(6.0)
    assert np.allclose(N.smoothing_spline(x, 2 * x + 1, np.linspace(0, 5, 11)), 2 * np.linspace(0, 5, 11) + 1)
    assert N.active_span(np.zeros(10)) == (-1, -1)
    r = np.random.default_rng(0)
    a, c = r.normal(0, 1, (60, 3)), np.cos(0.005)
    turn = np.array([[c, -np.sin(0.005), 0], [np.sin(0.005), c, 0], [0, 0, 1]])
    t = N.align_points(a, a @ turn.T + 0.004, reach=0.05)
    assert np.allclose(a @ t[:3, :3].T + t[:3, 3], a @ turn.T + 0.004, atol=1e-6)
    depth = np.full((6, 6), 9.0)
    depth[0, :3], depth[4:, 4] = 1, 1
    assert [int((N.nearest_blobs(depth, 30, 2) == k).sum()) for k in (1, 2)] == [3, 2]
    assert N.local_minima(np.arange(3), np.ones(3)) == []


def test_local_minima_of_known_curves():
    """Valleys of a wave, each kind: where they lie, slowest first, and what it leaves out."""
    f = np.arange(80)
    wave = 5 + 3 * np.cos(2 * np.pi * f / 20) + f / 100  # valleys at 10, 30, 50, 70, each a little higher
    got = N.local_minima(f, wave, "short")
    assert [round(x / 20 - 0.5) for x, _ in got] == [0, 1, 2, 3] and all(abs(x % 20 - 10) <= 1 and v == wave[x] for x, v in got)
    assert [x for x, _ in N.local_minima(f + 5, wave, "short")] == [x + 5 for x, _ in got]
    spoiled = wave.copy()
    spoiled[[5, 25, 45]] = 31, np.nan, 0  # too fast, unknown, unknown: left out for clips
    assert all(abs(x % 20 - 10) <= 2 for x, _ in N.local_minima(f, spoiled, "short")) and len(N.local_minima(f, spoiled, "short")) == 4
    g = np.arange(280)
    long = 5 + 3 * np.cos(2 * np.pi * g / 70) + 0.05 * np.cos(2 * np.pi * g / 7)  # valleys at 35, 105, 175, 245 under a ripple
    for kind in ("long", "long_vda"):
        found = sorted(x for x, _ in N.local_minima(g, long, kind))
        assert len(found) == 4 and all(abs(x - v) <= 4 for x, v in zip(found, (35, 105, 175, 245), strict=True)), (kind, found)
    outlier = long.copy()
    outlier[140] = 900.0
    found = sorted(x for x, _ in N.local_minima(g, outlier, "long_vda"))
    assert len(found) == 4 and all(abs(x - v) <= 4 for x, v in zip(found, (35, 105, 175, 245), strict=True))
    assert sorted(x for x, _ in N.local_minima(g, outlier, "long")) != found  # it is the quartiles that cut it


def test_store_and_readers(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/store", "h")
    rows = spark.createDataFrame([("a", "success"), ("b", "failed"), ("b", "failed")], "key string, status string")
    assert store.append(rows) == 2 and store.append(rows) == 0
    with pytest.raises(ValueError):
        ResultStore(spark, f"file://{tmp_path}/store", "other").append(rows)
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("c", "odd")], "key string, status string"))
    (tmp_path / "x.jsonl").write_text('{"k":"a","v":1}\nbad\n{"k":"a","v":2}\n{"k":"b"')
    got = read_jsonl(spark, f"{tmp_path}/x.jsonl", rows.select(F.col("key").alias("k")).schema)
    assert got.where("k is not null").count() == 2 and torn_files(spark, f"{tmp_path}/x.jsonl").first().torn
    assert [r.k for r in R.latest_per_key(got.where("k is not null"), "k", "line").collect()] == ["a"]
    caches = spark.createDataFrame([(1, json.dumps({"0": 0.5, "1": None})), (2, json.dumps([[1, 2.0], [2, None]]))], "episode long, value string")
    assert [(r.episode, r.frame_idx, str(r.speed)) for r in speed_series(caches).orderBy("episode", "frame_idx").collect()] == [(1, 0, "0.5"), (1, 1, "nan"), (2, 1, "2.0"), (2, 2, "nan")]
    assert content_hash({"b": 1, "a": 2, "z": 0}, ("z",)) == content_hash({"a": 2, "b": 1})
    assert inventory(spark, f"file://{tmp_path}", "*.jsonl").first().suffix == ".jsonl"
    assert markdown(rows.limit(1)).startswith("| key | status |")


def test_intake_is_idempotent(spark, tmp_path):
    schema = "episode long, speed double"
    spark.createDataFrame([(1, 0.5), (2, 0.7)], schema).write.parquet(f"{tmp_path}/in")
    store = ResultStore(spark, f"file://{tmp_path}/out", "h")
    evaluate = lambda df: df.select(F.col("episode").cast("string").alias("key"), F.lit("success").alias("status"))
    from pyspark.sql.types import StructType

    for checkpoint in ("c1", "c1", "c2"):  # again, and again without its checkpoint
        intake(spark, f"{tmp_path}/in", StructType.fromDDL(schema), evaluate, store, f"{tmp_path}/{checkpoint}").awaitTermination(120)
        assert store.read().count() == 2


def test_audit_rules(spark):
    df = spark.createDataFrame([(1, 12, 100, 111, 2, 102, 9), (2, 12, 100, 112, 13, 113, 1)], "episode int, num_frames int, start_frame int, end_frame int, contact_local int, contact_global int, separate_local int")
    assert sorted(map(tuple, A.violations(df, "episode", A.MANIFEST).collect())) == [(2, "contact_range"), (2, "length"), (2, "order")]
    counts = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 0)], "missing int, unexpected int, duplicate int, errors int")
    assert [r.success for r in A.summary(counts).collect()] == [True, False]


def test_plans(spark):
    from tidemark.sources import tables as T

    plan = C.slowest(T.frames(spark, SMALL), 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "props" not in plan
    plan = S.trailing_mean(S.detected_speed(T.frames(spark, SMALL)), "speed")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # all windows of a series share one exchange
    modes = C.mode_candidates(C.cue_lists(T.frames(spark, SMALL)))
    assert modes.where("mode = 'speed'").where(F.size(F.array_except("cues", "speed_list")) > 0).count() == 0


def test_scans_of_wide_queries(spark):
    """Queries over several signals read their table once for all of them, and once more for the labels."""
    for name, run, scans, exchanges in (("grid_recall", Z.QUERIES["grid_recall"][0], 2, 3), ("closed_loop", audits.QUERIES["closed_loop"][0], 2, 3), ("pairwise", audits.QUERIES["pairwise"][0], 3, 99)):
        plan = run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= scans, (name, plan.count("FileScan parquet"))
        assert plan.count("Exchange hashpartitioning") <= exchanges, (name, plan.count("Exchange hashpartitioning"))
