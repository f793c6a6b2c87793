"""Loaders, sinks, the answer boundary and NumPy kernels: small cases with known answers."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import scalars as X
from tidemark.operators import candidates as C
from tidemark.operators import kernels as N
from tidemark.operators import resampling as B
from tidemark.operators import signals as S
from tidemark.sources import answers as W
from tidemark.sources import datasets as D
from tidemark.sources import store as O


def test_checked_columns(spark, tmp_path):
    schema = StructType.fromDDL("episode string, start_frame int")
    (tmp_path / "a.csv").write_text("episode,start_frame\n000007,3\n")
    assert [tuple(r) for r in D.read_checked(spark, str(tmp_path / "a.csv"), schema).collect()] == [("000007", 3)]
    (tmp_path / "b.csv").write_text("start_frame,episode\n3,7\n")
    with pytest.raises(ValueError, match="columns differ"):
        D.read_checked(spark, str(tmp_path / "b.csv"), schema)
    (tmp_path / "c.csv").write_text("")
    with pytest.raises(ValueError, match="columns differ"):
        D.read_checked(spark, str(tmp_path / "c.csv"), schema)
    assert D.column_faults(["a", "b"], ["a", "c", "d"]) == [(1, "c", "b"), (2, "d", None)]


def test_only_a_torn_last_line_may_go(spark, tmp_path):
    schema, path = StructType.fromDDL("key string, n int"), tmp_path / "r.jsonl"
    path.write_bytes(b'{"key":"a","n":1}\n\n{"key":"b","n":2}\n{"key":"torn')
    rows, torn = D.read_jsonl_strict(spark, str(path), schema)
    assert torn and [r.key for r in rows.orderBy("at").collect()] == ["a", "b"]
    O.append_status(path, {"key": "c", "n": 3})
    with pytest.raises(ValueError, match="not JSON"):  # the torn line is no longer the last
        D.read_jsonl_strict(spark, str(path), schema)
    path.write_bytes(b'{"key":"a","n":1}\n')
    rows, torn = D.read_jsonl_strict(spark, str(path), schema)
    assert not torn and rows.count() == 1
    path.write_bytes(b"")
    rows, torn = D.read_jsonl_strict(spark, str(path), schema)
    assert not torn and rows.count() == 0


def test_layouts(spark, tmp_path):
    assert D.metadata_path(spark, str(tmp_path), train=False) is None
    with pytest.raises(FileNotFoundError):
        D.metadata_path(spark, str(tmp_path), train=True)
    line = {"file_name": "a.png", "prompt": "p", "metadata": {"video_source": "s", "video_index": 4, "gt_frame": 5, "cell_number": 2, "frame_indices": [4, 5]}}
    for split in ("train", "validation"):
        (tmp_path / split).mkdir()
        (tmp_path / split / "metadata.jsonl").write_text(json.dumps(line) + "\n")
        (tmp_path / split / "a.png").write_bytes(b"x" * 3)
    rows = D.tagged_metadata(spark, str(tmp_path), "contact").collect()
    assert sorted(r.split for r in rows) == ["train", "validation"] and {r.answer for r in rows} == {'{"points": [2]}'}
    assert {(r.split, r["size"]) for r in D.image_folder(spark, str(tmp_path)).collect()} == {("train", 3), ("validation", 3)}
    (tmp_path / "validation" / "a.png").unlink()
    with pytest.raises(ValueError, match="validation"):
        D.image_folder(spark, str(tmp_path))
    assert D.signal_path(spark, str(tmp_path), "v").endswith("metrics/v_hand_speed.json")
    (tmp_path / "v_speed.json").write_text("{}")
    assert D.signal_path(spark, str(tmp_path), "v") == f"{tmp_path}/v_speed.json"
    assert D.signal_path(spark, str(tmp_path), "v", hand="left") == f"{tmp_path}/v_speed_left.json"


def test_trainer_log(spark, tmp_path):
    for step in (5, 20):
        (tmp_path / f"checkpoint-{step}").mkdir()
        (tmp_path / f"checkpoint-{step}" / "trainer_state.json").write_text(json.dumps({"global_step": step, "log_history": [{"step": s, "epoch": s / 10, "loss": 1.0 / s} for s in range(5, step + 1, 5)] + [{"step": step, "eval_loss": 0.5}]}, indent=1))
    rows = D.trainer_log(spark, f"{tmp_path}/checkpoint-*/trainer_state.json")
    assert [(r.step, r.loss) for r in rows.orderBy("step").collect()] == [(5, 0.2), (10, 0.1), (15, 1 / 15), (20, 0.05)]
    assert S.curve(rows, "loss").count() == 4 and S.curve(rows, "eval_loss").count() == 0


def test_sinks(tmp_path):
    O.atomic_json(tmp_path / "x" / "a.json", {"b": 1, "a": [None, "é"]})
    assert (tmp_path / "x" / "a.json").read_text() == '{"a":[null,"é"],"b":1}\n' and [p.name for p in (tmp_path / "x").iterdir()] == ["a.json"]
    with pytest.raises(ValueError):
        O.atomic_json(tmp_path / "x" / "a.json", float("nan"))
    assert json.loads((tmp_path / "x" / "a.json").read_text())["b"] == 1
    assert O.predictions(tmp_path / "p.json") == [] and O.predictions(tmp_path / "p.json", [3]) == [3] and O.predictions(tmp_path / "p.json") == [3]
    O.append_status(tmp_path / "s.jsonl", {"z": 1, "a": 2})
    O.append_status(tmp_path / "s.jsonl", {"z": 2})
    assert (tmp_path / "s.jsonl").read_text() == '{"a":2,"z":1}\n{"z":2}\n'
    assert O.archive([tmp_path / "none"], tmp_path / "old") is None
    one = O.archive([tmp_path / "s.jsonl", tmp_path / "none"], tmp_path / "old", "t")
    (tmp_path / "s.jsonl").write_text("")
    two = O.archive([tmp_path / "s.jsonl"], tmp_path / "old", "t")
    assert one != two and (one / "s.jsonl").read_text() and not (tmp_path / "s.jsonl").exists()
    code = tmp_path / "code.py"
    code.write_text("pass")
    first = O.config_snapshot({"grid": 3}, [code])
    code.write_text("pass ")
    assert first["config_hash"] == O.content_hash(first, ("config_hash",)) != O.config_snapshot({"grid": 3}, [code])["config_hash"]


def test_sample_id(spark):
    df = spark.createDataFrame([("contact", "a.png", "say \"hi\"\n", 5, [1, 2], None)], "task string, file_name string, prompt string, video_index int, frame_indices array<int>, offset int")
    fields = {c: F.col(c) for c in ("file_name", "prompt", "video_index", "frame_indices", "offset")}
    got = df.select(O.sample_id(F.col("task"), F.lit("set"), fields)).first()[0]
    assert got == O.content_hash({"task": "contact", "dataset_name": "set", "file_name": "a.png", "prompt": 'say "hi"\n', "video_index": 5, "frame_indices": [1, 2], "offset": None})


class Flaky:
    name = "flaky"

    def __init__(self, fails: int, error: type[Exception] = TimeoutError):
        self.left, self.error = fails, error

    def generate(self, question: dict) -> str:
        if self.left:
            self.left -= 1
            raise self.error("try again later")
        return f"answer {question['id']}"


def test_retries():
    waits: list[float] = []
    assert W.Retrying(Flaky(2), 3, 0.5, sleep=waits.append).generate({"id": 1}) == "answer 1" and waits == [0.5, 1.0]
    with pytest.raises(TimeoutError):
        W.Retrying(Flaky(3), 3, 0.0, sleep=waits.append).generate({"id": 1})
    source = Flaky(1, KeyError)
    with pytest.raises(KeyError):
        W.Retrying(type("Plain", (), {"name": "x", "generate": lambda self, q: (_ for _ in ()).throw(KeyError("no such thing"))})(), 3, sleep=waits.append).generate({})
    assert W.passing(source.error("try again")) and not W.passing(ValueError("bad request"))
    over = type("Over", (Exception,), {"status_code": 503})
    assert W.passing(over()) and not W.passing(type("Gone", (Exception,), {"status_code": 404})())
    assert W.failure(over("key sk-1 is bad"), "sk-1") == {"type": "Over", "status_code": 503, "request_id": None, "message": "key [REDACTED] is bad"}


def test_starts_are_spaced():
    now, slept = [0.0], []
    spacing = W.StartSpacing(4, clock=lambda: now[0], sleep=slept.append)
    assert [spacing.wait() for _ in range(3)] == [0.0, 0.25, 0.5] and slept == [0.25, 0.5]
    now[0] = 10.0
    assert spacing.wait() == 10.0 and W.StartSpacing(0, clock=lambda: 1.0).wait() == 1.0
    with pytest.raises(ValueError):
        W.StartSpacing(-1)


def test_asking(spark):
    class Odd:
        name = "odd"

        def generate(self, question: dict) -> str:
            if question["id"] == 3:
                raise ValueError("secret is out")
            return W.DryAnswers().generate(question)

    df = spark.createDataFrame([(1, 5, None), (2, 5, "feedback"), (3, 0, None)], "id int, seed int, flag string")
    got = {r.id: r for r in W.ask(df, Odd, secret="secret").collect()}
    assert got[1].raw_response == '{"points": [6]}' and got[2].raw_response == "1" and got[1].attempts == 1 and got[1].error is None
    assert got[3].raw_response is None and got[3].error.type == "ValueError" and got[3].error.message == "[REDACTED] is out"


def test_content_and_choices(spark):
    rows = ['"a"', '[{"type":"text","text":"a"},{"text":{"value":"b"}},{"other":1},null,["c"]]', '{"content":[{"value":2.5}]}', "plain [x", None, "true"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string")
    assert [r[0] for r in df.orderBy("id").select(X.content_text("t")).collect()] == ["a", "abc", "2.5", "plain [x", "", "True"]
    assert X.choices(["pinch, speed", "pinch"], ("speed", "pinch")) == ["pinch", "speed"] and X.choices(None, (0, 1)) == [0, 1] and X.choices(["1"], (0, 1)) == [1]
    with pytest.raises(ValueError, match="unknown"):
        X.choices(["x"], ("speed",))


def test_walk_skips_invalid_frames(spark):
    df = spark.createDataFrame([([10, 11, 13], [10, 12], 40), ([0], [], 40), ([], [], 40), ([2], [], 5)], "candidates array<int>, invalid array<int>, num_frames int")
    got = [(r.grid, r.at) for r in C.walk_grid(df).collect()]
    assert got[0] == ([6, 7, 8, 9, 11, 13, 14, 15, 16], 4) and got[1] == (list(range(9)), 0) and got[2] == ([], 0) and got[3] == ([0, 1, 2, 3, 4], 2)


def test_smoothing_spline():
    x = np.array([0.0, 1, 2.5, 3, 4.5, 6])
    y = np.sin(x)
    assert np.allclose(N.smoothing_spline(x, y, x), y)
    at = np.linspace(0, 6, 50)
    straight = N.smoothing_spline(x, 2 * x + 1, at)
    assert np.allclose(straight, 2 * at + 1)
    r = np.random.default_rng(0)
    x = np.sort(r.uniform(0, 10, 60))
    y = np.cos(x) + r.normal(scale=0.2, size=60)
    for s in (0.5, 2.0):
        assert ((N.smoothing_spline(x, y, x, s) - y) ** 2).sum() == pytest.approx(s, rel=1e-3)
    # a dense solution of the same equations
    h = np.diff(x)
    q, k = np.zeros((60, 58)), np.zeros((58, 58))
    for i in range(58):
        q[i : i + 3, i] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        k[i, i] = (h[i] + h[i + 1]) / 3
        if i:
            k[i, i - 1] = k[i - 1, i] = h[i] / 6
    m = k + 0.3 * q.T @ q
    line = N.banded_solve([d[:, None] for d in (np.diag(m), np.append(np.diag(m, 1), 0), np.append(np.diag(m, 2), [0, 0]))], q.T @ y)[:, 0]
    assert np.allclose(line, np.linalg.solve(m, q.T @ y))
    grid = np.linspace(x[0], x[-1], 200)
    few, many = N.smoothing_spline(x, y, grid, 0.5), N.smoothing_spline(x, y, grid, 0.5, dense=0)  # both ways to the penalty
    assert np.allclose(few, many, atol=1e-4)


def test_registration(spark):
    r = np.random.default_rng(1)
    cloud = r.uniform(0, 1, (200, 3))
    turn = np.array([[np.cos(0.02), -np.sin(0.02), 0], [np.sin(0.02), np.cos(0.02), 0], [0, 0, 1]])
    moved = (cloud - 0.5) @ turn.T + 0.5 + 0.005
    t = N.align_points(moved, cloud, 0.05)
    assert np.allclose(moved @ t[:3, :3].T + t[:3, 3], cloud, atol=1e-6)
    who, far = N.Cells(cloud, 0.1).nearest(cloud[:50] + 0.01)
    dense = ((cloud[:50, None] + 0.01 - cloud[None]) ** 2).sum(2)
    assert (who == dense.argmin(1)).all() and np.allclose(far, dense.min(1))
    lists = lambda x: [[float(v) for v in p] for p in x]
    clouds = spark.createDataFrame([(1, 0, lists(cloud)), (1, 1, lists(moved)), (1, 2, []), (2, 0, []), (2, 1, lists(cloud))], "episode long, frame_idx int, points array<array<double>>")
    wrists = spark.createDataFrame([(1, 0, [0.1, 0.2, 0.3]), (1, 1, lists(moved)[7]), (1, 2, [0.0, 0.0, 0.0]), (2, 1, [0.0, 0.0, 0.0]), (1, 3, [0.0, 0.0, 0.0])], "episode long, frame_idx int, p array<double>")
    got = {(x.episode, x.frame_idx): x.p for x in N.registered(clouds, wrists, 0.05).collect()}
    assert got[(1, 0)] == [0.1, 0.2, 0.3] and np.allclose(got[(1, 1)], cloud[7], atol=1e-6) and set(got) == {(1, 0), (1, 1)}


def test_paired_bootstrap(spark):
    df = spark.createDataFrame([(1, i, float(i + 1), float(i)) for i in range(5)] + [(1, 9, None, 1.0), (1, 10, float("nan"), 1.0)], "scope int, episode int, a double, b double")
    got = B.paired_bootstrap(df, "scope", "a", "b", ["episode"], 7, 200).first()
    assert (got.difference, got.low, got.high, got.n) == (1.0, 1.0, 1.0, 5)


def test_store_lock(spark, tmp_path):
    one, two = (O.ResultStore(spark, f"{tmp_path}/store", "h") for _ in range(2))
    rows = spark.createDataFrame([("a", "success")], "key string, status string")
    with one.writing(), pytest.raises(O.StoreBusy):
        two.append(rows)
    assert two.append(rows) == 1 and one.append(rows) == 0
    (tmp_path / "store.lock").touch()  # of a writer that died
    with pytest.raises(O.StoreBusy):
        one.append(rows)
    assert O.ResultStore(spark, f"{tmp_path}/store", "h", stale=0.0).append(rows) == 0
    assert not (tmp_path / "store.lock").exists()


def test_reports(spark, tmp_path):
    """One file, fields in the order of the table, null as nothing in CSV and a dash in Markdown."""
    rows = spark.createDataFrame([("contact", 2, 0.5, None), ("separation", 1, None, "x")], "task string, n int, share double, note string").orderBy("task")
    O.write_report(rows, f"{tmp_path}/csv")
    (csv,) = (tmp_path / "csv").glob("*.csv")
    assert csv.read_text() == "task,n,share,note\ncontact,2,0.5,\nseparation,1,,x\n"
    O.write_report(rows, f"{tmp_path}/json", "json")
    (lines,) = (tmp_path / "json").glob("*.json")
    assert [json.loads(x) for x in lines.read_text().splitlines()] == [{"task": "contact", "n": 2, "share": 0.5}, {"task": "separation", "n": 1, "note": "x"}]
    assert O.markdown(rows) == "| task | n | share | note |\n|---|---|---|---|\n| contact | 2 | 0.5 | - |\n| separation | 1 | - | x |\n"


def test_regions_and_depths(spark):
    df = spark.createDataFrame([(f, n) for n in (1, 4, 5) for f in range(n)], "f int, n int")
    got = [(r.f, r.n, r.s, r.e) for r in df.select("f", "n", C.in_anchor_region(F.col("f"), F.col("n"), "start").alias("s"), C.in_anchor_region(F.col("f"), F.col("n"), "end").alias("e")).collect()]
    assert all(s == (f < n // 2) and e == (f >= n // 2) for f, n, s, e in got)
    depths = spark.createDataFrame([(0.0,), (5.0,), (5.1,), (-1.0,), (float("nan"),), (None,), (0.1,)], "z double")
    assert [r.z for r in depths.where(S.plausible_depth()).collect()] == [5.0, 0.1]
