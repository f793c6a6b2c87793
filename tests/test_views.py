"""Lines over splits and files, kept views, roll-ups by batch, and starts spaced over tasks."""

from __future__ import annotations

import json
import random
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.operators import rollups as U
from tidemark.sources import answers as W
from tidemark.sources import lines as N
from tidemark.sources import views as V

SCHEMA = StructType([StructField("key", StringType()), StructField("n", IntegerType())])


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_lines_over_splits_and_files(spark, tmp_path, small_splits):
    r = random.Random(1)
    want, offsets = {}, {}
    for f in range(3):
        data = b""
        for i in range(200):
            offsets[f"f{f}.jsonl", len(data)] = i
            row = {"key": f"k{r.randrange(40)}", "n": f * 1000 + i}
            want[row["key"]] = row["n"]  # the last one of all wins
            data += json.dumps(row).encode() + (b"\r\n" if f == 1 else b"\n") + (b"\n" if i % 50 == 7 else b"")
        (tmp_path / f"f{f}.jsonl").write_bytes(data + (b'{"key":"torn' if f == 2 else b""))
    lines = N.read_lines(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 12
    rows, torn = N.strict_rows(spark, SCHEMA, str(tmp_path))
    assert [Path(t).name for t in torn] == ["f2.jsonl"] and rows.count() == 600
    assert {x.key: x.n for x in N.latest(rows, "key").collect()} == want
    assert [x.n for x in rows.orderBy(*N.PLACE).collect()] == [f * 1000 + i for f in range(3) for i in range(200)]
    placed = N.offsets(lines)
    got = {(Path(x.file).name, x.offset): x.value for x in placed.where("value <> '' and not value like '%torn'").collect()}
    assert {k: json.loads(v)["n"] % 1000 for k, v in got.items()} == offsets
    (tmp_path / "f0.jsonl").write_bytes(b'{"key":"a","n":1}\nbad line\n{"key":"b","n":2}\n')
    with pytest.raises(N.NotJson, match="bad line"):
        N.strict_rows(spark, SCHEMA, str(tmp_path))


def view(v):
    return {r.key: (r.at, r.value) for r in v.read().collect()}


def test_latest_view(spark, tmp_path):
    v = V.LatestView(spark, str(tmp_path / "view"), "key", "at", buckets=8)
    batch = lambda *rows: spark.createDataFrame(rows, "key string, at int, value string")
    r = random.Random(2)
    want: dict = {}
    for k in range(3):
        rows = [(f"k{r.randrange(30)}", r.randrange(1000), f"{k}-{i}") for i in range(60)]
        rows = list({(a, b): (a, b, c) for a, b, c in rows}.values())
        for key, at, value in rows:
            if key not in want or at > want[key][0]:
                want[key] = (at, value)
        assert len(v.apply(batch(*rows))) > 4
        assert view(v) == want
    files = lambda: set((tmp_path / "view" / "rows").rglob("*.parquet"))
    before = files()
    assert len(v.apply(batch(("k1", 5000, "new"), ("k1", 4000, "older")))) == 1
    assert view(v) == want | {"k1": (5000, "new")}
    after = files()
    new = {p.parent for p in after - before}  # one bucket is written anew, the files of the others stay
    assert len(new) == 1 and {p for p in before if p.parent not in new} == before & after
    v.apply(batch(("k1", 5000, "replayed"), ("k2", -1, "old")))  # equal and older records change nothing
    assert view(v)["k1"] == (5000, "new") and view(v)["k2"] == want["k2"]
    assert v.apply(batch()) == []


def test_a_broken_rewrite_is_finished(spark, tmp_path, monkeypatch):
    v = V.LatestView(spark, str(tmp_path / "view"), "key", "at", buckets=2)
    batch = lambda *rows: spark.createDataFrame(rows, "key string, at int, value string")
    v.apply(batch(("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")))
    monkeypatch.setattr(v, "_swap", lambda staged: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        v.apply(batch(("a", 2, "y")))
    again = V.LatestView(spark, str(tmp_path / "view"), "key", "at", buckets=2)
    assert view(again) == {"a": (2, "y"), "b": (1, "x"), "c": (1, "x")}
    assert not (tmp_path / "view" / "pending").exists()


def test_rollups(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice(["contact", "separation"]), r.choice(["speed", "pinch"]), None if r.random() < 0.1 else float(r.randrange(9)), r.randrange(4) / 4, r.random() < 0.5) for _ in range(400)]
    rows += [("contact", "empty", None, None, None)]
    schema = "task string, mode string, error double, normalized double, recall boolean"
    whole = spark.createDataFrame(rows, schema)
    u = V.Rollups(spark, str(tmp_path / "partials"), ("task", "mode"), ("error", "normalized", "recall"))
    for i in range(0, len(rows), 100):
        u.add(i // 100, spark.createDataFrame(rows[i : i + 100], schema))
    u.add(1, spark.createDataFrame(rows[100:200], schema))  # a batch that comes again
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(whole.groupBy("task", "mode").agg(*U.metrics()), u.merged().groupBy("task", "mode").agg(*V.counted_metrics()))
    sets = [("task", "mode"), ("mode",), ()]
    want = U.grouping_sets(whole, sets, ("task", "mode"), U.metrics())
    assert same(want, U.grouping_sets(u.merged(), sets, ("task", "mode"), V.counted_metrics()))
    u.compact(0, [0, 1, 2])
    assert same(want, U.grouping_sets(u.merged(), sets, ("task", "mode"), V.counted_metrics()))


def test_slots_of_lanes_never_meet():
    r = random.Random(4)
    starts = []
    for lane in range(4):
        now = [r.uniform(100, 130)]  # lanes begin at any time, one long after the others
        s = W.SlotSpacing(10, lane, 4, clock=lambda now=now: now[0], sleep=lambda t, now=now: now.__setitem__(0, now[0] + t))
        for _ in range(200):
            starts.append(s.wait())
            now[0] += r.choice([0, 0.01, 1.3])  # how long an answer takes
    starts.sort()
    assert min(b - a for a, b in zip(starts, starts[1:], strict=False)) >= 0.1 - 1e-6
    assert W.SlotSpacing(0, 0, 1, clock=lambda: 7.0).wait() == 7.0
    with pytest.raises(ValueError):
        W.SlotSpacing(1, 3, 3)


class Noting:
    name = "noting"

    def generate(self, question):
        return repr(time.time())


def test_starts_over_tasks(spark):
    """Twenty requests over four tasks that run at once, ten a second: all starts are a gap apart."""
    got = W.ask(spark.range(20).select(F.col("id"), F.lit(None).cast("string").alias("flag")), Noting, per_second=10, lanes=4).toPandas()
    starts = pd.Series(sorted(float(x) for x in got["raw_response"]))
    assert len(starts) == 20 and starts.diff().min() > 0.08
