"""The tensor source: rows, pruning by frame and file, invalid tensors, metres."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals as S
from tidemark.sources.tensors import register


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    register(spark)
    at = tmp_path_factory.mktemp("tensors")
    r = np.random.default_rng(1)
    data = {"a": r.random((9, 2, 3)), "b": r.random((5, 2, 3)).astype(np.float32)}
    np.save(at / "a.npy", data["a"])
    np.savez(at / "b.npz", depths=data["b"])
    np.savez_compressed(at / "c.npz", depths=data["b"])
    np.savez(at / "d.npz", **{f"frame_{i:03d}": data["a"][i] for i in range(9)})
    return at, data


def load(spark, path, **options):
    return spark.read.format("tidemark_tensors").options(path=str(path), **options).load()


def test_rows(spark, place):
    at, data = place
    for name, key in (("a.npy", "a"), ("b.npz", "b"), ("c.npz", "b"), ("d.npz", "a")):
        got = sorted((r.frame, tuple(r.shape), tuple(r["values"])) for r in load(spark, at / name, framesPerPartition=2).collect())
        assert got == [(i, (2, 3), tuple(x.astype(float).ravel())) for i, x in enumerate(data[key])], name
    assert load(spark, at).groupBy("file").count().count() == 4
    assert load(spark, at / "a.npy", framesPerPartition=2).rdd.getNumPartitions() == 5


def test_pruning_opens_only_what_is_asked(spark, place, tmp_path):
    at, data = place
    raw = bytearray((at / "d.npz").read_bytes())
    for i in (0, 1, 2, 7, 8):  # spoil the data of these members: their check sums fail when they are read
        spot = raw.find(data["a"][i].tobytes())
        raw[spot] ^= 255
    (tmp_path / "spoiled.npz").write_bytes(bytes(raw))
    df = load(spark, tmp_path / "spoiled.npz")
    with pytest.raises(Exception, match="CRC|zip"):
        df.collect()
    for f in ("frame between 3 and 6", "frame > 2 and frame < 7", "frame in (3, 4, 5, 6) and frame >= 3"):
        assert sorted(r.frame for r in df.where(f).collect()) == [3, 4, 5, 6]
    assert [r.frame for r in df.where("frame = 4 and size(shape) = 2").collect()] == [4]
    assert df.where("frame > 100").count() == 0
    other = load(spark, f"{at}/a.npy,{tmp_path}/spoiled.npz")
    assert other.where(F.col("file") == f"{at}/a.npy").count() == 9


def test_depths(spark, tmp_path):
    register(spark)
    inv = np.full((4, 2, 2), 1.0)
    inv[0] = [[1, 2], [3, 4]]
    inv[2] = np.nan
    inv[3, 0, 0] = np.inf
    np.save(tmp_path / "inv.npy", inv)
    rows = S.invalid_tensor(load(spark, tmp_path).withColumn("inv", F.col("values")))
    assert {r.frame: r.invalid for r in rows.collect()} == {0: False, 1: True, 2: True, 3: True}
    (first,) = S.invert_depth(load(spark, tmp_path).where("frame = 0").withColumn("inv", F.col("values"))).collect()
    assert np.allclose(first.metres, 3.0 / (np.array([1, 2, 3, 4]) + 1e-6))


def test_errors(spark, place, tmp_path):
    np.save(tmp_path / "o.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="plain numbers"):
        load(spark, tmp_path / "o.npy").collect()
    with pytest.raises(Exception, match="no member"):
        load(spark, place[0] / "b.npz", member="other").collect()
    assert load(spark, tmp_path / "none*.npz").count() == 0
