"""Feedback rounds and the long loop on answers written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import feedback as B


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(e, i, n, 0.0 if i == hot else 1e9) for e, n, hot in (("a", 30, 12), ("b", 1, 9), ("c", 4, 2), ("d", 20, 1)) for i in range(n)], "episode string, frame_idx int, num_frames int, speed double")


def ask(spark, *rows):
    return spark.createDataFrame(rows, "pick string, stage string, round int, text string")


def picks(spark, *rows):
    return spark.createDataFrame(rows, "pick string, episode string, num_frames int, frame_idx int")


def found(df):
    return {r.pick: (r.success, r.frame_idx, r.rounds) for r in df.collect()}


def test_rounds(spark, frames):
    p = picks(spark, ("yes", "a", 30, 10), ("drawn", "a", 30, 10), ("cell", "a", 30, 10), ("clamp", "a", 30, 10), ("alone", "b", 1, 0), ("second", "a", 30, 10), ("edge", "a", 30, 29))
    answers = ask(
        spark, ("yes", "verify", 0, " 1 "), ("drawn", "select", 0, "-1"), ("drawn", "verify", 1, "1"), ("cell", "select", 0, "2"), ("cell", "verify", 1, "1"), ("clamp", "select", 0, "99"), ("clamp", "verify", 1, "1"),
        ("second", "select", 0, "no idea"), ("second", "verify", 0, "0"), ("second", "verify", 1, "1"), ("edge", "select", 0, "9"), ("edge", "verify", 1, "1"),
    )
    got = found(B.feedback_rounds(p, frames, answers, 3))
    # the one slow frame, 12, is drawn; its window is 8 to 16
    assert got["yes"] == (True, 10, 1) and got["drawn"] == (True, 12, 2) and got["second"] == (True, 12, 2)
    assert got["cell"] == (True, 9, 2) and got["clamp"] == (True, 16, 2)
    assert got["alone"] == (False, 0, 1) and got["edge"] == (True, 29, 2)
    assert found(B.feedback_rounds(p, frames, answers, 0)) == {r.pick: (False, r.frame_idx, 0) for r in p.collect()}
    assert B.feedback_rounds(p.limit(0), frames, answers, 3).count() == 0


def test_tried_frames_never_come_again(spark, frames):
    """Four frames, none ever accepted: each is tried once, then none is left."""
    got = found(B.feedback_rounds(picks(spark, ("x", "c", 4, 2)), frames, ask(spark), 9))
    assert got["x"][0] is False and got["x"][2] == 4
    got = found(B.feedback_rounds(picks(spark, ("x", "c", 4, 2)), frames, ask(spark), 2))
    assert got["x"][0] is True and got["x"][2] == 2  # the last choice stands


def test_draws_follow_the_speeds(spark):
    rows = spark.range(4000).withColumn("f", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("speed", F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), F.col("f") + 1))
    drawn = rows.groupBy("id").agg(F.min_by("f", B.exponential_key("speed", F.col("id"), F.col("f"))).alias("f")).groupBy("f").count().collect()
    share = {r.f: r["count"] / 4000 for r in drawn}
    assert all(abs(share[f] - w / 7) < 0.03 for f, w in ((0, 4), (1, 2), (2, 1)))


def test_long_loop(spark, frames):
    minima = spark.createDataFrame([("a", 12, 0.0), ("a", 25, 5.0), ("a", 3, 1e12), ("d", 1, 1.0), ("d", 9, 1.0)], "episode string, frame_idx int, speed double")
    answers = ask(
        spark, ("a|12", "state", 0, "Contact"), ("a|12", "pick", 0, "5"), ("a|12", "verify", 0, "1"), ("a|25", "state", 0, "Neither"), ("a|25", "pick", 0, "5"), ("a|3", "state", 0, "Separation"), ("a|3", "pick", 0, "-1"),
        ("d|1", "state", 0, "Separation"), ("d|1", "pick", 0, "0"), ("d|9", "state", 0, "Contact"),
    )
    got = [tuple(r) for r in B.long_loop(minima, frames, answers, rounds=1).orderBy("episode").collect()]
    assert [(e, m, v) for e, _, m, v, _ in got] == [("a", 12, "Contact"), ("d", 1, "Separation")]
    assert got[0][1] == 1 and got[0][4] == 12  # slowest first; key frame 12, cell 5 of 8 to 16
    bare = {(r.episode, r.minimum): r.frame_idx for r in B.long_loop(minima, frames, answers, rounds=0).collect()}
    assert bare == {("a", 12): 12, ("d", 1): 0}
