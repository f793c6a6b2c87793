"""The waiting stream over several batches, with its marker and a restart."""

from __future__ import annotations

import random

import pytest

from tidemark.streaming.waiting import InputsMissing, run_when_whole, signal_files

SIGNALS = "episode string, signal string, frame_idx int, num_frames int, value double"


def rows(episode, signal, at, n, value=1.0):
    return [(episode, signal, i, n, value) for i in at]


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "signals").mkdir()
    (tmp_path / "marker").mkdir()

    class Place:
        ready, late, calls = [], [], 0

        def send(self, *parts):
            spark.createDataFrame([r for p in parts for r in p], SIGNALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "signals"))

        def mark(self):
            spark.createDataFrame([(1,)], "done int").write.mode("append").parquet(str(tmp_path / "marker"))

        def run(self, keep=True):
            def evaluate(df):
                self.calls += 1
                self.ready += sorted((r.episode, r.num_frames) for r in df.collect())

            failed = (lambda df: self.late.extend(sorted((r.episode, r.lacks) for r in df.collect()))) if keep else None
            q = run_when_whole(signal_files(spark, str(tmp_path / "signals"), SIGNALS), evaluate, str(tmp_path / "checkpoint"), signal_files(spark, str(tmp_path / "marker"), "done int"), failed=failed)
            q.awaitTermination(90)

    return Place()


def test_three_batches_marker_and_restart(place):
    place.ready, place.late = [], []
    place.send(rows("a", "speed", range(5), 5), rows("b", "speed", range(3), 3), rows("c", "pinch", range(2), 4), [("d", "speed", 0, 2, float("nan")), ("d", "pinch", 0, 2, 1.0), (None, "speed", 0, 1, 1.0), ("a", "other", 0, 5, 1.0)])
    place.run()
    assert place.ready == []
    place.send(rows("a", "pinch", range(4, -1, -1), 5), rows("b", "pinch", [0, 2], 3), rows("d", "pinch", [1], 2))
    place.run()
    assert place.ready == [("a", 5)]
    place.send(rows("b", "pinch", [1, 1, 7], 3), rows("a", "speed", range(5), 5), rows("d", "speed", [0], 2))
    place.run()
    assert place.ready == [("a", 5), ("b", 3)]
    place.run()  # nothing new
    assert place.calls == 2 and place.late == []
    place.send(rows("d", "speed", [1], 2, None))
    place.mark()
    place.run()
    assert place.ready == [("a", 5), ("b", 3)]
    assert place.late == [("c", "speed: 4 of 4 frames, pinch: 2 of 4 frames"), ("d", "speed: 1 of 2 frames")]
    place.send(rows("d", "speed", [1], 2), rows("e", "speed", [0], 1))  # too late
    place.run()
    assert len(place.ready) == 2 and len(place.late) == 2


def test_missing_inputs_end_the_query(place):
    place.send(rows("a", "speed", range(2), 2))
    place.mark()
    with pytest.raises(Exception, match="a lacks pinch: 2 of 2 frames") as e:
        place.run(keep=False)
    assert InputsMissing.__name__ in str(e.value)


def test_many_episodes_share_few_states_and_grow(spark, tmp_path):
    """700 episodes of 1 to 40 frames over three files, their lengths first told too small; against counting."""
    draw = random.Random(5)
    n = {e: draw.randint(1, 40) for e in range(700)}
    sent = [(e, signal, i, n[e] if i % 3 == 0 else draw.randint(i + 1, n[e]), draw.choice([1.0, 1.0, 1.0, None]) if e % 4 == 0 else 2.0) for e in n for signal in ("speed", "pinch") for i in range(n[e])]
    draw.shuffle(sent)
    sent += [(e, "speed", 0, n[e], 0.0) for e in n]
    (tmp_path / "marker").mkdir()
    for i in range(3):
        spark.createDataFrame(sent[i::3], SIGNALS.replace("episode string", "episode long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "signals"))
    got = []
    keep = lambda status: lambda df: got.extend((r.episode, status, r.num_frames, r.lacks if status == "failed" else "") for r in df.collect())
    for last in (False, True):
        if last:
            spark.createDataFrame([(1,)], "done int").write.mode("append").parquet(str(tmp_path / "marker"))
        q = run_when_whole(signal_files(spark, str(tmp_path / "signals"), SIGNALS.replace("episode string", "episode long"), 1), keep("ready"), str(tmp_path / "checkpoint"), signal_files(spark, str(tmp_path / "marker"), "done int"), failed=keep("failed"), groups=8)
        q.awaitTermination(90)
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    valid = {(e, signal, i) for e, signal, i, _, v in sent if v is not None}
    for e, status, frames, lacks in got:
        lack = {s: sum((e, s, i) not in valid for i in range(n[e])) for s in ("speed", "pinch")}
        assert (status, frames, lacks) == ("failed" if any(lack.values()) else "ready", n[e], ", ".join(f"{s}: {m} of {n[e]} frames" for s, m in lack.items() if m))
    assert sorted(e for e, *_ in got) == sorted(n)
