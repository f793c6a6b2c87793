"""Waiting for inputs: a stateful stream that lets an episode go once all its signals are whole and valid.

Signals come as rows of frames in any order, over any number of batches and more than once. The state of an episode is
a bitmap of valid frames for each required signal, so it follows the episode's length and holds no values; a frame is
valid once a finite value of it has come, whatever else comes before or after. When the bitmaps are full the episode
goes, once. Episodes are dealt into groups by hash, and a group's bitmaps are one state: a call from Spark into Python
costs milliseconds, so a call takes a group's rows of a batch at once.

The ready marker says that no more will come. It is a row of a stream of its own and moves the watermark, which is the
same for all tasks, past the time at which every waiting episode times out: what is not whole by then goes as failed,
with what it lacks; signals after the marker are late and dropped. State, watermark and read files are in the
checkpoint, so a restart repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

READY, FAILED = "ready", "failed"
# The clock has three hands: signals come before the time-out, the marker over a day after it (the delay keeps signals ahead of the watermark).
BEFORE, DUE, AFTER = "1971-01-01", 946_684_800_000, "2100-01-01"
_STATE = "episodes array<{}>, num_frames array<int>, done array<boolean>, seen binary"
_OUT = "episode {}, status string, num_frames int, lacks string"


class _Group:
    """The episodes of one group: a bitmap for each open episode and signal, one after the other in seen."""

    def __init__(self, width: int, episodes=(), num_frames=(), done=(), seen: bytes = b""):
        self.width, self.episodes, self.seen = width, list(episodes), np.frombuffer(seen, np.uint8).copy()
        self.index = {e: i for i, e in enumerate(self.episodes)}
        self.n, self.done = np.array(num_frames, np.int64), np.array(done, bool)

    def begins(self) -> np.ndarray:
        """Where each bitmap begins, and the end of the last."""
        return np.append(0, np.cumsum(np.repeat(np.where(self.done, 0, -(-self.n // 8)), self.width)))

    def _move(self, n: np.ndarray, done: np.ndarray) -> None:
        old, held, known = self.begins(), self.seen, self.done
        self.n, self.done = n, done
        new = self.begins()
        self.seen = np.zeros(new[-1], np.uint8)
        for i in np.flatnonzero(~np.repeat(done[: len(known)] | known, self.width)).tolist():
            self.seen[new[i] : new[i] + old[i + 1] - old[i]] = held[old[i] : old[i + 1]]

    def add(self, episode: pd.Series, spot: np.ndarray, num_frames: np.ndarray) -> None:
        code, names = pd.factorize(episode)
        at = np.array([self.index.setdefault(e, len(self.index)) for e in names.tolist()], np.int64)[code]
        self.episodes = list(self.index)
        more = len(self.index) - len(self.n)
        n, done = np.append(self.n, np.zeros(more, np.int64)), np.append(self.done, np.zeros(more, bool))
        np.maximum.at(n, at, np.where(done[at], 0, num_frames))
        if more or (n > self.n).any():
            self._move(n, done)
        frame, signal = spot // self.width, spot % self.width
        good = (frame >= 0) & (frame < n[at]) & ~done[at]
        at, frame, signal = at[good], frame[good], signal[good]
        np.bitwise_or.at(self.seen, self.begins()[at * self.width + signal] + (frame >> 3), (128 >> (frame & 7)).astype(np.uint8))

    def missing(self) -> np.ndarray:
        """Frames that lack, by episode and signal."""
        bits = np.append(0, np.cumsum(np.bitwise_count(self.seen), dtype=np.int64))[self.begins()]
        return self.n[:, None] - np.diff(bits).reshape(len(self.n), self.width)

    def close(self, which: np.ndarray) -> None:
        done = self.done.copy()
        done[which] = True
        self._move(self.n, done)

    def state(self) -> tuple:
        return self.episodes, self.n.tolist(), self.done.tolist(), self.seen.tobytes()


def whole_episodes(signals: DataFrame, marker: DataFrame | None = None, required: tuple[str, ...] = ("speed", "pinch"), groups: int = 256) -> DataFrame:
    """episode, status (ready or failed), num_frames, lacks of each episode of the stream signals, once.

    signals(episode, signal, frame_idx, num_frames, value): frames count from 0; rows with a null episode, another
    signal, or a frame outside the episode are left out; null and non-finite values are not valid; where rows disagree
    on num_frames, the largest holds. An episode of no frames is whole. marker: a stream whose first row ends the wait. groups: states
    that the episodes are dealt into, which should grow with them (hundreds of episodes in each); a checkpoint goes on
    only with the number that it began with.
    """
    kind, width = dict(signals.dtypes)["episode"], len(required)
    signals = signals.where(F.col("episode").isNotNull() & F.col("signal").isin(*required))
    value, frame = F.col("value").cast("double"), F.col("frame_idx").cast("long")
    valid = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & frame.between(0, (1 << 31) - 1)
    # a row's place among the frames of all signals, -1 if its value is not valid
    spot = F.when(valid, frame * width + F.array_position(F.array(*(F.lit(name) for name in required)), F.col("signal")) - 1).otherwise(-1)
    rows = signals.select(F.pmod(F.xxhash64("episode"), F.lit(groups)).alias("group"), "episode", spot.cast("long").alias("spot"), F.coalesce(F.col("num_frames").cast("long"), F.lit(0)).alias("num_frames"), F.lit(BEFORE).cast("timestamp").alias("at"))
    if marker is not None:
        rows = rows.unionAll(marker.select(F.lit(None).cast("long"), F.lit(None).cast(kind), F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(AFTER).cast("timestamp")))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # the marker
            for _ in parts:
                pass
            return
        group = _Group(width, *(state.get if state.exists else ()))
        if not state.hasTimedOut:
            for pdf in parts:
                group.add(pdf["episode"], pdf["spot"].to_numpy(), pdf["num_frames"].to_numpy())
        missing = group.missing()
        gone = np.flatnonzero(~group.done & (state.hasTimedOut | ~missing.any(axis=1)))
        group.close(gone)
        state.update(group.state())
        if not group.done.all():
            state.setTimeoutTimestamp(DUE)
        if len(gone):
            lacks = [", ".join(f"{name}: {m} of {n} frames" for name, m in zip(required, ms, strict=True) if m) for n, ms in zip(group.n[gone].tolist(), missing[gone].tolist(), strict=True)]
            yield pd.DataFrame({"episode": [group.episodes[i] for i in gone], "status": FAILED if state.hasTimedOut else READY, "num_frames": group.n[gone], "lacks": lacks})

    return rows.withWatermark("at", "1 day").groupBy("group").applyInPandasWithState(step, _OUT.format(kind), _STATE.format(kind), "append", GroupStateTimeout.EventTimeTimeout)


class InputsMissing(RuntimeError):
    """Preparation is marked complete, but episodes lack inputs."""


def run_when_whole(
    signals: DataFrame, evaluate: Callable[[DataFrame], None], checkpoint: str, marker: DataFrame | None = None, required: tuple[str, ...] = ("speed", "pinch"),
    failed: Callable[[DataFrame], None] | None = None, poll: str | None = None, groups: int = 256,
) -> StreamingQuery:
    """A query that gives each batch's ready episodes to evaluate, which should add nothing when a batch comes again.

    failed takes those that the marker found incomplete; without it they end the query as InputsMissing. poll: look for
    new files this often; else take what is there and end. groups: see whole_episodes.
    """

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        try:
            ready, late = df.where(F.col("status") == READY), df.where(F.col("status") == FAILED)
            if not ready.isEmpty():
                evaluate(ready.select("episode", "num_frames"))
            if not late.isEmpty():
                if failed is None:
                    raise InputsMissing("; ".join(f"{r['episode']} lacks {r['lacks']}" for r in late.orderBy("episode").limit(5).collect()))
                failed(late.select("episode", "num_frames", "lacks"))
        finally:
            df.unpersist()

    writer = whole_episodes(signals, marker, required, groups).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def signal_files(spark: SparkSession, path: str, schema: str, each: int | None = None) -> DataFrame:
    """A stream of the Parquet files that come to path, at most `each` a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", each) if each else reader).parquet(path)
