"""Rounds of feedback until a frame is accepted, over a table of answers, and the loop over a long clip's minima.

answers(pick, stage, round, text) is what a model said; a round reads its own answers only. Each round is one stored
table of the picks that are still open, so lineage stays short, a lost executor costs one round and the work shrinks
with the frontier; the loop ends when none is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators.statistics import derived_seed
from tidemark.sources.stages import discard, stored

E = F.expr
UNKNOWN = 9999.0  # stands for a missing speed


def exponential_key(speed: str, *parts: Column) -> Column:
    """The least of these keys over a group draws a row with probability by inverse speed; ascending, they order it as draws without replacement do. The uniform number is a hash of the parts."""
    known = F.when(F.col(speed).isNull() | F.isnan(speed), UNKNOWN).otherwise(F.col(speed))
    return -F.log((derived_seed(*parts) + 0.5) / float(1 << 32)) * (known + 1e-8)


def weighted_draw(rows: DataFrame, by: str, speed: str, seed: int) -> DataFrame:
    """by and the frame_idx of one row of each group, drawn with probability by inverse speed."""
    key = F.struct(exponential_key(speed, F.lit(seed), F.col(by), F.col("frame_idx")).alias("key"), "frame_idx")
    return rows.groupBy(by).agg(F.min(key)["frame_idx"].alias("frame_idx"))


def said(answers: DataFrame, stage: str, round_: int, name: str) -> DataFrame:
    """pick and its text at a stage and round; of repeated answers the smallest text."""
    return answers.where((F.col("stage") == stage) & (F.col("round") == round_)).groupBy("pick").agg(F.min("text").alias(name))


def cell(text: str) -> Column:
    """The number that an answer names; null if it names none."""
    return F.expr(f"try_cast(trim({text}) as int)")


def in_window(center: Column, number: Column, total: Column, cells: int) -> Column:
    """The frame in cell `number` (from 1, clamped) of the window of `cells` frames around a centre."""
    last = F.least(F.lit(cells), total) - 1
    return (C.window_start(center, total, cells) + F.greatest(F.lit(0), F.least(number - 1, last))).cast("int")


def feedback_rounds(picks: DataFrame, frames: DataFrame, answers: DataFrame, rounds: int, seed: int = 0, reach: int = 3, cells: int = C.CELLS) -> DataFrame:
    """pick, success, frame_idx, rounds (that were asked) of picks(pick, episode, num_frames, frame_idx).

    Round r from 0: the answer `1` at stage verify accepts the frame. Otherwise a frame within reach that has not been
    tried is drawn by inverse speed (none left: failure), and the cell named at stage select, of the window around the
    drawn frame, is the next; an answer that is missing, 0, -1 or no number leaves the drawn frame. After the last round
    its choice stands unverified, as a success. Without rounds every pick fails as it is.
    """
    now = stored(picks.select("pick", "episode", F.col("num_frames").cast("int"), F.col("frame_idx").cast("int"), E("cast(array() as array<int>)").alias("tried"), F.lit("open").alias("status"), F.lit(0).alias("rounds")), "picks")
    near = stored(frames.join(now.select("episode").distinct(), "episode", "left_semi").select("episode", F.col("frame_idx").alias("f"), "speed"), "speeds")
    parts, number = [now.where(F.lit(rounds == 0))], F.col("number")
    for r in range(rounds):
        rows = now.where("status = 'open'").join(said(answers, "verify", r, "verdict"), "pick", "left").join(said(answers, "select", r, "choice"), "pick", "left")
        rows = rows.withColumn("tried", F.array_append("tried", F.col("frame_idx"))).withColumn("yes", F.coalesce(F.trim("verdict") == "1", F.lit(False)))
        left = E(f"filter(sequence(frame_idx - {reach}, frame_idx + {reach}), f -> f >= 0 and f < num_frames and not array_contains(tried, f))")
        rows = rows.withColumn("f", F.explode_outer(F.when(~F.col("yes"), left))).join(near, ["episode", "f"], "left")
        key = F.when(F.col("f").isNotNull(), F.struct(exponential_key("speed", F.lit(seed), F.col("pick"), F.lit(r), F.col("f")).alias("key"), "f"))
        kept = [F.first(c).alias(c) for c in ("episode", "num_frames", "frame_idx", "tried", "yes", "choice")]
        rows = rows.groupBy("pick").agg(*kept, F.min(key)["f"].alias("drawn")).withColumn("number", cell("choice"))
        chosen = F.when(number.isNull() | number.isin(0, -1), F.col("drawn")).otherwise(in_window(F.col("drawn"), number, F.col("num_frames"), cells))
        status = F.when(F.col("yes"), "accepted").when(F.col("drawn").isNull(), "failed").otherwise("open" if r < rounds - 1 else "accepted")
        then = stored(rows.select("pick", "episode", "num_frames", F.when(F.col("drawn").isNull(), F.col("frame_idx")).otherwise(chosen).alias("frame_idx"), "tried", status.alias("status"), F.lit(r + 1).alias("rounds")), "round")
        parts.append(then.where("status <> 'open'"))
        now = then
        if now.where("status = 'open'").isEmpty():
            break
    discard(near)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("pick", (F.col("status") == "accepted").alias("success"), "frame_idx", "rounds")


def long_loop(minima: DataFrame, frames: DataFrame, answers: DataFrame, rounds: int = 1, seed: int = 0, reach: int = 2, cells: int = C.CELLS) -> DataFrame:
    """episode, turn, minimum, event, frame_idx: events of long clips, in the order in which their minima are drawn.

    minima(episode, frame_idx, speed). Minima are drawn by inverse speed without replacement; the key frame of each is
    drawn among the frames up to `reach` places from it. Its answers go by pick `episode|minimum`: stage state names the
    event (Contact or Separation, else it is dropped), stage pick a cell of the window around the key frame (none or -1:
    dropped), then feedback_rounds decides; rounds=0 leaves the feedback out.
    """
    pick = F.concat_ws("|", F.col("episode").cast("string"), F.col("minimum").cast("string"))
    points = minima.select("episode", "frame_idx", F.col("speed").alias("minimum_speed"))
    totals = frames.select("episode", "num_frames").distinct()
    near = C.around_minima(frames, points, reach).withColumn("pick", pick).withColumn("key", F.struct(exponential_key("speed", F.lit(seed), F.lit("key"), F.col("pick"), F.col("frame_idx")).alias("k"), "frame_idx"))
    keyed = near.groupBy("episode", "minimum", "pick").agg(F.min("key")["frame_idx"].alias("key_frame"))
    rows = keyed.join(points.withColumnRenamed("frame_idx", "minimum"), ["episode", "minimum"]).join(totals, "episode")
    rows = rows.withColumn("order", exponential_key("minimum_speed", F.lit(seed), F.lit("turn"), F.col("pick")))
    rows = rows.join(said(answers, "state", 0, "event"), "pick", "left").join(said(answers, "pick", 0, "choice"), "pick", "left").withColumn("number", cell("choice"))
    turn = F.row_number().over(C.Window.partitionBy("episode").orderBy("order", "minimum"))
    rows = rows.withColumn("turn", turn).where(F.col("event").isin("Contact", "Separation") & F.col("number").isNotNull() & (F.col("number") != -1))
    rows = rows.select("pick", "episode", "num_frames", "turn", "minimum", "event", in_window(F.col("key_frame"), F.col("number"), F.col("num_frames"), cells).alias("frame_idx"))
    if not rounds:
        return rows.select("episode", "turn", "minimum", "event", "frame_idx")
    rows = stored(rows, "events")
    found = feedback_rounds(rows, frames, answers, rounds, seed, cells=cells).where("success").select("pick", "frame_idx")
    return rows.drop("frame_idx").join(found, "pick").select("episode", "turn", "minimum", "event", "frame_idx")
