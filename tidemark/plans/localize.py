"""The closed loop on a deterministic answer source: initial choice, state gate, speed gate, one resample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators.statistics import derived_seed

E = F.expr

# Own wording of the two questions; any template with {action} can be given instead.
PROMPTS = {
    "start": "Nine frames in order, each with a number. Which one first shows a firm grasp for: {action}? Use -1 if none does. End with JSON: {\"points\": []}",
    "end": "Nine frames in order, each with a number. Which one first shows the object let go after: {action}? Use -1 if none does. End with JSON: {\"points\": []}",
}


def prompt(anchor: str, action: str, templates: dict[str, str] | None = None):
    """The question for columns anchor (start or end) and action; null for another anchor."""
    t = templates or PROMPTS
    text = F.when(F.col(anchor) == "start", F.lit(t["start"])).when(F.col(anchor) == "end", F.lit(t["end"]))
    return F.replace(text, F.lit("{action}"), F.col(action))


def dry_answer(seed: str):
    """Cell that the deterministic source gives: seed modulo 9, from 1."""
    return E(f"cast(pmod({seed}, 9) + 1 as int)")


def dry_run(grids: DataFrame, truths: DataFrame, trials: int = 3) -> DataFrame:
    """A trial row for each grid, task and trial: the seed ignores the mode, the cell names a frame of the window."""
    rows = C.grid_recall(grids, truths).withColumn("trial", F.explode(E(f"sequence(0, {trials - 1})")))
    rows = rows.withColumn("seed", derived_seed(F.col("episode"), F.col("task"), F.col("trial"))).withColumn("cell", dry_answer("seed"))
    return rows.withColumn("prediction", F.col("start") + F.col("cell") - 1).withColumn("error", F.abs(F.col("prediction") - F.col("gt")))


def closed_loop(grids: DataFrame, truths: DataFrame) -> DataFrame:
    """One round of feedback. The state source answers yes where the seed is even; a late frame (within 5 of the end) passes anyway.

    A rejected state resamples after the frame, a rejected speed among slower frames, a frame without a speed among all
    others; pinch mode has no speed gate. The same cell then names a frame of the new window. Speeds and the gate's cut
    come from the cue lists of grids, so no frame is read again.
    """
    lists = ("ranked", "ranked_speeds", "speed_list", "pinch_list")
    rows = dry_run(grids.select("episode", "mode", "num_frames", "start", *lists), truths).withColumnRenamed("prediction", "frame_idx")
    rows = rows.withColumn("speed", E("element_at(ranked_speeds, nullif(cast(array_position(ranked, frame_idx) as int), 0))"))
    rows = rows.withColumn("accepted", E("coalesce(speed <= ranked_speeds[greatest(1, cast(floor(0.3D * size(ranked_speeds)) as int)) - 1], false)"))
    rows = rows.withColumn("state", F.coalesce((F.col("seed") % 2 == 0) | (F.col("frame_idx") > F.col("num_frames") - 5), F.lit(False)))
    gated = F.col("mode") != "pinch"
    stage = F.when(~F.col("state"), "visual_feedback").when(gated & F.col("speed").isNull(), "missing_hand_speed").when(gated & ~F.col("accepted"), "speed_feedback").otherwise("accepted")
    rows = rows.withColumn("stage", stage).withColumn("flag", E("case stage when 'visual_feedback' then 'feedback' when 'speed_feedback' then 'speed' else 'fault' end"))
    again = C.mode_candidates_after(rows.withColumn("ref", F.col("frame_idx")).withColumn("ref_speed", F.col("speed")))
    after = C.consecutive_grid(again.withColumn("least", E("if(flag = 'feedback', ref, -1)")).drop("start", "center"), min_index="least")
    return after.withColumn("final", F.when(F.col("stage") == "accepted", F.col("frame_idx")).otherwise(F.col("start") + F.col("cell") - 1))


def long_events(minima: DataFrame, frames: DataFrame) -> DataFrame:
    """contact and separation frames of long clips from the deterministic source's answers to each minimum.

    The seed of (episode, minimum) gives the state (modulo 3: Contact, Separation, Neither) and the cell of the window
    around the minimum; the feedback round says yes. Minima whose state is Neither are left out.
    """
    rows = minima.select("episode", F.col("frame_idx").alias("minimum")).join(frames.select("episode", "num_frames").distinct(), "episode").where(F.col("num_frames") >= C.CELLS)
    rows = rows.withColumn("seed", derived_seed(F.col("episode"), F.lit("state"), F.col("minimum"))).withColumn("event", E("element_at(array('Contact', 'Separation', 'Neither'), cast(seed % 3 + 1 as int))"))
    rows = rows.withColumn("frame_idx", C.window_start(F.col("minimum"), F.col("num_frames")) + dry_answer("seed") - 1)
    return C.pair_events(rows.join(frames.where(C.usable()).select("episode", "frame_idx", "speed"), ["episode", "frame_idx"]).select("episode", "event", "frame_idx", "speed"))
