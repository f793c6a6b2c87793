"""The series operators for series of any length: the same results as signals.py and candidates.py, by scans over runs.

The window forms put an episode in one task, which is right for clips; here a recording of any length lies in runs of
about `run` frames, and what an operator has to know of the frames before (the last detection, the frame before, the
number of segments so far) or after is carried from run to run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import signals as S
from tidemark.operators.runs import RUN, carried, in_runs
from tidemark.sources.stages import stored

BY, ORDER = ["episode"], ["frame_idx"]


def detected_speed(frames: DataFrame, per_gap: bool = True, run: int = 200_000) -> DataFrame:
    """signals.detected_speed: the carry is the last detection."""
    return S.speed_from(carried(in_runs(frames, BY, ORDER, run), BY, ORDER, {"p": ("last", S.seen())}), per_gap).drop(RUN)


def interpolated_speed(frames: DataFrame, interval: float = 1.0, run: int = 200_000) -> DataFrame:
    """signals.interpolated_speed: carries are the last detection, the next one from behind, then the filled place of the frame before."""
    runs = in_runs(frames, BY, ORDER, run)
    rows = stored(carried(runs, BY, ORDER, {"a": ("last", S.seen())}), "before")
    rows = carried(rows, BY, ORDER, {"z": ("last", S.seen())}, backwards=True)
    known = runs.groupBy(F.col("episode").alias("episode_")).agg(F.count_if("detected").alias("n"))
    own = S.seen()
    rows = rows.join(known, F.col("episode").eqNullSafe(F.col("episode_"))).withColumn("a", F.coalesce(own, "a")).withColumn("z", F.coalesce(own, "z"))
    rows = stored(S.filled(rows).drop("a", "z", "n", "episode_"), "filled")
    rows = carried(rows, BY, ORDER, {"q": ("last", F.struct("fx", "fy"))}).select("*", "q.*", F.col("q").isNull().alias("begins"))
    rows = rows.toDF(*rows.columns[:-3], "px", "py", "begins")
    return rows.withColumn("speed", S.step_speed(interval)).drop("q", "fx", "fy", "px", "py", "begins", RUN)


def minima(detections: DataFrame, segmented: bool = True, run: int = 200_000) -> DataFrame:
    """candidates.minima: carries are the neighbours on both sides and the number of segments begun; a segment is reduced by partial aggregation."""
    here = F.struct("frame_idx", "pinch")
    rows = stored(carried(in_runs(detections.where("detected").select("episode", "frame_idx", "pinch"), BY, ORDER, run), BY, ORDER, {"a": ("last", here)}), "before")
    rows = carried(rows, BY, ORDER, {"z": ("last", here)}, backwards=True)
    joins = lambda c, step: F.col(c).isNotNull() & ((F.col(f"{c}.frame_idx") == F.col("frame_idx") + step) if segmented else F.lit(True))
    rows = rows.withColumn("begins", (~joins("a", -1)).cast("int")).withColumn("a", F.when(joins("a", -1), F.col("a.pinch"))).withColumn("z", F.when(joins("z", 1), F.col("z.pinch")))
    rows = rows.withColumn("dip", F.expr("a is not null and z is not null and pinch <= a and pinch <= z and (pinch < a or pinch < z)"))
    rows = carried(stored(rows.drop("a", "z"), "dips"), BY, ORDER, {"before": ("sum", F.col("begins"))}).withColumn("seg", F.col("before") + F.col("begins"))
    flat = rows.groupBy("episode", "seg").agg(F.count_if("dip").alias("dips"), F.min(F.struct("pinch", "frame_idx")).alias("least")).where("dips = 0")
    return rows.where("dip").select("episode", "frame_idx", "pinch").unionAll(flat.select("episode", "least.frame_idx", "least.pinch"))
