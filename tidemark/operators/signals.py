"""Signal construction over frame series: one row per episode and frame, one window specification per operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

E = F.expr


def series() -> WindowSpec:
    """The one window of all series operators, so that they share an exchange."""
    return Window.partitionBy("episode").orderBy("frame_idx")


def _distance(*pairs: tuple[str, str]) -> Column:
    return F.sqrt(sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in pairs), F.lit(0.0)))


def detected_speed(frames: DataFrame, per_gap: bool = True) -> DataFrame:
    """Distance to the previous detected centre, over the frame gap if per_gap; 0 where not or first detected."""
    return speed_from(frames.withColumn("p", F.last(seen(), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))), per_gap)


def seen() -> Column:
    """Frame and centre where there is a detection."""
    return F.when(F.col("detected"), F.struct("frame_idx", "x", "y"))


def speed_from(rows: DataFrame, per_gap: bool) -> DataFrame:
    """The speed of rows with p, the previous detection."""
    gap = F.greatest(F.lit(1), F.col("frame_idx") - F.col("p.frame_idx")) if per_gap else F.lit(1)
    return rows.withColumn("speed", F.when(F.col("detected") & F.col("p").isNotNull(), _distance(("x", "p.x"), ("y", "p.y")) / gap).otherwise(0.0)).drop("p")


def reset_speed(frames: DataFrame) -> DataFrame:
    """As detected_speed, but a missing frame makes the next detection a first one."""
    last = F.lag(F.when(F.col("detected"), F.struct("frame_idx", "x", "y"))).over(series())
    out = frames.withColumn("p", last)
    near = F.col("detected") & (F.col("p.frame_idx") == F.col("frame_idx") - 1)
    return out.withColumn("speed", F.when(near, _distance(("x", "p.x"), ("y", "p.y"))).otherwise(0.0)).drop("p")


def interpolated_speed(frames: DataFrame, interval: float = 1.0) -> DataFrame:
    """Speed over positions filled linearly between detections (flat beyond them) if an episode has two at least."""
    here = series().rowsBetween(Window.unboundedPreceding, 0)
    out = frames.withColumn("a", F.last(seen(), ignorenulls=True).over(here)).withColumn("z", F.first(seen(), ignorenulls=True).over(series().rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("n", F.count_if("detected").over(Window.partitionBy("episode")))
    out = filled(out).withColumn("px", F.lag("fx").over(series())).withColumn("py", F.lag("fy").over(series())).withColumn("begins", F.lag("frame_idx").over(series()).isNull())
    return out.withColumn("speed", step_speed(interval)).drop("a", "z", "n", "fx", "fy", "px", "py", "begins")


def filled(rows: DataFrame) -> DataFrame:
    """fx, fy between the detections a before and z after (each the row's own, if it has one); n: detections of the episode."""
    share = (F.col("frame_idx") - F.col("a.frame_idx")) / (F.col("z.frame_idx") - F.col("a.frame_idx"))

    def fill(c: str) -> Column:
        between = F.when(F.col("a.frame_idx") == F.col("z.frame_idx"), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + (F.col(f"z.{c}") - F.col(f"a.{c}")) * share)
        return F.when(F.col("detected"), F.col(c)).when(F.col("n") > 1, F.coalesce(between, F.col(f"a.{c}"), F.col(f"z.{c}")))

    return rows.withColumn("fx", fill("x")).withColumn("fy", fill("y"))


def step_speed(interval: float) -> Column:
    """From (px, py) to (fx, fy); 0 where the series begins."""
    return F.when(F.col("begins"), 0.0).otherwise(_distance(("fx", "px"), ("fy", "py")) / interval)


def bimanual(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per frame the larger speed of both hands; a hand that is absent counts as 0."""
    both = left.select("episode", "frame_idx", F.col("speed").alias("l")).join(right.select("episode", "frame_idx", F.col("speed").alias("r")), ["episode", "frame_idx"], "full_outer")
    return both.select("episode", "frame_idx", F.greatest(F.coalesce("l", F.lit(0.0)), F.coalesce("r", F.lit(0.0))).alias("speed"))


def hand_centers(hands: DataFrame, confidence: float = 0.5, least: int = 4) -> DataFrame:
    """Per video the mean point of the hand with the highest mean confidence, over points above `confidence`."""
    good = hands.withColumn("good", F.filter("kp", lambda p: p["conf"] > confidence)).where(F.size("good") >= least)

    def mean(c: str) -> Column:
        return F.aggregate("good", F.lit(0.0), lambda a, p: a + p[c]) / F.size("good")

    ranked = good.select("video", "hand", mean("x").alias("x"), mean("y").alias("y"), mean("conf").alias("conf"))
    best = ranked.groupBy("video").agg(F.min_by(F.struct("hand", "x", "y"), F.struct((-F.col("conf")).alias("c"), "hand")).alias("b"))
    return best.select("video", "b.hand", "b.x", "b.y")


def pinch_distances(hands: DataFrame) -> DataFrame:
    """Per video the least distance between thumb tip (4) and index tip (8); the first hand of equals."""
    d = E("sqrt((kp[4].x - kp[8].x) * (kp[4].x - kp[8].x) + (kp[4].y - kp[8].y) * (kp[4].y - kp[8].y))")
    return hands.select("video", "hand", d.alias("d")).groupBy("video").agg(F.min("d").alias("pinch"), F.min_by("hand", F.struct("d", "hand")).alias("hand"))


def detection_status(frames: DataFrame) -> DataFrame:
    """status of readable (boolean), hands (count) and valid (count of hands with enough points)."""
    status = F.when(~F.col("readable"), "frame_read_failed").when(F.col("hands") == 0, "no_hand_detected").when(F.col("valid") == 0, "no_valid_hand_keypoints").otherwise("detected")
    return frames.withColumn("status", status)


def unproject(points: DataFrame, width: float, height: float) -> DataFrame:
    """Camera coordinates of pixels u, v at depth z: focal length max(width, height), centre half the size."""
    f = float(max(width, height))
    return points.withColumn("cx", (F.col("u") - width / 2) * F.col("z") / f).withColumn("cy", (F.col("v") - height / 2) * F.col("z") / f)


def plausible_depth(z: str = "z", most: float = 5.0) -> Column:
    """Whether a depth in metres is positive and at most `most`; null and NaN are not."""
    return F.coalesce((F.col(z) > 0) & (F.col(z) <= most), F.lit(False))


def rigid_transform(points: DataFrame) -> DataFrame:
    """T (16 numbers, row by row) applied to p (3 numbers); the first frame passes through."""

    def row(i: int) -> Column:
        h = F.array_append("p", F.lit(1.0))
        return F.aggregate(F.zip_with(F.slice("T", 4 * i + 1, 4), h, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    moved = F.array(*(row(i) for i in range(3)))
    return points.withColumn("q", F.when(F.col("frame_idx") == 0, F.col("p")).otherwise(moved))


def trailing_mean(frames: DataFrame, value: str, width: int = 15) -> DataFrame:
    return frames.withColumn("smooth", F.avg(value).over(series().rowsBetween(1 - width, 0)))


def detection_rate(frames: DataFrame) -> DataFrame:
    return frames.groupBy("episode").agg((F.avg(F.col("detected").cast("double")) * 100).alias("rate"), F.count("*").alias("n"))


def diagnostic_sample(frames: DataFrame, k: int = 10) -> DataFrame:
    """The k evenly spaced frames of each episode: floor of i * (n - 1) / (k - 1)."""
    at = frames.select("episode", "num_frames").distinct().select("episode", F.explode(E(f"array_distinct(transform(sequence(0, {k - 1}), i -> cast(floor(i * (num_frames - 1) / {k - 1}) as int)))")).alias("frame_idx"))
    return frames.join(at, ["episode", "frame_idx"], "left_semi")


def invert_depth(tensors: DataFrame) -> DataFrame:
    """Metres of inverse depths."""
    return tensors.withColumn("metres", F.transform("inv", lambda x: F.lit(3.0) / (x + 1e-6)))


def invalid_tensor(tensors: DataFrame, least: float = 1e-4) -> DataFrame:
    """Whether a tensor has no finite value, or a population deviation under `least`."""
    finite = F.filter("inv", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = tensors.withColumn("f", finite).withColumn("m", F.aggregate("f", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("f"), F.lit(0)))
    spread = F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.nullif(F.size("f"), F.lit(0)))
    return out.withColumn("invalid", F.when(F.size("f") == 0, True).otherwise(spread < least)).drop("f", "m")


def clip_duration(clips: DataFrame) -> DataFrame:
    return clips.withColumn("duration", F.when(F.col("readable"), F.when(F.col("fps") > 0, F.col("n_frames") / F.col("fps")).otherwise(0.0)))


def shared_pass(hands: DataFrame, confidence: float = 0.5, least: int = 4) -> DataFrame:
    """Both signals of one pass over hands(video, hand, kp): status, centre x, y of the surest hand, pinch and its hand.

    A hand is valid with `least` points above the confidence; pinch is taken over valid hands alone.
    """
    good = hands.withColumn("good", F.filter("kp", lambda p: p["conf"] > confidence)).withColumn("valid", F.size("good") >= least)

    def mean(c: str) -> Column:
        return F.aggregate("good", F.lit(0.0), lambda a, p: a + p[c]) / F.size("good")

    d = E("sqrt((kp[4].x - kp[8].x) * (kp[4].x - kp[8].x) + (kp[4].y - kp[8].y) * (kp[4].y - kp[8].y))")
    rows = good.select("video", "hand", "valid", F.when(F.col("valid"), F.struct((-mean("conf")).alias("c"), "hand", mean("x").alias("x"), mean("y").alias("y"))).alias("centre"), F.when(F.col("valid"), F.struct(d.alias("pinch"), "hand")).alias("closest"))
    out = rows.groupBy("video").agg(F.count("*").alias("hands"), F.count_if("valid").alias("valid"), F.min("centre").alias("centre"), F.min("closest").alias("closest"))
    return detection_status(out.withColumn("readable", F.lit(True))).select("video", "status", "centre.x", "centre.y", "closest.pinch", F.col("closest.hand").alias("pinch_hand"))


def curve(log: DataFrame, value: str, at: str = "epoch") -> DataFrame:
    """The points (at, value) of a training log where the value is there."""
    return log.where(F.col(value).isNotNull()).select(F.col(at), F.col(value).alias("value"))


def shifted(track: DataFrame, by: int) -> DataFrame:
    """A track with its frames renumbered: 1 from 0-based to 1-based numbers, -1 back."""
    return track.withColumn("frame_idx", F.col("frame_idx") + by)
