"""Candidate frames: top-k, segment minima, consecutive windows, gates, pairs. Ties always go to the smaller frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

E = F.expr
CELLS = 9


def by_speed() -> WindowSpec:
    return Window.partitionBy("episode").orderBy("speed", "frame_idx")


def usable(speed: str = "speed") -> Column:
    """0 and NaN mark unknown speeds."""
    return (F.col(speed) != 0) & ~F.isnan(speed)


def slowest(frames: DataFrame, n: int, keep: Column | None = None) -> DataFrame:
    """The n slowest usable frames of each episode that pass `keep`, with their rank."""
    rows = frames.where(usable()) if keep is None else frames.where(usable() & keep)
    return rows.withColumn("rank", F.row_number().over(by_speed())).where(F.col("rank") <= n)


def flagged(flag: str, ref: Column) -> Column:
    """Frames that remain after a rejection: later ones (feedback), slower ones (speed; ref is a speed), or all others."""
    if flag == "feedback":
        return F.col("frame_idx") > ref
    return F.col("speed") < ref if flag == "speed" else F.col("frame_idx") != ref


def slowest_or_spaced(frames: DataFrame, n: int) -> DataFrame:
    """slowest(); episodes without a usable frame get n evenly spaced ones."""
    top = slowest(frames, n).select("episode", "frame_idx")
    bare = frames.groupBy("episode").agg(F.max("num_frames").alias("total"), F.count_if(usable()).alias("have")).where("have = 0 and total > 0")
    spaced = bare.select("episode", F.explode(E(f"slice(sequence(0, total - 1, cast(greatest(1, total div {n}) as int)), 1, {n})")).alias("frame_idx"))
    return top.unionByName(spaced)


def minima(detections: DataFrame, segmented: bool = True) -> DataFrame:
    """Relative minima of pinch over detected frames, split where frames are missing if segmented.

    An inner point is one if it exceeds no neighbour and is under one; a segment without any gives its first least.
    """
    return marked_minima(detections.where("detected"), segmented).where("minimum").select("episode", "frame_idx", "pinch")


def marked_minima(frames: DataFrame, segmented: bool = True) -> DataFrame:
    """All frames, with minimum: whether minima() has them. Frames without a detection lie in no segment; all windows share the exchange by episode."""
    seen = F.coalesce(F.col("detected"), F.lit(False))
    before = F.count_if(seen).over(Window.partitionBy("episode").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = frames.withColumn("seg", F.when(seen, F.col("frame_idx") - before if segmented else F.lit(0)))
    by = Window.partitionBy("episode", "seg")
    order = by.orderBy("frame_idx")
    rows = rows.withColumn("a", F.lag("pinch").over(order)).withColumn("z", F.lead("pinch").over(order))
    rows = rows.withColumn("dip", E("a is not null and z is not null and pinch <= a and pinch <= z and (pinch < a or pinch < z)"))
    rows = rows.withColumn("dips", F.count_if("dip").over(by)).withColumn("least", F.min_by("frame_idx", F.struct("pinch", "frame_idx")).over(by))
    return rows.withColumn("minimum", F.coalesce(F.col("seg").isNotNull() & (F.col("dip") | ((F.col("dips") == 0) & (F.col("frame_idx") == F.col("least")))), F.lit(False))).drop("seg", "a", "z", "dip", "dips", "least")


def with_neighbors(points: DataFrame, totals: DataFrame) -> DataFrame:
    """Each frame and the ones beside it, within the episode, once."""
    near = points.select("episode", F.explode(E("array(frame_idx - 1, frame_idx, frame_idx + 1)")).alias("frame_idx"))
    return near.join(totals, "episode").where("frame_idx >= 0 and frame_idx < num_frames").select("episode", "frame_idx").distinct()


def below_percentile(detections: DataFrame, share: float = 0.15) -> DataFrame:
    cut = detections.where("detected").groupBy("episode").agg(F.percentile("pinch", F.lit(share)).alias("cut"))
    return detections.where("detected").join(cut, "episode").where("pinch < cut").select("episode", "frame_idx", "pinch")


def cue_lists(frames: DataFrame, n: int = 4) -> DataFrame:
    """episode, num_frames, speed_list (n slowest, slowest first), pinch_list (minima and neighbours, in order), ranked (all usable frames by speed), ranked_speeds (theirs).

    One pass over frames with one exchange: windows and lists go by episode.
    """
    order = F.array_sort(F.collect_list(F.when(usable(), F.struct("speed", F.col("frame_idx").alias("f")))))
    rows = marked_minima(frames).groupBy("episode").agg(F.max("num_frames").alias("num_frames"), order.alias("o"), F.collect_list(F.when(F.col("minimum"), F.col("frame_idx"))).alias("minima"))
    near = E("array_sort(array_distinct(filter(flatten(transform(minima, m -> array(m - 1, m, m + 1))), f -> f >= 0 and f < num_frames)))")
    out = rows.select("episode", "num_frames", F.col("o.f").alias("ranked"), F.col("o.speed").alias("ranked_speeds"), near.alias("pinch_list"))
    return out.withColumn("speed_list", F.slice("ranked", 1, n))


def mode_candidates(cues: DataFrame, n: int = 4) -> DataFrame:
    """cues, candidates and fallback frames of each mode; a mode reads only its own signals."""
    one = cues.withColumn("mode", F.explode(F.array(*map(F.lit, ("speed", "pinch", "speed_pinch")))))
    return _filled(one.withColumn("own_pool", E("sequence(0, num_frames - 1)")), n)


def _filled(rows: DataFrame, n: int) -> DataFrame:
    """rows(mode, ranked, speed_list, pinch_list, own_pool): the mode's cues, filled up to n from its pool; the first frames if nothing is left."""
    chronological = E("sequence(0, num_frames - 1)")
    out = rows.withColumn("cues", E("case mode when 'speed' then speed_list when 'pinch' then pinch_list else array_distinct(concat(speed_list, pinch_list)) end"))
    out = out.withColumn("pool", F.when(F.col("mode") == "pinch", F.col("own_pool")).otherwise(F.col("ranked"))).drop("own_pool")
    out = out.withColumn("fallback", E(f"slice(array_except(pool, cues), 1, greatest(0, {n} - size(cues)))"))
    out = out.withColumn("bare", (F.size("cues") + F.size("fallback")) == 0).withColumn("fallback", F.when(F.col("bare"), F.slice(chronological, 1, n)).otherwise(F.col("fallback")))
    return out.withColumn("candidates", F.concat("cues", "fallback")).drop("bare")


def mode_candidates_after(rows: DataFrame, n: int = 4) -> DataFrame:
    """mode_candidates after a rejection, over rows(cue lists, mode, flag, ref, ref_speed).

    feedback leaves the frames after ref, speed those slower than ref_speed (pinch cues all stay), another flag all but ref.
    """
    left = "case flag when 'feedback' then filter({0}, f -> f > ref) when 'speed' then {1} else filter({0}, f -> f <> ref) end"
    slower = "slice(ranked, 1, size(filter(ranked_speeds, s -> s < ref_speed)))"
    out = rows.withColumn("ranked", E(left.format("ranked", slower))).withColumn("speed_list", F.slice("ranked", 1, n))
    out = out.withColumn("pinch_list", E(left.format("pinch_list", "pinch_list"))).withColumn("own_pool", E(left.format("sequence(0, num_frames - 1)", "sequence(0, num_frames - 1)")))
    return _filled(out, n)


def bare_candidates(rows: DataFrame, n: int = 4) -> DataFrame:
    """The variant that fills nothing up, over rows(cue lists, mode, flag, ref, ref_speed): candidates, pool and the frames that a grid must avoid.

    Pinch mode keeps its cues and all frames as pool; only a fault there rules out ref itself.
    """
    slower = "slice(ranked, 1, size(filter(ranked_speeds, s -> s < ref_speed)))"
    allowed = E(f"case flag when 'feedback' then filter(ranked, f -> f > ref) when 'speed' then {slower} else filter(ranked, f -> f <> ref) end")
    out = rows.withColumn("allowed", allowed)
    out = out.withColumn("candidates", E(f"case mode when 'speed' then slice(allowed, 1, {n}) when 'pinch' then pinch_list else array_distinct(concat(slice(allowed, 1, {n}), pinch_list)) end"))
    out = out.withColumn("pool", E("if(mode = 'pinch', sequence(0, num_frames - 1), allowed)"))
    none = "cast(array() as array<int>)"
    return out.withColumn("invalid", E(f"case when mode <> 'pinch' then array_sort(array_except(ranked, allowed)) when flag = 'fault' then array(ref) else {none} end")).drop("allowed")


def window_start(center: Column, total: Column, cells: int = CELLS) -> Column:
    return F.greatest(F.lit(0), F.least(center - cells // 2, total - cells))


def consecutive_grid(lists: DataFrame, candidates: str = "candidates", min_index: str | None = None, cells: int = CELLS) -> DataFrame:
    """Window of `cells` consecutive frames around the half-even mean of the candidates: center, start, relaxed.

    With min_index the nearest window after it, or the plain one, marked relaxed, if there is none.
    """
    clean = F.array_distinct(F.filter(candidates, lambda f: (f >= 0) & (f < F.col("num_frames"))))
    mean = F.aggregate("clean", F.lit(0.0), lambda a, f: a + f) / F.size("clean")
    out = lists.where(F.col("num_frames") >= cells).withColumn("clean", clean)
    out = out.withColumn("center", F.when(F.size("clean") > 0, F.bround(mean).cast("int")).otherwise(E("cast((num_frames - 1) div 2 as int)")))
    start = window_start(F.col("center"), F.col("num_frames"), cells)
    if min_index is None:
        return out.withColumn("start", start).withColumn("relaxed", F.lit(False)).drop("clean")
    after = F.col(min_index) + 1
    out = out.withColumn("relaxed", after > F.col("num_frames") - cells)
    return out.withColumn("start", F.when(F.col("relaxed"), start).otherwise(F.greatest(start, after))).drop("clean")


def walk_grid(lists: DataFrame, candidates: str = "candidates", invalid: str = "invalid", cells: int = CELLS) -> DataFrame:
    """The `cells` frames nearest to the half-even mean of the candidates, left before right at one distance, without the invalid ones.

    average, grid (in order; empty without candidates) and at, the place of the average in it (0 if it is not there).
    """
    mean = F.aggregate(candidates, F.lit(0.0), lambda a, f: a + f) / F.size(candidates)
    out = lists.withColumn("average", F.when(F.size(candidates) > 0, F.bround(mean).cast("int")))
    near = f"transform(array_except(sequence(0, num_frames - 1), {invalid}), f -> named_struct('far', abs(f - average), 'f', f))"
    out = out.withColumn("grid", E(f"if(average is null, cast(array() as array<int>), array_sort(transform(slice(array_sort({near}), 1, {cells}), x -> x.f)))"))
    return out.withColumn("at", E("cast(greatest(0, array_position(grid, coalesce(average, -1)) - 1) as int)"))


def grid_recall(windows: DataFrame, truths: DataFrame, cells: int = CELLS) -> DataFrame:
    """Whether the truth lies in the window, and its distance to the nearest frame of it."""
    far = F.greatest(F.lit(0), F.col("start") - F.col("gt"), F.col("gt") - (F.col("start") + cells - 1))
    return windows.join(truths.select("episode", "task", "gt"), "episode").withColumn("distance", far).withColumn("recall", F.col("distance") == 0)


def in_anchor_region(frame: Column, total: Column, anchor: str) -> Column:
    """Whether a frame lies in the anchor's half of an episode: the first for start, else the second; the middle frame of an odd number is in the second."""
    early = frame < F.floor(total / 2)
    return early if anchor == "start" else ~early


def anchor_filter(lists: DataFrame, anchor: str, size: int = 9) -> DataFrame:
    """Candidates in the anchor's half, topped up to `size` from the pool's; in order."""
    half = lambda f: in_anchor_region(f, F.col("num_frames"), anchor)
    own = F.filter("candidates", half)
    more = F.slice(F.filter(F.array_except("pool", "candidates"), half), F.lit(1), F.greatest(F.lit(0), F.lit(size) - F.size(own)))
    return lists.withColumn("kept", F.array_sort(F.concat(own, more)))


def direct_grid(lists: DataFrame, anchor: str, cells: int = CELLS) -> DataFrame:
    """Grid of evidence itself: evidence in the anchor's half (or any, if none is), its mean, the pool in the half, the pool, then
    frames around the evidence by growing radius (left first), then frames in order; `cells` frames, sorted."""
    half = "f < num_frames div 2" if anchor == "start" else "f >= num_frames div 2"
    fine = "f >= 0 and f < num_frames"
    out = lists.withColumn("own", E(f"slice(array_distinct(filter(candidates, f -> {fine} and {half})), 1, {cells})"))
    out = out.withColumn("own", E(f"if(size(own) > 0, own, slice(array_distinct(filter(candidates, f -> {fine})), 1, {cells}))"))
    out = out.withColumn("mean", E("if(size(own) > 0, array(cast(bround(aggregate(own, 0D, (a, f) -> a + f) / size(own)) as int)), cast(array() as array<int>))"))
    out = out.withColumn("most", E(f"slice(array_distinct(concat(own, mean, filter(pool, f -> {fine} and {half}), filter(pool, f -> {fine}))), 1, {cells})"))
    out = out.withColumn("around", E("array_sort(if(size(own) > 0, own, most))"))
    near = E(f"filter(flatten(transform(sequence(1, {cells}), r -> flatten(transform(around, c -> array(c - r, c + r))))), f -> {fine})")
    out = out.withColumn("grid", F.array_sort(F.slice(F.array_distinct(F.concat("most", near, E("sequence(0, num_frames - 1)"))), 1, cells)))
    return out.drop("own", "mean", "most", "around")


def greedy_spacing(points: DataFrame, least: int) -> DataFrame:
    """Frames taken by ascending speed if `least` away from all taken before; a fold over each episode's list of minima."""
    order = points.groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("speed", "frame_idx"))), lambda x: x["frame_idx"]).alias("order"))
    return order.withColumn("kept", E(f"aggregate(order, cast(array() as array<int>), (a, f) -> if(exists(a, g -> abs(f - g) < {least}), a, array_append(a, f)))"))


def pair_events(events: DataFrame, short: bool = False) -> DataFrame:
    """contact and separation frames: each separation with the slowest contact since the separation before (the first of equals).

    events(episode, event, frame_idx, speed): those without a speed are dropped. short: only the longest pair stays.
    """
    rows = events.where("speed is not null and event in ('Contact', 'Separation')")
    order = Window.partitionBy("episode").orderBy("frame_idx", F.col("event") == "Separation")
    rows = rows.withColumn("part", F.count_if(F.col("event") == "Separation").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    pairs = rows.groupBy("episode", "part").agg(
        F.min_by(F.when(F.col("event") == "Contact", F.col("frame_idx")), F.when(F.col("event") == "Contact", F.struct("speed", "frame_idx"))).alias("contact"),
        F.min(F.when(F.col("event") == "Separation", F.col("frame_idx"))).alias("separation"),
    )
    pairs = pairs.where("contact is not null and separation is not null").select("episode", "contact", "separation")
    if short:
        best = Window.partitionBy("episode").orderBy((F.col("contact") - F.col("separation")), "contact")
        pairs = pairs.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    return pairs


def speed_gate(frames: DataFrame, picks: DataFrame, zero_based: bool = False) -> DataFrame:
    """Whether a picked frame's speed is at most the speed at rank int(0.3 n) of the usable ones (rank from 1, at least 1; or from 0)."""
    ranked = frames.where(usable()).withColumn("rank", F.row_number().over(by_speed())).withColumn("n", F.count("*").over(Window.partitionBy("episode")))
    at = E("cast(floor(0.3D * n) as int)")
    cut = ranked.where(F.col("rank") == (at + 1 if zero_based else F.greatest(F.lit(1), at))).select("episode", F.col("speed").alias("cut"))
    own = picks.join(frames.select("episode", "frame_idx", "speed"), ["episode", "frame_idx"], "left")
    return own.join(cut, "episode", "left").withColumn("accepted", F.coalesce(F.col("speed") <= F.col("cut"), F.lit(False)))


def speed_gate_by_length(frames: DataFrame, picks: DataFrame) -> DataFrame:
    """speed_gate with the rank int(0.3 * num_frames) of all frames; where so many are not usable there is no cut and nothing is accepted."""
    cut = frames.where(usable()).withColumn("rank", F.row_number().over(by_speed())).where("rank = greatest(1, cast(floor(0.3D * num_frames) as int))").select("episode", F.col("speed").alias("cut"))
    own = picks.join(frames.where(usable()).select("episode", "frame_idx", "speed"), ["episode", "frame_idx"], "left")
    return own.join(cut, "episode", "left").withColumn("accepted", F.coalesce(F.col("speed") <= F.col("cut"), F.lit(False)))


def around_minima(frames: DataFrame, points: DataFrame, reach: int = 2) -> DataFrame:
    """Frames up to `reach` places (not frame numbers) from each point and the probability of drawing each: by inverse speed."""
    here = Window.partitionBy("episode").orderBy("frame_idx").rowsBetween(-reach, reach)
    near = frames.withColumn("near", F.collect_list(F.struct("frame_idx", "speed")).over(here)).join(points.select("episode", "frame_idx"), ["episode", "frame_idx"], "left_semi")
    rows = near.select("episode", F.col("frame_idx").alias("minimum"), F.explode("near").alias("n")).select("episode", "minimum", "n.frame_idx", "n.speed").withColumn("w", E("1 / (speed + 1e-8D)"))
    return rows.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("episode", "minimum")))


def cue_coverage(windows: DataFrame, cells: int = CELLS) -> DataFrame:
    """How many of the window's frames are speed cues, pinch cues only, neither, and both."""
    used = E(f"sequence(start, start + {cells - 1})")
    out = windows.withColumn("used", used).withColumn("s", F.array_intersect("used", "speed_list")).withColumn("p", F.array_intersect("used", "pinch_list"))
    return out.select("episode", "mode", F.size("s").alias("speed_n"), F.size(F.array_except("p", "s")).alias("pinch_n"), E(f"{cells} - size(array_union(s, p))").alias("neutral_n"), F.size(F.array_intersect("s", "p")).alias("overlap_n"))


def feedback_candidates(picks: DataFrame, frames: DataFrame, reach: int = 3) -> DataFrame:
    """Frames within reach of a rejected one and the probability of drawing each: inverse speed, 9999 where unknown."""
    near = picks.select("episode", "num_frames", F.col("frame_idx").alias("rejected")).withColumn("frame_idx", F.explode(E(f"sequence(rejected - {reach}, rejected + {reach})"))).where("frame_idx >= 0 and frame_idx < num_frames and frame_idx <> rejected")
    rows = near.join(frames.select("episode", "frame_idx", "speed"), ["episode", "frame_idx"], "left").withColumn("w", E("1 / (coalesce(speed, 9999D) + 1e-8D)"))
    return rows.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("episode", "rejected")))
