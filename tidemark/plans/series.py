"""Queries over frame series: signals and candidates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators import signals as S
from tidemark.plans.ctes import FRAMES, HANDS, TRUTHS
from tidemark.sources import tables as T

E = F.expr
R6 = lambda c, name=None: F.round(c, 6).alias(name or c)
KEYS = ("episode", "frame_idx")


def _frames(s, d):
    return T.frames(s, d)


def _seen(s, d):
    return T.frames(s, d).select("episode", "frame_idx", "num_frames", "detected", "x", "y", "speed", "pinch")


_LAST = "max(CASE WHEN detected THEN frame_idx END) OVER (PARTITION BY episode ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _speed_sql(gap: str) -> str:
    return f"""WITH {FRAMES}, p AS (SELECT *, {_LAST} AS pf FROM frames)
 SELECT p.episode, p.frame_idx, round(CASE WHEN p.detected AND pf IS NOT NULL THEN sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) / {gap} ELSE 0 END, 6) AS speed
 FROM p LEFT JOIN frames q ON q.episode = p.episode AND q.frame_idx = p.pf"""


_TENSORS = "tensors AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN [1.0::DOUBLE, 1.0] ELSE [x::DOUBLE FOR x IN embedding] END AS inv FROM embeddings)"


def _tensors(s, d):
    return T.table(s, d, "embeddings").selectExpr("vec_id", "if(vec_id % 50 = 0, array(1D, 1D), transform(embedding, x -> cast(x as double))) as inv")


_CUES = f"""{FRAMES}, totals AS (SELECT episode, max(num_frames) AS num_frames FROM frames GROUP BY episode),
 ranked AS (SELECT episode, list(frame_idx ORDER BY speed, frame_idx) AS ranked FROM frames WHERE speed <> 0 GROUP BY episode),
 seg AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY episode ORDER BY frame_idx) AS seg FROM frames WHERE detected),
 nb AS (SELECT *, lag(pinch) OVER (PARTITION BY episode, seg ORDER BY frame_idx) AS a, lead(pinch) OVER (PARTITION BY episode, seg ORDER BY frame_idx) AS z FROM seg),
 dip AS (SELECT *, coalesce(pinch <= a AND pinch <= z AND (pinch < a OR pinch < z), false) AS dip FROM nb),
 least AS (SELECT *, count(*) FILTER (dip) OVER (PARTITION BY episode, seg) AS dips, row_number() OVER (PARTITION BY episode, seg ORDER BY pinch, frame_idx) AS rn FROM dip),
 minima AS (SELECT episode, frame_idx, pinch FROM least WHERE dip OR (dips = 0 AND rn = 1)),
 near AS (SELECT DISTINCT m.episode, f.f AS frame_idx FROM minima m, LATERAL (SELECT unnest([m.frame_idx - 1, m.frame_idx, m.frame_idx + 1]) AS f) f JOIN totals t ON t.episode = m.episode WHERE f.f >= 0 AND f.f < t.num_frames),
 pl AS (SELECT episode, list(frame_idx ORDER BY frame_idx) AS pinch_list FROM near GROUP BY episode),
 cues AS (SELECT t.episode, t.num_frames, coalesce(ranked, []) AS ranked, coalesce(pinch_list, []) AS pinch_list, coalesce(ranked, [])[1:4] AS speed_list FROM totals t LEFT JOIN ranked USING (episode) LEFT JOIN pl USING (episode))"""
_MODES = _CUES + """, m0 AS (SELECT cues.*, mode, CASE mode WHEN 'speed' THEN speed_list WHEN 'pinch' THEN pinch_list ELSE speed_list || list_filter(pinch_list, lambda f: NOT list_contains(speed_list, f)) END AS cues_,
 CASE WHEN mode = 'pinch' THEN range(num_frames)::INT[] ELSE ranked END AS pool FROM cues, (VALUES ('speed'), ('pinch'), ('speed_pinch')) v(mode)),
 m1 AS (SELECT *, list_filter(pool, lambda f: NOT list_contains(cues_, f))[1:greatest(0, 4 - len(cues_))] AS fb FROM m0),
 modes AS (SELECT * EXCLUDE (fb), CASE WHEN len(cues_) + len(fb) = 0 THEN (range(num_frames)::INT[])[1:4] ELSE fb END AS fallback, cues_ || CASE WHEN len(cues_) + len(fb) = 0 THEN (range(num_frames)::INT[])[1:4] ELSE fb END AS candidates FROM m1)"""
_GRID = _MODES + """, cen AS (SELECT *, CASE WHEN len(candidates) > 0 THEN round_even(list_avg(candidates), 0)::INT ELSE (num_frames - 1) // 2 END AS center FROM modes WHERE num_frames >= 9),
 grid AS (SELECT *, greatest(0, least(center - 4, num_frames - 9))::INT AS start FROM cen)"""


def _text(c: str, name: str | None = None):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(name or c)


def _cues(s, d):
    return C.cue_lists(_frames(s, d))


def _modes(s, d):
    return C.mode_candidates(_cues(s, d))


def _grid(s, d):
    return C.consecutive_grid(_modes(s, d))


_PICK = "(episode * 11 + 5) % num_frames"
_PICKS = f"picks AS (SELECT episode, num_frames, ({_PICK})::INT AS frame_idx FROM (SELECT episode, max(num_frames) AS num_frames FROM frames GROUP BY episode))"


def _picks(s, d):
    return T.episodes(s, d).selectExpr("episode", "num_frames", f"cast({_PICK} as int) as frame_idx")


def _top_sql(keep: str, pick: str = "") -> str:
    return f"""WITH {FRAMES}, {_PICKS}, r AS (SELECT f.episode, f.frame_idx, f.speed, row_number() OVER (PARTITION BY f.episode ORDER BY f.speed, f.frame_idx) AS rank
 FROM frames f JOIN picks p ON p.episode = f.episode WHERE f.speed <> 0 AND {keep}) SELECT episode, frame_idx, round(speed, 6) AS speed, rank::INT AS rank FROM r WHERE rank <= 4"""


def _top(flag, ref=None):
    def run(s, d):
        rows = _frames(s, d).join(_picks(s, d).select("episode", F.col("frame_idx").alias("ref")), "episode")
        return C.slowest(rows, 4, C.flagged(flag, F.col("ref") if ref is None else F.lit(ref))).select(*KEYS, R6("speed"), "rank")

    return run


_EV = "CASE (frame_idx % 5)::INT WHEN 1 THEN 'Contact' WHEN 3 THEN 'Contact' WHEN 4 THEN 'Separation' ELSE 'Neither' END"


def _events(s, d):
    return _frames(s, d).selectExpr("episode", f"{_EV.replace('(frame_idx % 5)::INT', 'frame_idx % 5')} as event", "frame_idx", "if(speed = 0, null, speed) as speed")


_PAIRS = f"""{FRAMES}, ev AS (SELECT episode, {_EV} AS event, frame_idx, CASE WHEN speed = 0 THEN NULL ELSE speed END AS speed FROM frames),
 pt AS (SELECT *, count(*) FILTER (event = 'Separation') OVER (PARTITION BY episode ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM ev WHERE speed IS NOT NULL AND event <> 'Neither'),
 pairs AS (SELECT episode, (list(frame_idx ORDER BY speed, frame_idx) FILTER (event = 'Contact'))[1] AS contact, min(frame_idx) FILTER (event = 'Separation') AS separation FROM pt GROUP BY episode, part)"""


def _interp_sql() -> str:
    return f"""WITH {FRAMES}, n AS (SELECT *, count(*) FILTER (detected) OVER (PARTITION BY episode) AS n,
 max(CASE WHEN detected THEN frame_idx END) OVER (PARTITION BY episode ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
 min(CASE WHEN detected THEN frame_idx END) OVER (PARTITION BY episode ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM frames),
 f AS (SELECT n.episode, n.frame_idx, CASE WHEN n.detected THEN n.x WHEN n.n > 1 THEN CASE WHEN a IS NULL THEN q.x WHEN z IS NULL THEN p.x ELSE p.x + (q.x - p.x) * ((n.frame_idx - a)::DOUBLE / (z - a)) END END AS fx,
 CASE WHEN n.detected THEN n.y WHEN n.n > 1 THEN CASE WHEN a IS NULL THEN q.y WHEN z IS NULL THEN p.y ELSE p.y + (q.y - p.y) * ((n.frame_idx - a)::DOUBLE / (z - a)) END END AS fy
 FROM n LEFT JOIN frames p ON p.episode = n.episode AND p.frame_idx = a LEFT JOIN frames q ON q.episode = n.episode AND q.frame_idx = z),
 l AS (SELECT *, lag(fx) OVER w AS px, lag(fy) OVER w AS py FROM f WINDOW w AS (PARTITION BY episode ORDER BY frame_idx))
 SELECT episode, frame_idx, round(CASE WHEN frame_idx = 0 THEN 0 ELSE sqrt((fx - px) * (fx - px) + (fy - py) * (fy - py)) END, 6) AS speed FROM l"""


_HALF = "f < num_frames // 2"
_DIRECT = _MODES + """, d0 AS (SELECT *, list_filter(candidates, lambda f: f < num_frames // 2)[1:9] AS o FROM modes),
 d1 AS (SELECT *, CASE WHEN len(o) > 0 THEN o ELSE candidates[1:9] END AS own FROM d0),
 src AS (SELECT episode, mode, 1 AS pass, 0 AS pos, f.f, 0 AS c FROM (SELECT episode, mode, unnest(own) AS f FROM d1) f
 UNION ALL SELECT episode, mode, 2, 0, round_even(list_avg(own), 0)::INT, 0 FROM d1 WHERE len(own) > 0),
 own_pos AS (SELECT episode, mode, unnest(range(1, len(own) + 1)) AS pos, unnest(own) AS f FROM d1),
 pool_pos AS (SELECT episode, mode, num_frames, unnest(range(1, len(pool) + 1)) AS pos, unnest(pool) AS f FROM d1),
 steps AS (SELECT episode, mode, 1 AS pass, pos, f FROM own_pos UNION ALL SELECT episode, mode, 2, 0, f FROM src WHERE pass = 2
 UNION ALL SELECT episode, mode, 3, pos, f FROM pool_pos WHERE f < num_frames // 2 UNION ALL SELECT episode, mode, 4, pos, f FROM pool_pos),
 firsts AS (SELECT episode, mode, f, min(pass * 1000000 + pos) AS k FROM steps GROUP BY ALL),
 most AS (SELECT episode, mode, list(f ORDER BY k)[1:9] AS most FROM firsts GROUP BY ALL),
 a AS (SELECT d1.episode, d1.mode, num_frames, most, list_sort(CASE WHEN len(own) > 0 THEN own ELSE most END) AS around FROM d1 JOIN most USING (episode, mode)),
 beside AS (SELECT episode, mode, num_frames, r * 10000 + pos * 2 + side AS k, c + CASE side WHEN 0 THEN -r ELSE r END AS f FROM (SELECT episode, mode, num_frames, unnest(range(1, len(around) + 1)) AS pos, unnest(around) AS c FROM a), range(1, 10) g(r), range(2) h(side)),
 alls AS (SELECT episode, mode, unnest(range(1, len(most) + 1)) AS k, unnest(most) AS f FROM a UNION ALL SELECT episode, mode, 1000 + k, f FROM beside WHERE f >= 0 AND f < num_frames
 UNION ALL SELECT episode, mode, 1000000 + g.i, g.i FROM a, LATERAL (SELECT unnest(range(num_frames)) AS i) g),
 pick AS (SELECT episode, mode, f, min(k) AS k FROM alls GROUP BY ALL), nine AS (SELECT *, row_number() OVER (PARTITION BY episode, mode ORDER BY k) AS rn FROM pick)
 SELECT episode, mode, string_agg(f::VARCHAR, ',' ORDER BY f) AS grid FROM nine WHERE rn <= 9 GROUP BY ALL"""

QUERIES = {
    "gap_speed": (lambda s, d: S.detected_speed(_seen(s, d)).select(*KEYS, R6("speed")), _speed_sql("greatest(1, p.frame_idx - pf)")),
    "naive_speed": (lambda s, d: S.detected_speed(_seen(s, d), per_gap=False).select(*KEYS, R6("speed")), _speed_sql("1")),
    "reset_speed": (lambda s, d: S.reset_speed(_seen(s, d)).select(*KEYS, R6("speed")), f"""WITH {FRAMES} SELECT p.episode, p.frame_idx, round(CASE WHEN p.detected AND q.detected THEN sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) ELSE 0 END, 6) AS speed
 FROM frames p LEFT JOIN frames q ON q.episode = p.episode AND q.frame_idx = p.frame_idx - 1"""),
    "interp_speed": (lambda s, d: S.interpolated_speed(_seen(s, d)).select(*KEYS, R6("speed")), _interp_sql()),
    "bimanual_max": (lambda s, d: S.bimanual(_frames(s, d).where("frame_idx % 3 > 0"), _frames(s, d).where("frame_idx % 2 = 0").withColumn("speed", F.col("y"))).select(*KEYS, R6("speed")),
        f"WITH {FRAMES} SELECT episode, frame_idx, round(greatest(CASE WHEN frame_idx % 3 > 0 THEN speed ELSE 0 END, CASE WHEN frame_idx % 2 = 0 THEN y ELSE 0 END), 6) AS speed FROM frames WHERE frame_idx % 3 > 0 OR frame_idx % 2 = 0"),
    "hand_center": (lambda s, d: S.hand_centers(T.hands(s, d), confidence=0.0).select("video", "hand", R6("x"), R6("y")), f"""WITH {HANDS}, g AS (SELECT video, hand, list_filter(kp, lambda p: p.conf > 0) AS good FROM hands),
 m AS (SELECT video, hand, list_avg([p.x FOR p IN good]) AS x, list_avg([p.y FOR p IN good]) AS y, list_avg([p.conf FOR p IN good]) AS conf FROM g WHERE len(good) >= 4)
 SELECT video, hand, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY conf DESC, hand) AS rn FROM m) WHERE rn = 1"""),
    "pinch_distance": (lambda s, d: S.pinch_distances(T.hands(s, d)).select("video", R6("pinch"), "hand"), f"""WITH {HANDS}, m AS (SELECT video, hand, sqrt((kp[5].x - kp[9].x) ** 2 + (kp[5].y - kp[9].y) ** 2) AS d FROM hands)
 SELECT video, round(d, 6) AS pinch, hand FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY d, hand) AS rn FROM m) WHERE rn = 1"""),
    "detection_status": (lambda s, d: S.detection_status(_frames(s, d).selectExpr("episode", "frame_idx", "frame_idx % 7 > 0 as readable", "frame_idx % 3 as hands", "frame_idx % 2 as valid")).select(*KEYS, "status"),
        f"WITH {FRAMES} SELECT episode, frame_idx, CASE WHEN frame_idx % 7 = 0 THEN 'frame_read_failed' WHEN frame_idx % 3 = 0 THEN 'no_hand_detected' WHEN frame_idx % 2 = 0 THEN 'no_valid_hand_keypoints' ELSE 'detected' END AS status FROM frames"),
    "unproject": (lambda s, d: S.unproject(_frames(s, d).selectExpr("episode", "frame_idx", "x as u", "y as v", "1 + pinch / 100 as z"), 1000, 600).where(S.plausible_depth()).select(*KEYS, *(F.round(c, 9).alias(c) for c in ("cx", "cy", "z"))),
        f"WITH {FRAMES}, z AS (SELECT *, 1 + pinch / 100 AS z FROM frames) SELECT episode, frame_idx, round((x - 500) * z / 1000, 9) AS cx, round((y - 300) * z / 1000, 9) AS cy, round(z, 9) AS z FROM z WHERE z > 0 AND z <= 5"),
    "rigid_transform": (lambda s, d: S.rigid_transform(_frames(s, d).selectExpr("episode", "frame_idx", "array(x, y, speed) as p", "array(0.8D, -0.6D, 0D, 1D, 0.6D, 0.8D, 0D, 2D, 0D, 0D, 1D, cast(frame_idx as double), 0D, 0D, 0D, 1D) as T")).select(*KEYS, *(F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(3))),
        f"""WITH {FRAMES} SELECT episode, frame_idx, round(CASE WHEN frame_idx = 0 THEN x ELSE 0.8 * x - 0.6 * y + 1 END, 6) AS q0, round(CASE WHEN frame_idx = 0 THEN y ELSE 0.6 * x + 0.8 * y + 2 END, 6) AS q1, round(CASE WHEN frame_idx = 0 THEN speed ELSE speed + frame_idx END, 6) AS q2 FROM frames"""),
    "trailing_mean": (lambda s, d: S.trailing_mean(_frames(s, d), "speed").select(*KEYS, R6("smooth")), f"WITH {FRAMES} SELECT episode, frame_idx, round(avg(speed) OVER (PARTITION BY episode ORDER BY frame_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 6) AS smooth FROM frames"),
    "detection_rate": (lambda s, d: S.detection_rate(_frames(s, d)).select("episode", R6("rate"), "n"), f"WITH {FRAMES} SELECT episode, round(avg(detected::INT) * 100, 6) AS rate, count(*) AS n FROM frames GROUP BY episode"),
    "diagnostic_sample": (lambda s, d: S.diagnostic_sample(_frames(s, d)).groupBy("episode").agg(F.count("*").alias("n"), F.round(F.min("pinch"), 6).alias("low"), F.round(F.max("pinch"), 6).alias("high"), F.round(F.avg("pinch"), 6).alias("mean"), F.round(F.avg(F.col("detected").cast("double")) * 100, 6).alias("rate")).withColumn("warn", E("rate < 50")),
        f"""WITH {FRAMES}, t AS (SELECT DISTINCT f.episode, floor(i * (f.n - 1) / 9)::INT AS frame_idx FROM (SELECT episode, max(num_frames) AS n FROM frames GROUP BY episode) f, range(10) r(i))
 SELECT episode, count(*) AS n, round(min(pinch), 6) AS low, round(max(pinch), 6) AS high, round(avg(pinch), 6) AS mean, round(avg(detected::INT) * 100, 6) AS rate, round(avg(detected::INT) * 100, 6) < 50 AS warn FROM frames JOIN t USING (episode, frame_idx) GROUP BY episode"""),
    "depth_invert": (lambda s, d: S.invert_depth(_tensors(s, d)).select("vec_id", F.round(F.col("metres")[0], 4).alias("first"), F.size("metres").cast("bigint").alias("n")), f"WITH {_TENSORS} SELECT vec_id, round(3.0::DOUBLE / (inv[1] + 1e-6::DOUBLE), 4) AS first, len(inv) AS n FROM tensors"),
    "invalid_tensor": (lambda s, d: S.invalid_tensor(_tensors(s, d)).select("vec_id", "invalid"), f"WITH {_TENSORS} SELECT vec_id, list_stddev_pop(inv) < 1e-4 AS invalid FROM tensors"),
    "invalid_frames": (lambda s, d: S.invalid_tensor(_tensors(s, d)).where("invalid").selectExpr("vec_id div 100 as video", "cast(vec_id % 100 as int) as frame_idx"), f"WITH {_TENSORS} SELECT vec_id // 100 AS video, (vec_id % 100)::INT AS frame_idx FROM tensors WHERE list_stddev_pop(inv) < 1e-4"),
    "clip_duration": (lambda s, d: S.clip_duration(T.files(s, d).selectExpr("page_id", "readable", "size as n_frames", "cast(page_id % 4 * 10 as double) as fps")).select("page_id", R6("duration")), "SELECT page_id, CASE WHEN page_id % 10 > 0 THEN CASE WHEN page_id % 4 > 0 THEN round(length(html) / (page_id % 4 * 10.0::DOUBLE), 6) ELSE 0.0 END END::DOUBLE AS duration FROM pages"),
    "topn_speed": (lambda s, d: C.slowest(_frames(s, d), 4).select(*KEYS, R6("speed"), "rank"), _top_sql("true")),
    "topn_feedback": (_top("feedback"), _top_sql("f.frame_idx > p.frame_idx")),
    "topn_speed_flag": (_top("speed", 40.0), _top_sql("f.speed < 40")),
    "topn_exclude": (_top(""), _top_sql("f.frame_idx <> p.frame_idx")),
    "topn_fallback": (lambda s, d: C.slowest_or_spaced(_frames(s, d).withColumn("speed", E("if(episode % 3 = 0, 0D, speed)")), 4),
        f"""WITH {FRAMES}, f AS (SELECT * REPLACE (CASE WHEN episode % 3 = 0 THEN 0.0::DOUBLE ELSE speed END AS speed) FROM frames),
 r AS (SELECT episode, frame_idx, row_number() OVER (PARTITION BY episode ORDER BY speed, frame_idx) AS rn FROM f WHERE speed <> 0), t AS (SELECT episode, max(num_frames) AS n FROM f GROUP BY episode HAVING count(*) FILTER (speed <> 0) = 0)
 SELECT episode, frame_idx FROM r WHERE rn <= 4 UNION ALL SELECT episode, (i * greatest(1, n // 4))::INT FROM t, range(4) g(i) WHERE i * greatest(1, n // 4) < n"""),
    "pinch_minima": (lambda s, d: C.minima(_frames(s, d)).select(*KEYS, R6("pinch")), f"WITH {_CUES} SELECT episode, frame_idx, round(pinch, 6) AS pinch FROM minima"),
    "pinch_minima_flat": (lambda s, d: C.minima(_frames(s, d), segmented=False).select(*KEYS, R6("pinch")), f"WITH {_CUES.replace('frame_idx - row_number() OVER (PARTITION BY episode ORDER BY frame_idx) AS seg', '0 AS seg')} SELECT episode, frame_idx, round(pinch, 6) AS pinch FROM minima"),
    "minima_neighbors": (lambda s, d: C.with_neighbors(C.minima(_frames(s, d)), T.episodes(s, d).select("episode", "num_frames")), f"WITH {_CUES} SELECT episode, frame_idx FROM near"),
    "pinch_percentile": (lambda s, d: C.below_percentile(_frames(s, d)).select(*KEYS, R6("pinch")), f"WITH {FRAMES}, c AS (SELECT episode, quantile_cont(pinch, 0.15) AS cut FROM frames WHERE detected GROUP BY episode) SELECT episode, frame_idx, round(pinch, 6) AS pinch FROM frames JOIN c USING (episode) WHERE detected AND pinch < cut"),
    "merge_cues": (lambda s, d: _cues(s, d).withColumn("m", E("slice(array_distinct(concat(speed_list, pinch_list)), 1, 12)")).select("episode", _text("m", "merged")), f"WITH {_CUES} SELECT episode, array_to_string((speed_list || list_filter(pinch_list, lambda f: NOT list_contains(speed_list, f)))[1:12], ',') AS merged FROM cues"),
    "mode_candidates": (lambda s, d: _modes(s, d).select("episode", "mode", _text("candidates"), _text("fallback")), f"WITH {_MODES} SELECT episode, mode, array_to_string(candidates, ',') AS candidates, array_to_string(fallback, ',') AS fallback FROM modes"),
    "mode_pinch_pool": (lambda s, d: _picks(s, d).join(_cues(s, d).drop("num_frames"), "episode").select("episode", F.size(E("filter(pinch_list, f -> f > frame_idx)")).alias("after_n"), F.size(E("filter(pinch_list, f -> f <> frame_idx)")).alias("other_n"), E("num_frames - frame_idx - 1").alias("pool_after"), E("num_frames - 1").alias("pool_other")),
        f"WITH {_CUES}, {_PICKS} SELECT episode, len(list_filter(pinch_list, lambda f: f > frame_idx))::INT AS after_n, len(list_filter(pinch_list, lambda f: f <> frame_idx))::INT AS other_n, picks.num_frames - frame_idx - 1 AS pool_after, picks.num_frames - 1 AS pool_other FROM picks JOIN cues USING (episode)"),
    "consecutive_grid": (lambda s, d: _grid(s, d).select("episode", "mode", "center", "start"), f"WITH {_GRID} SELECT episode, mode, center, start FROM grid"),
    "grid_min_index": (lambda s, d: C.consecutive_grid(_modes(s, d).join(_picks(s, d).select("episode", F.col("frame_idx").alias("ref")), "episode"), min_index="ref").select("episode", "mode", "start", "relaxed"),
        f"WITH {_GRID}, {_PICKS} SELECT episode, mode, CASE WHEN frame_idx + 1 > grid.num_frames - 9 THEN start ELSE greatest(start, frame_idx + 1) END::INT AS start, frame_idx + 1 > grid.num_frames - 9 AS relaxed FROM grid JOIN picks USING (episode)"),
    "grid_recall": (lambda s, d: C.grid_recall(_grid(s, d), T.truths(s, d)).select("episode", "mode", "task", "start", "gt", "distance", "recall"),
        f"WITH {_GRID}, {TRUTHS} SELECT g.episode, mode, task, start, gt, greatest(0, start - gt, gt - (start + 8))::INT AS distance, greatest(0, start - gt, gt - (start + 8)) = 0 AS recall FROM grid g JOIN truths USING (episode)"),
    "anchor_filter": (lambda s, d: C.anchor_filter(_modes(s, d), "start").select("episode", "mode", _text("kept")), f"WITH {_MODES} SELECT episode, mode, array_to_string(list_sort(list_filter(candidates, lambda f: {_HALF}) || list_filter(pool, lambda f: {_HALF} AND NOT list_contains(candidates, f))[1:greatest(0, 9 - len(list_filter(candidates, lambda f: {_HALF})))]), ',') AS kept FROM modes"),
    "direct_grid": (lambda s, d: C.direct_grid(_modes(s, d), "start").select("episode", "mode", _text("grid")), f"WITH {_DIRECT}"),
    "time_grid": (lambda s, d: _picks(s, d).select("episode", F.array_join(E("transform(sequence(-4, 4), i -> cast(greatest(0, least(frame_idx + i * 3, num_frames - 1)) as string))"), ",").alias("frames")), f"WITH {FRAMES}, {_PICKS} SELECT episode, array_to_string([greatest(0, least(frame_idx + i * 3, num_frames - 1)) FOR i IN range(-4, 5)], ',') AS frames FROM picks"),
    "iqr_cut": (lambda s, d: (lambda f: f.join(f.where(C.usable()).groupBy("episode").agg(F.greatest(E("percentile(speed, 0.75) + 2D * (percentile(speed, 0.75) - percentile(speed, 0.25))"), E("percentile(speed, 0.95)")).alias("cut")), "episode").where("speed > 0 and speed < cut").select(*KEYS, R6("speed")))(_frames(s, d)),
        f"WITH {FRAMES}, c AS (SELECT episode, greatest(quantile_cont(speed, 0.75) + 2 * (quantile_cont(speed, 0.75) - quantile_cont(speed, 0.25)), quantile_cont(speed, 0.95)) AS cut FROM frames WHERE speed <> 0 GROUP BY episode) SELECT episode, frame_idx, round(speed, 6) AS speed FROM frames JOIN c USING (episode) WHERE speed > 0 AND speed < cut"),
    "greedy_spacing": (lambda s, d: C.greedy_spacing(_frames(s, d).where(C.usable()), 5).select("episode", _text("kept")), f"""WITH RECURSIVE {FRAMES}, o AS (SELECT episode, list(frame_idx ORDER BY speed, frame_idx) AS o FROM frames WHERE speed <> 0 GROUP BY episode),
 k AS (SELECT episode, o, 1 AS i, []::INT[] AS kept FROM o UNION ALL SELECT episode, o, i + 1, CASE WHEN len(list_filter(kept, lambda g: abs(g - o[i]) < 5)) > 0 THEN kept ELSE list_append(kept, o[i]) END FROM k WHERE i <= len(o))
 SELECT episode, array_to_string(kept, ',') AS kept FROM k WHERE i = len(o) + 1"""),
    "inv_speed_prob": (lambda s, d: _frames(s, d).where(C.usable()).withColumn("w", E("1 / (speed + 1e-8D)")).withColumn("p", E("w / sum(w) over (partition by episode)")).select(*KEYS, F.round("p", 9).alias("p")), f"WITH {FRAMES}, w AS (SELECT episode, frame_idx, 1 / (speed + 1e-8::DOUBLE) AS w FROM frames WHERE speed <> 0) SELECT episode, frame_idx, round(w / sum(w) OVER (PARTITION BY episode), 9) AS p FROM w"),
    "pair_events": (lambda s, d: C.pair_events(_events(s, d)), f"WITH {_PAIRS} SELECT episode, contact, separation FROM pairs WHERE contact IS NOT NULL AND separation IS NOT NULL"),
    "pair_events_short": (lambda s, d: C.pair_events(_events(s, d), short=True), f"WITH {_PAIRS} SELECT episode, contact, separation FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY separation - contact DESC, contact) AS rn FROM pairs WHERE contact IS NOT NULL AND separation IS NOT NULL) WHERE rn = 1"),
    "speed_gate": (lambda s, d: C.speed_gate(_frames(s, d), _picks(s, d)).select(*KEYS, "accepted"), f"""WITH {FRAMES}, {_PICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY speed, frame_idx) AS rank, count(*) OVER (PARTITION BY episode) AS n FROM frames WHERE speed <> 0),
 c AS (SELECT episode, speed AS cut FROM r WHERE rank = greatest(1, floor(0.3::DOUBLE * n))) SELECT p.episode, p.frame_idx, coalesce(f.speed <= cut, false) AS accepted FROM picks p JOIN frames f USING (episode, frame_idx) LEFT JOIN c ON c.episode = p.episode"""),
    "speed_gate_3d": (lambda s, d: C.speed_gate(_frames(s, d), _picks(s, d), zero_based=True).select(*KEYS, "accepted"), f"""WITH {FRAMES}, {_PICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY speed, frame_idx) AS rank, count(*) OVER (PARTITION BY episode) AS n FROM frames WHERE speed <> 0),
 c AS (SELECT episode, speed AS cut FROM r WHERE rank = floor(0.3::DOUBLE * n) + 1) SELECT p.episode, p.frame_idx, coalesce(f.speed <= cut, false) AS accepted FROM picks p JOIN frames f USING (episode, frame_idx) LEFT JOIN c ON c.episode = p.episode"""),
    "state_gate": (lambda s, d: _picks(s, d).select("episode", "frame_idx", E("startswith(trim(if(episode % 3 = 0, ' 1 yes', 'no')), '1') or frame_idx > num_frames - 5").alias("accepted")), f"WITH {FRAMES}, {_PICKS} SELECT episode, frame_idx, episode % 3 = 0 OR frame_idx > num_frames - 5 AS accepted FROM picks"),
    "cue_coverage": (lambda s, d: C.cue_coverage(_grid(s, d)), f"""WITH {_GRID}, u AS (SELECT *, list_filter(range(start, start + 9)::INT[], lambda f: list_contains(speed_list, f)) AS s, list_filter(range(start, start + 9)::INT[], lambda f: list_contains(pinch_list, f)) AS p FROM grid)
 SELECT episode, mode, len(s)::INT AS speed_n, len(list_filter(p, lambda f: NOT list_contains(s, f)))::INT AS pinch_n, (9 - len(s) - len(list_filter(p, lambda f: NOT list_contains(s, f))))::INT AS neutral_n, len(list_filter(p, lambda f: list_contains(s, f)))::INT AS overlap_n FROM u"""),
    "feedback_candidates": (lambda s, d: C.feedback_candidates(_picks(s, d), _frames(s, d)).select("episode", "rejected", "frame_idx", F.round("p", 9).alias("p")), f"""WITH {FRAMES}, {_PICKS}, n AS (SELECT p.episode, p.frame_idx AS rejected, f.frame_idx, 1 / (f.speed + 1e-8::DOUBLE) AS w FROM picks p JOIN frames f ON f.episode = p.episode AND abs(f.frame_idx - p.frame_idx) BETWEEN 1 AND 3)
 SELECT episode, rejected, frame_idx, round(w / sum(w) OVER (PARTITION BY episode), 9) AS p FROM n"""),
}
