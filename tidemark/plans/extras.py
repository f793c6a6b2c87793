"""Queries over signal variants, draws, loaders, answers and checks, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import audit as A
from tidemark.operators import candidates as C
from tidemark.operators import feedback as K
from tidemark.operators import kernels as N
from tidemark.operators import resampling as B
from tidemark.operators import signals as S
from tidemark.plans import reports as Q
from tidemark.plans import series as V
from tidemark.plans.audits import resamples_sql, rounded
from tidemark.plans.ctes import EPISODES, FRAMES, GRID_ROWS, HANDS, drawn
from tidemark.sources import datasets as D
from tidemark.sources import store as O
from tidemark.sources import tables as T

E = F.expr
KEYS = ("episode", "frame_idx")
_LIST = "array_to_string({}, ',')"


def _after(s, d):
    """Cue lists with a rejection for each mode and flag."""
    picks = V._picks(s, d).select("episode", F.col("frame_idx").alias("ref")).join(T.frames(s, d).select("episode", F.col("frame_idx").alias("ref"), F.col("speed").alias("ref_speed")), ["episode", "ref"])
    rows = V._cues(s, d).join(picks, "episode").withColumn("flag", E("element_at(array('feedback', 'speed', 'fault'), cast(episode % 3 + 1 as int))"))
    return rows.withColumn("mode", F.explode(E("array('speed', 'pinch', 'speed_pinch')")))


_AFTER = V._CUES + f""", {V._PICKS}, speeds AS (SELECT episode, list(speed ORDER BY speed, frame_idx) AS ranked_speeds FROM frames WHERE speed <> 0 GROUP BY episode),
 rej AS (SELECT c.*, coalesce(ranked_speeds, []) AS ranked_speeds, p.frame_idx AS ref, f.speed AS ref_speed, CASE c.episode % 3 WHEN 0 THEN 'feedback' WHEN 1 THEN 'speed' ELSE 'fault' END AS flag, mode
 FROM cues c JOIN picks p USING (episode) JOIN frames f ON f.episode = p.episode AND f.frame_idx = p.frame_idx LEFT JOIN speeds s ON s.episode = c.episode, (VALUES ('speed'), ('pinch'), ('speed_pinch')) v(mode)),
 al AS (SELECT *, CASE flag WHEN 'feedback' THEN list_filter(ranked, lambda f: f > ref) WHEN 'speed' THEN ranked[1:len(list_filter(ranked_speeds, lambda x: x < ref_speed))] ELSE list_filter(ranked, lambda f: f <> ref) END AS allowed FROM rej)"""

_KERNEL = "k AS (SELECT i, exp(-0.5::DOUBLE * (i / {sigma}::DOUBLE) ** 2) AS w FROM range(-{radius}, {radius} + 1) r(i)), kn AS (SELECT i, w / sum(w) OVER () AS w FROM k)"


def _smooth_sql(source: str, sigma: int) -> str:
    """Gaussian sums over source(episode, pos, n, speed) with a reflected border, pos from 0."""
    return _KERNEL.format(sigma=sigma, radius=4 * sigma) + f""", pl AS (SELECT s.episode, s.pos, w, (((s.pos + i) % (2 * s.n)) + 2 * s.n) % (2 * s.n) AS j, s.n FROM {source} s, kn),
 sm AS (SELECT pl.episode, pl.pos, sum(w * o.speed) AS smooth FROM pl JOIN {source} o ON o.episode = pl.episode AND o.pos = CASE WHEN j < pl.n THEN j ELSE 2 * pl.n - 1 - j END GROUP BY 1, 2)"""


def _lines(s, d):
    """Labelled rows as JSON lines, labels nested in every second one, gt_cell or cell_number in every third."""
    own = "'video_source', source, 'video_index', group_id, 'gt_frame', gt_frame, if(sample % 3 = 0, 'cell_number', 'gt_cell'), gt_cell, 'frame_indices', frame_indices"
    nested = "named_struct('file_name', concat(sample, '.png'), 'prompt', concat('which ', sample), 'metadata', {})"
    flat = "named_struct('file_name', concat(sample, '.png'), 'prompt', concat('which ', sample), {})"
    labels = [own.replace("if(sample % 3 = 0, 'cell_number', 'gt_cell')", f"'{n}'") for n in ("cell_number", "gt_cell")]
    pick = lambda form: f"if(sample % 3 = 0, to_json({form.format(form_labels(labels[0], form))}), to_json({form.format(form_labels(labels[1], form))}))"
    form_labels = lambda x, form: f"named_struct({x})" if "metadata" in form else x
    return T.grid_rows(s, d).select("sample", E("if(sample % 5 = 0, 'validation', 'train')").alias("split"), E(f"if(sample % 2 = 0, {pick(nested)}, {pick(flat)})").alias("value"))


def _meta(s, d):
    """Signal metadata with planted faults."""
    return T.episodes(s, d).selectExpr("episode", "num_frames", "if(episode % 7 = 0, 1, 2) as schema_version", "num_frames + if(episode % 5 = 0, 1, 0) as total_frames", "if(episode % 11 = 0, null, 'per_frame') as speed", "if(episode % 13 = 0, 'minima', 'segment_minima') as pinch")


def _configs(s, d):
    """Config snapshots with planted faults, and the digest that each run was stored under."""
    c = "named_struct('adapter', named_struct('alpha', if(event_id % 17 = 0, 8, 32), 'merged', event_id % 19 = 0, 'rank', 16), 'backend', if(event_id % 5 = 0, 'dry', 'nf4'), 'grid', named_struct('midpoint_restriction', event_id % 7 = 0, 'topology', 'consecutive'), 'negative_option', if(event_id % 11 = 0, 0, -1))"
    return T.table(s, d, "events").selectExpr("event_id", f"{c} as config", "'nf4' as backend").withColumn("stored", F.sha2(F.concat(F.to_json("config"), E("if(event_id % 13 = 0, ' ', '')")), 256))


#: Rules for one config snapshot: what must hold in every run of a protocol.
CONFIG = {
    "hash": "sha2(to_json(config), 256) <> stored",
    "backend": "not config.backend <=> backend",
    "grid": "not (config.grid.topology <=> 'consecutive' and config.grid.midpoint_restriction <=> false)",
    "negative_option": "not config.negative_option <=> -1",
    "adapter": "not (config.adapter.rank <=> 16 and config.adapter.alpha <=> 32 and config.adapter.merged <=> false)",
}
METADATA = {"schema_version": "not schema_version <=> 2", "total_frames": "not total_frames <=> num_frames", "speed": "not speed <=> 'per_frame'", "pinch": "not pinch <=> 'segment_minima'"}


def _clouds(s, d):
    points = "transform(sequence(0, 19), i -> transform(array(embedding[3 * i], embedding[3 * i + 1], embedding[3 * i + 2]), x -> cast(x as double)))"
    return T.table(s, d, "embeddings").selectExpr("vec_id div 10 as episode", "cast(vec_id % 10 as int) as frame_idx", f"{points} as points", "transform(slice(embedding, 1, 3), x -> cast(x as double)) as p")


def _contents(s, d):
    forms = "case conv_id % 5 when 0 then to_json(named_struct('content', named_struct('text', named_struct('value', text)))) when 1 then concat('[', to_json(named_struct('type', 'text', 'text', text)), ', \"!\", null, 7]') when 2 then text when 3 then 'null' else to_json(array(named_struct('value', text), named_struct('value', role))) end"
    return T.table(s, d, "conversations").selectExpr("conv_id", "turn", f"{forms} as content")


def _conversion(s, d):
    prior = T.episodes(s, d).selectExpr("episode", "episode % 3 = 0 as there", "episode % 4 > 0 as output_valid", "episode % 5 > 0 as source_valid", "contact is null or separation is null or separation >= contact as labels_valid")
    return A.conversion(prior)


def _annotations(s, d):
    content = "case page_id % 5 when 0 then concat('{\"a\": 1, \"b\": [', page_id, ']}') when 1 then concat('[{\"k\": ', page_id, '}, 2]') when 2 then concat('{\"x\": 1}\\n\\n{\"y\": ', page_id, '}\\n') when 3 then 'p,q\\n1,2\\n3,4\\n' else '{broken' end"
    return T.table(s, d, "pages").selectExpr("concat('f', page_id, element_at(array('.json', '.json', '.jsonl', '.csv', '.json'), cast(page_id % 5 + 1 as int))) as path", f"cast({content} as binary) as content", "length(html) as size_bytes")


def _both(s, d):
    return Q._pairs(s, d).withColumn("a", E("if(episode % 29 = 0, double('nan'), a)"))


QUERIES = {
    "shared_pass": (lambda s, d: S.shared_pass(T.hands(s, d), 0.0, 10).select("video", "status", *(F.round(c, 6).alias(c) for c in ("x", "y", "pinch")), F.col("pinch_hand").cast("double").alias("pinch_hand")), f"""WITH {HANDS}, g AS (SELECT *, list_filter(kp, lambda p: p.conf > 0) AS good FROM hands), v AS (SELECT * FROM g WHERE len(good) >= 10),
 c AS (SELECT video, list_avg([p.x FOR p IN good]) AS x, list_avg([p.y FOR p IN good]) AS y, row_number() OVER (PARTITION BY video ORDER BY list_avg([p.conf FOR p IN good]) DESC, hand) AS rn FROM v),
 q AS (SELECT video, sqrt((kp[5].x - kp[9].x) ** 2 + (kp[5].y - kp[9].y) ** 2) AS pinch, hand FROM v), b AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY pinch, hand) AS rn FROM q)
 SELECT h.video, CASE WHEN c.video IS NULL THEN 'no_valid_hand_keypoints' ELSE 'detected' END AS status, round(x, 6) AS x, round(y, 6) AS y, round(pinch, 6) AS pinch, b.hand::DOUBLE AS pinch_hand FROM (SELECT DISTINCT video FROM hands) h LEFT JOIN c ON c.video = h.video AND c.rn = 1 LEFT JOIN b ON b.video = h.video AND b.rn = 1"""),
    "loss_curve": (lambda s, d: S.curve(T.table(s, d, "events").selectExpr("event_id", "event_id / 100 as epoch", "if(event_type = 'error', null, value) as loss").select("epoch", "loss"), "loss"), "SELECT event_id / 100 AS epoch, value FROM events WHERE event_type <> 'error'"),
    "shifted_track": (lambda s, d: S.shifted(T.frames(s, d).select(*KEYS, "x"), 1), f"WITH {FRAMES} SELECT episode, frame_idx + 1 AS frame_idx, x FROM frames"),
    "registered_wrists": (lambda s, d: N.registered(_clouds(s, d).select(*KEYS, "points"), _clouds(s, d).select(*KEYS, "p"), 0.5), None),
    "nearest_blobs": (lambda s, d: N.blobs_by_tensor(T.table(s, d, "embeddings").selectExpr("vec_id", "transform(embedding, x -> cast(x as double)) as inv"), 8, 15.0, 2), None),
    "smoothed_speed": (lambda s, d: N.smoothed_by_episode(T.frames(s, d), 5.0).select(*KEYS, F.round("smooth", 6).alias("smooth")), f"WITH {FRAMES}, src AS (SELECT episode, frame_idx AS pos, num_frames AS n, speed FROM frames), {_smooth_sql('src', 5)} SELECT episode, pos::INT AS frame_idx, round(smooth, 6) AS smooth FROM sm"),
    "clipped_speed": (lambda s, d: N.smoothed_by_episode(T.frames(s, d), 2.0, 80.0).select(*KEYS, F.round("smooth", 6).alias("smooth")), f"""WITH {FRAMES}, nz AS (SELECT episode, frame_idx, least(speed, 80) AS speed, row_number() OVER (PARTITION BY episode ORDER BY frame_idx) - 1 AS pos, count(*) OVER (PARTITION BY episode) AS n FROM frames WHERE speed <> 0), src AS (SELECT * FROM nz WHERE n > 3), {_smooth_sql('src', 2)}
 SELECT f.episode, f.frame_idx, round(coalesce(sm.smooth, least(f.speed, 80)), 6) AS smooth FROM frames f LEFT JOIN nz ON nz.episode = f.episode AND nz.frame_idx = f.frame_idx LEFT JOIN sm ON sm.episode = nz.episode AND sm.pos = nz.pos"""),
    "bare_candidates": (lambda s, d: C.bare_candidates(_after(s, d)).select("episode", "mode", V._text("candidates"), V._text("invalid"), F.size("pool").alias("pool_n")), f"""WITH {_AFTER} SELECT episode, mode, array_to_string(CASE mode WHEN 'speed' THEN allowed[1:4] WHEN 'pinch' THEN pinch_list ELSE allowed[1:4] || list_filter(pinch_list, lambda f: NOT list_contains(allowed[1:4], f)) END, ',') AS candidates,
 array_to_string(CASE WHEN mode <> 'pinch' THEN list_sort(list_filter(ranked, lambda f: NOT list_contains(allowed, f))) WHEN flag = 'fault' THEN [ref] ELSE [] END, ',') AS invalid, CASE WHEN mode = 'pinch' THEN num_frames ELSE len(allowed) END::INT AS pool_n FROM al"""),
    "candidates_after": (lambda s, d: C.mode_candidates_after(_after(s, d)).select("episode", "mode", V._text("candidates"), V._text("fallback")), f"""WITH {_AFTER}, pi AS (SELECT *, CASE flag WHEN 'feedback' THEN list_filter(pinch_list, lambda f: f > ref) WHEN 'speed' THEN pinch_list ELSE list_filter(pinch_list, lambda f: f <> ref) END AS pl, CASE WHEN mode <> 'pinch' THEN allowed
 WHEN flag = 'feedback' THEN range(ref + 1, num_frames)::INT[] WHEN flag = 'speed' THEN range(num_frames)::INT[] ELSE list_filter(range(num_frames)::INT[], lambda f: f <> ref) END AS pool FROM al),
 cu AS (SELECT *, CASE mode WHEN 'speed' THEN allowed[1:4] WHEN 'pinch' THEN pl ELSE allowed[1:4] || list_filter(pl, lambda f: NOT list_contains(allowed[1:4], f)) END AS c FROM pi),
 fi AS (SELECT *, list_filter(pool, lambda f: NOT list_contains(c, f))[1:greatest(0, 4 - len(c))] AS fb FROM cu) SELECT episode, mode, array_to_string(CASE WHEN len(c) + len(fb) = 0 THEN (range(num_frames)::INT[])[1:4] ELSE c || fb END, ',') AS candidates, array_to_string(CASE WHEN len(c) + len(fb) = 0 THEN (range(num_frames)::INT[])[1:4] ELSE fb END, ',') AS fallback FROM fi"""),
    "near_average": (lambda s, d: C.walk_grid(V._cues(s, d).join(V._picks(s, d).select("episode", F.col("frame_idx").alias("ref")), "episode").withColumn("invalid", E("filter(ranked, f -> f <= ref)")), "speed_list").select("episode", "average", V._text("grid"), "at"), f"""WITH {V._CUES}, {V._PICKS}, a AS (SELECT c.episode, c.num_frames, round_even(list_avg(speed_list), 0)::INT AS average, list_filter(ranked, lambda f: f <= frame_idx) AS invalid FROM cues c JOIN picks USING (episode)),
 f AS (SELECT episode, average, f, row_number() OVER (PARTITION BY episode ORDER BY abs(f - average), f) AS rn FROM (SELECT *, unnest(range(num_frames)::INT[]) AS f FROM a) WHERE average IS NOT NULL AND NOT list_contains(invalid, f)),
 g AS (SELECT episode, list(f ORDER BY f) AS g FROM f WHERE rn <= 9 GROUP BY 1) SELECT a.episode, average, array_to_string(coalesce(g, []), ',') AS grid, greatest(0, coalesce(list_position(g, average), 0) - 1)::INT AS at FROM a LEFT JOIN g USING (episode)"""),
    "minima_by_type": (lambda s, d: N.minima_by_type(T.frames(s, d).withColumn("video_type", E("if(episode % 3 = 0, 'short', 'long')")).withColumn("use_depth", E("episode % 3 = 1"))), None),
    "minima_around": (lambda s, d: C.around_minima(T.frames(s, d).where(C.usable()), C.minima(T.frames(s, d))).select("episode", "minimum", "frame_idx", F.round("p", 9).alias("p")), f"""WITH {V._CUES}, u AS (SELECT episode, frame_idx, speed, row_number() OVER (PARTITION BY episode ORDER BY frame_idx) AS pos FROM frames WHERE speed <> 0),
 n AS (SELECT m.episode, m.frame_idx AS minimum, o.frame_idx, 1 / (o.speed + 1e-8::DOUBLE) AS w FROM minima m JOIN u USING (episode, frame_idx) JOIN u o ON o.episode = u.episode AND abs(o.pos - u.pos) <= 2) SELECT episode, minimum, frame_idx, round(w / sum(w) OVER (PARTITION BY episode, minimum), 9) AS p FROM n"""),
    "minima_around_draw": (lambda s, d: K.weighted_draw(C.around_minima(T.frames(s, d).where(C.usable()), C.minima(T.frames(s, d))).withColumn("g", F.concat_ws("|", "episode", "minimum")), "g", "speed", 7),
        f"""WITH {V._CUES}, u AS (SELECT episode, frame_idx, speed, row_number() OVER (PARTITION BY episode ORDER BY frame_idx) AS pos FROM frames WHERE speed <> 0),
 n AS (SELECT concat_ws('|', m.episode, m.frame_idx) AS g, o.frame_idx, o.speed FROM minima m JOIN u USING (episode, frame_idx) JOIN u o ON o.episode = u.episode AND abs(o.pos - u.pos) <= 2) SELECT g, {drawn('g', 'speed', 7)} AS frame_idx FROM n GROUP BY g"""),
    "speed_gate_by_length": (lambda s, d: C.speed_gate_by_length(T.frames(s, d), V._picks(s, d)).select(*KEYS, "accepted"), f"""WITH {FRAMES}, {V._PICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY speed, frame_idx) AS rank FROM frames WHERE speed <> 0),
 c AS (SELECT episode, speed AS cut FROM r WHERE rank = greatest(1, floor(0.3::DOUBLE * num_frames))) SELECT p.episode, p.frame_idx, coalesce(f.speed <= cut AND f.speed <> 0, false) AS accepted FROM picks p JOIN frames f USING (episode, frame_idx) LEFT JOIN c ON c.episode = p.episode"""),
    "feedback_draw": (lambda s, d: K.weighted_draw(C.feedback_candidates(V._picks(s, d), T.frames(s, d)).withColumn("speed", F.coalesce("speed", F.lit(9999.0))), "episode", "speed", 11),
        f"WITH {FRAMES}, {V._PICKS}, n AS (SELECT p.episode, f.frame_idx, f.speed FROM picks p JOIN frames f ON f.episode = p.episode AND abs(f.frame_idx - p.frame_idx) BETWEEN 1 AND 3) SELECT episode, {drawn('episode', 'speed', 11)} AS frame_idx FROM n GROUP BY episode"),
    "weighted_reward": (lambda s, d: Q._scored(s, d).selectExpr("sample", "reward as cell_reward", "if(parsed, 1D, 0D) as parse_reward", "if(sample % 4 = 0, null, 0.5D) as extra").select("sample", F.round(X.weighted_reward("cell_reward", "parse_reward", "extra", weights=(1.0, 0.25, 0.5)), 9).alias("reward")), f"WITH {Q.SCORED} SELECT sample, round(reward + CASE WHEN parsed THEN 0.25 ELSE 0 END + CASE WHEN sample % 4 = 0 THEN 0 ELSE 0.25 END, 9) AS reward FROM scored"),
    "paired_bootstrap": (lambda s, d: rounded(B.paired_bootstrap(_both(s, d), "task", "a", "b", ["episode"], 20260908, 100), "task"),
        f"WITH {Q.PAIRS}, pf AS (SELECT task, episode, difference FROM pe WHERE episode % 29 <> 0), {resamples_sql('pf', 'task', 'difference', ['episode'], 20260908, 100)}, m AS (SELECT task, avg(difference) AS difference, count(*) AS n FROM pf GROUP BY task) SELECT task, round(difference, 9) AS difference, n, round(low, 9) AS low, round(high, 9) AS high FROM m JOIN ends USING (task)"),
    "signal_metadata_check": (lambda s, d: A.violations(_meta(s, d), "episode", METADATA), f"WITH {EPISODES} SELECT episode, 'schema_version' AS rule FROM episodes WHERE episode % 7 = 0 UNION ALL SELECT episode, 'total_frames' FROM episodes WHERE episode % 5 = 0 UNION ALL SELECT episode, 'speed' FROM episodes WHERE episode % 11 = 0 UNION ALL SELECT episode, 'pinch' FROM episodes WHERE episode % 13 = 0"),
    "config_check": (lambda s, d: A.violations(_configs(s, d), "event_id", CONFIG), "SELECT event_id, 'hash' AS rule FROM events WHERE event_id % 13 = 0 UNION ALL SELECT event_id, 'backend' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'grid' FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 'negative_option' FROM events WHERE event_id % 11 = 0 UNION ALL SELECT event_id, 'adapter' FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0"),
    "sample_ids": (lambda s, d: T.grid_rows(s, d).select("sample", O.sample_id(F.col("task"), F.lit("grid"), {"file_name": E("concat(sample, '.png')"), "prompt": E("concat('say \"', sample, '\"')"), "video_source": F.col("source"), "video_index": F.col("group_id"), "gt_frame": F.col("gt_frame"), "gt_cell": F.col("gt_cell"), "frame_indices": F.col("frame_indices"), "offset": E("if(sample % 2 = 0, null, sample)")}).alias("sample_id")), f"""WITH {GRID_ROWS} SELECT sample, sha256('{{"dataset_name":"grid","file_name":"' || sample || '.png","frame_indices":[' || array_to_string(frame_indices, ',') || '],"gt_cell":' || gt_cell || ',"gt_frame":' || gt_frame || ',"offset":' || CASE WHEN sample % 2 = 0 THEN 'null' ELSE sample::VARCHAR END
 || ',"prompt":"say \\"' || sample || '\\"","task":"' || task || '","video_index":' || group_id || ',"video_source":"' || source || '"}}') AS sample_id FROM grid_rows"""),
    "task_rows": (lambda s, d: D.grid_metadata(_lines(s, d), "contact", "/data/contact").select("split", "image", "prompt", "task", "video_source", "video_index", "gt_frame", "cell_number", V._text("frame_indices"), "answer"), f"WITH {GRID_ROWS} SELECT CASE WHEN sample % 5 = 0 THEN 'validation' ELSE 'train' END AS split, '/data/contact/' || sample || '.png' AS image, 'which ' || sample AS prompt, 'contact' AS task, source AS video_source, group_id::INT AS video_index, gt_frame, gt_cell AS cell_number, array_to_string(frame_indices, ',') AS frame_indices, '{{\"points\": [' || gt_cell || ']}}' AS answer FROM grid_rows"),
    "split_counts": (lambda s, d: D.grid_metadata(_lines(s, d), "contact", "/data/contact").groupBy("split", "video_source").agg(F.count("*").alias("n"), F.countDistinct("video_index").alias("videos")), f"WITH {GRID_ROWS} SELECT CASE WHEN sample % 5 = 0 THEN 'validation' ELSE 'train' END AS split, source AS video_source, count(*) AS n, count(DISTINCT group_id) AS videos FROM grid_rows GROUP BY 1, 2"),
    "parse_point_many": (lambda s, d: T.completions(s, d).select("id", X.parse_point_many("completion").alias("p")).select("id", "p.point", "p.many"), f"""WITH {Q.COMPLETIONS}, c AS (SELECT id, regexp_extract(replace(replace(completion, ' ', ''), chr(10), ''), '\\{{"points":\\[([^\\]}}]*)', 1) AS block FROM completions) SELECT id, coalesce(nullif(regexp_extract(block, '^(-?[0-9]+)', 1), '')::INT, -1) AS point, contains(block, ',') AS many FROM c"""),
    "content_text": (lambda s, d: _contents(s, d).select("conv_id", "turn", F.sha2(X.content_text("content"), 256).alias("digest")), "SELECT conv_id, turn, sha256(CASE conv_id % 5 WHEN 0 THEN text WHEN 1 THEN text || '!7' WHEN 2 THEN text WHEN 3 THEN '' ELSE text || role END) AS digest FROM conversations"),
    "conversational_prompts": (lambda s, d: T.grid_rows(s, d).withColumn("prompt", E("concat('which ', sample)")).select("sample", F.to_json(X.conversational("prompt")).alias("prompt")), f"""WITH {GRID_ROWS} SELECT sample, '[{{"role":"user","content":[{{"type":"image"}},{{"type":"text","text":"which ' || sample || '"}}]}}]' AS prompt FROM grid_rows"""),
    "conversion_status": (lambda s, d: _conversion(s, d), f"WITH {EPISODES} SELECT episode, CASE WHEN separation < contact OR episode % 5 = 0 OR (episode % 3 = 0 AND episode % 4 = 0) THEN 'error' WHEN episode % 3 = 0 THEN 'reused' ELSE 'converted' END AS status, CASE WHEN separation < contact THEN 'labels' WHEN episode % 5 = 0 THEN 'source' WHEN episode % 3 = 0 AND episode % 4 = 0 THEN 'output' END AS error FROM episodes"),
    "annotation_summary": (lambda s, d: D.annotation_summary(_annotations(s, d)).select("path", "readable", "kind", "top_keys", F.col("num_items").cast("double").alias("num_items")), """SELECT 'f' || page_id || ['.json', '.json', '.jsonl', '.csv', '.json'][(page_id % 5)::INT + 1] AS path, page_id % 5 < 4 AS readable, ['dict', 'list', 'jsonl', 'csv', ''][(page_id % 5)::INT + 1] AS kind, ['a,b', 'k', 'x', 'p,q', ''][(page_id % 5)::INT + 1] AS top_keys, CASE WHEN page_id % 5 < 4 THEN 2 END::DOUBLE AS num_items FROM pages"""),
}
