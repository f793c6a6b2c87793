"""Validation, closed-loop and NumPy-backed queries; those that SQL cannot express have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit as A
from tidemark.operators import candidates as C
from tidemark.operators import feedback as K
from tidemark.operators import kernels as N
from tidemark.operators import relations as R
from tidemark.operators import resampling as B
from tidemark.operators import statistics as P
from tidemark.plans import localize as L
from tidemark.plans import reports as Q
from tidemark.plans import series as S
from tidemark.plans.ctes import EPISODES, FILES, FRAMES, TRIALS, TRUTHS, drawn
from tidemark.sources import tables as T
from tidemark.sources.stages import stored

E = F.expr


def _labels(s, d):
    return T.episodes(s, d).selectExpr("episode", "100 + 100 * episode as start_frame", "100 + 100 * episode + num_frames - 1 + if(episode % 10 = 0, 1, 0) as end_frame", "num_frames", "contact as contact_local", "separation as separate_local",
        "if(episode % 19 = 0, null, 100 + 100 * episode + contact + if(episode % 12 = 0, 1, 0)) as contact_global")


_LABELS = EPISODES + """, la AS (SELECT episode, 100 + 100 * episode AS s, 100 + 100 * episode + num_frames - 1 + CASE WHEN episode % 10 = 0 THEN 1 ELSE 0 END AS e, num_frames AS n, contact AS c, separation AS p,
 CASE WHEN episode % 19 = 0 THEN NULL ELSE 100 + 100 * episode + contact + CASE WHEN episode % 12 = 0 THEN 1 ELSE 0 END END AS g FROM episodes)"""


def _cut(s, d):
    """Frames with planted faults: some missing, some twice, some beyond the end, some values wrong."""
    f = T.frames(s, d).selectExpr("episode", "frame_idx", "case when frame_idx % 31 = 5 then -1D when frame_idx % 37 = 6 then cast('nan' as double) else speed end as speed")
    return f.where("frame_idx % 29 <> 3").unionAll(f.where("frame_idx % 41 = 7")).unionAll(f.where("frame_idx = 0").selectExpr("episode", "frame_idx + 5000", "speed"))


def _traces(s, d):
    used = "case when event_id % 7 = 0 then sequence(start, start + 7) when event_id % 11 = 0 then array(start) when event_id % 13 = 0 then array_repeat(start, 9) when event_id % 17 = 0 then transform(sequence(0, 8), i -> start + 2 * i) else sequence(start, start + 8) end"
    rows = T.trials(s, d).join(T.episodes(s, d).select("episode", "num_frames"), "episode").withColumn("start", E("cast(event_id % num_frames as int)"))
    return rows.selectExpr("event_id", "mode", "num_frames", "event_id % 1000 as seed", f"named_struct('mode', if(event_id % 19 = 0, 'x', mode), 'seed', event_id % 1000 + if(event_id % 23 = 0, 1, 0), 'stage', if(event_id % 2 = 0, 'contact_initial', 'contact_visual_feedback'), 'used', {used}, 'latency', if(event_id % 29 = 0, -1D, 1D)) as trace")


_TRACES = f"""WITH {EPISODES}, {TRIALS}, t AS (SELECT t.*, num_frames, (event_id % num_frames)::INT AS start FROM trials t JOIN (SELECT episode, num_frames FROM episodes) USING (episode)),
 u AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN range(start, start + 8) WHEN event_id % 11 = 0 THEN [start] WHEN event_id % 13 = 0 THEN [start FOR i IN range(9)] WHEN event_id % 17 = 0 THEN [start + 2 * i FOR i IN range(9)] ELSE range(start, start + 9) END AS used FROM t)
 SELECT event_id, 'mode' AS rule FROM u WHERE event_id % 19 = 0 UNION ALL SELECT event_id, 'seed' FROM u WHERE event_id % 23 = 0 UNION ALL SELECT event_id, 'size' FROM u WHERE len(used) NOT IN (1, 9) UNION ALL SELECT event_id, 'range' FROM u WHERE list_max(used) >= num_frames
 UNION ALL SELECT event_id, 'single' FROM u WHERE len(used) = 1 AND event_id % 2 = 0 UNION ALL SELECT event_id, 'unique' FROM u WHERE len(used) = 9 AND len(list_distinct(used)) <> 9
 UNION ALL SELECT event_id, 'consecutive' FROM u WHERE len(used) = 9 AND len(list_filter(range(1, 9), lambda i: used[i + 1] - used[i] <> 1)) > 0 UNION ALL SELECT event_id, 'latency' FROM u WHERE event_id % 29 = 0"""


def _isolation(s, d):
    cover = C.cue_coverage(S._grid(s, d))
    fall = S._modes(s, d).select("episode", "mode", F.col("fallback").alias("fallback_frames"))
    rows = cover.join(fall, ["episode", "mode"]).withColumn("reads_speed", E("mode <> 'pinch' or episode % 9 = 0")).withColumn("reads_pinch", E("mode <> 'speed'"))
    return rows.withColumn("fallback_kind", E("if(mode = 'pinch', 'chronological', 'speed_ranked')")).withColumn("fallback_n", E("size(fallback_frames) + if(episode % 8 = 0, 1, 0)")).withColumn("key", F.concat_ws("|", "episode", "mode"))


def _counts(s, d):
    expected, trials = Q._expected(s, d), T.trials(s, d)
    one = lambda t, name: t.agg(F.count("*").alias(name))
    parts = [one(R.difference(expected, trials), "missing"), one(R.difference(trials, expected), "unexpected"), one(R.duplicate_keys(trials, R.KEY), "duplicate"), one(trials.where("status <> 'success'"), "errors")]
    out = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


def _caches(s, d):
    c = S._cues(s, d)
    mins = C.minima(T.frames(s, d)).groupBy("episode").agg(F.array_sort(F.collect_list("frame_idx")).alias("minima"))
    seen = T.frames(s, d).where("detected").groupBy("episode").agg(F.array_sort(F.collect_list("frame_idx")).alias("detected"))
    return c.join(mins, "episode").join(seen, "episode").select("episode", "num_frames", "minima", "detected", E("if(episode % 6 = 0, array_append(pinch_list, num_frames), pinch_list)").alias("neighborhood"))


def _gate(s, d):
    return T.episodes(s, d).selectExpr("episode", "num_frames", "episode % 3 > 0 as video_valid", "episode % 5 > 0 as metadata_valid", "episode % 7 > 0 as speed_valid", "episode % 2 > 0 as pinch_valid")


def _image_pairs(s, d):
    return T.table(s, d, "embeddings").selectExpr("vec_id", "transform(embedding, x -> abs(cast(x as double)) * 255) as a", "transform(embedding, x -> abs(cast(x as double)) * 200) as b")


def _loop(s, d):
    return L.closed_loop(S._grid(s, d), T.truths(s, d)).select("episode", "mode", "task", "trial", "frame_idx", "stage", "final")


_LOOP = f"""WITH {S._GRID}, {TRUTHS}, a AS (SELECT g.episode, mode, task, g.num_frames AS n, start, t.trial::INT AS trial, ('0x' || substr(sha256(g.episode || '|' || task || '|' || t.trial), 1, 8))::BIGINT AS seed FROM grid g JOIN truths USING (episode), range(3) t(trial)),
 b AS (SELECT *, (seed % 9 + 1)::INT AS cell, (start + seed % 9)::INT AS frame_idx FROM a),
 r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY speed, frame_idx) AS rank, count(*) OVER (PARTITION BY episode) AS n FROM frames WHERE speed <> 0), c AS (SELECT episode, speed AS cut FROM r WHERE rank = greatest(1, floor(0.3::DOUBLE * n))),
 e AS (SELECT b.*, f.speed AS own, coalesce(f.speed <= cut, false) AS accepted, seed % 2 = 0 OR b.frame_idx > b.n - 5 AS state FROM b LEFT JOIN (SELECT * FROM frames WHERE speed <> 0) f USING (episode, frame_idx) LEFT JOIN c ON c.episode = b.episode),
 g AS (SELECT *, CASE WHEN NOT state THEN 'visual_feedback' WHEN mode = 'pinch' THEN 'accepted' WHEN own IS NULL THEN 'missing_hand_speed' WHEN NOT accepted THEN 'speed_feedback' ELSE 'accepted' END AS stage FROM e),
 sp AS (SELECT episode, list(speed ORDER BY speed, frame_idx) AS ranked_speeds FROM frames WHERE speed <> 0 GROUP BY episode),
 l AS (SELECT g.*, pinch_list, CASE stage WHEN 'visual_feedback' THEN list_filter(ranked, lambda f: f > g.frame_idx) WHEN 'speed_feedback' THEN ranked[1:len(list_filter(ranked_speeds, lambda x: x < g.own))] ELSE list_filter(ranked, lambda f: f <> g.frame_idx) END AS allowed FROM g JOIN cues USING (episode) LEFT JOIN sp USING (episode)),
 p AS (SELECT *, CASE stage WHEN 'visual_feedback' THEN list_filter(pinch_list, lambda f: f > frame_idx) WHEN 'speed_feedback' THEN pinch_list ELSE list_filter(pinch_list, lambda f: f <> frame_idx) END AS pl, CASE WHEN mode <> 'pinch' THEN allowed WHEN stage = 'visual_feedback' THEN range(frame_idx + 1, n)::INT[] ELSE list_filter(range(n)::INT[], lambda f: f <> frame_idx) END AS pool FROM l),
 q AS (SELECT *, CASE mode WHEN 'speed' THEN allowed[1:4] WHEN 'pinch' THEN pl ELSE allowed[1:4] || list_filter(pl, lambda f: NOT list_contains(allowed[1:4], f)) END AS c FROM p),
 h AS (SELECT *, c || list_filter(pool, lambda f: NOT list_contains(c, f))[1:greatest(0, 4 - len(c))] AS cand FROM q),
 i AS (SELECT *, round_even(list_avg(CASE WHEN len(cand) = 0 THEN (range(n)::INT[])[1:4] ELSE cand END), 0)::INT AS center FROM h),
 w AS (SELECT *, greatest(0, least(center - 4, n - 9)) AS w FROM i)
 SELECT episode, mode, task, trial, frame_idx, stage, CASE WHEN stage = 'accepted' THEN frame_idx ELSE CASE WHEN stage <> 'visual_feedback' OR frame_idx + 1 > n - 9 THEN w ELSE greatest(w, frame_idx + 1) END + cell - 1 END::INT AS final FROM w"""


def _wilcoxon(s, d):
    return P.wilcoxon(Q._pairs(s, d), "task").select("task", "statistic", "p")


def _pairwise(s, d):
    long = stored(R.paired_modes(Q._events(s, d), ("speed", "pinch", "speed_pinch")).withColumn("pair", F.concat_ws("|", "scope", "mode_a", "mode_b")), "pairs")
    mean = B.merged_bootstrap(long, "pair", "difference", ["episode", "task"], 20260908).withColumnRenamed("mean", "difference")
    rows = stored(mean.join(P.wilcoxon(long, "pair"), "pair").withColumn("family", F.lit(1)), "tests")
    rows = P.holm(rows, "family", "p", "pair").withColumn("mode_a", F.split("pair", "[|]")[1]).withColumn("mode_b", F.split("pair", "[|]")[2])
    return rows.select("pair", "n", *(F.round(c, 9).alias(c) for c in ("difference", "low", "high", "statistic", "p", "adjusted", "effect")), P.conclusion().alias("conclusion"))


def rounded(rows, by: str):
    """The group, its n, and the numbers at nine places."""
    return rows.select(by, *(F.col(c) if c == "n" else F.round(c, 9).alias(c) for c in rows.columns if c != by))


def resamples_sql(rows: str, by: str, value: str, order: list[str], seed: int, resamples: int) -> str:
    """ends(by, low, high): the mergeable bootstrap in SQL, over the CTE rows; each step of the hash is a subquery."""
    def mixed(source: str) -> str:
        xor = [f"xor(h, h >> {k})" for k in B.SHIFTS]
        product = [f"(h::HUGEINT * {k} % 4294967296)::BIGINT" for k in B.FACTORS]
        for step in (xor[0], product[0], xor[1], product[1], xor[2]):
            source = f"(SELECT * EXCLUDE (h), {step} AS h FROM {source})"
        return source

    row = "('0x' || substr(sha256(concat_ws('|', " + ", ".join([str(seed), *order]) + ")), 1, 8))::BIGINT"
    first = mixed(f"(SELECT {by}, {value}, {row} AS h FROM {rows} WHERE {value} IS NOT NULL)")
    second = mixed(f"(SELECT {by}, {value}, b, xor(h, b * {B.STEP} % 4294967296) AS h FROM {first}, range({resamples}) t(b))")
    sums = f"(SELECT {by}, b, sum({value} * c) AS s, sum(c) AS n FROM (SELECT *, len(list_filter({B.THRESHOLDS}, lambda t: h >= t)) AS c FROM {second}) GROUP BY {by}, b HAVING sum(c) > 0)"
    return f"ends AS (SELECT {by}, quantile_cont(s / n, 0.025) AS low, quantile_cont(s / n, 0.975) AS high FROM {sums} GROUP BY {by})"


QUERIES = {
    "manifest_violations": (lambda s, d: A.violations(_labels(s, d), "episode", A.MANIFEST), f"""WITH {_LABELS} SELECT episode, 'length' AS rule FROM la WHERE e - s + 1 <> n UNION ALL SELECT episode, 'contact_range' FROM la WHERE c NOT BETWEEN 0 AND n - 1 UNION ALL SELECT episode, 'contact_global' FROM la WHERE g <> s + c
 UNION ALL SELECT episode, 'contact_availability' FROM la WHERE (c IS NULL) <> (g IS NULL) UNION ALL SELECT episode, 'order' FROM la WHERE p < c"""),
    "manifest_counts": (lambda s, d: _labels(s, d).agg(F.count("*").alias("episodes"), F.countDistinct("episode").alias("unique_ids"), F.count("contact_local").alias("contacts"), F.count("separate_local").alias("separations"), ((F.count("contact_local") + F.count("separate_local")) * 9).alias("trials")), f"WITH {_LABELS} SELECT count(*) AS episodes, count(DISTINCT episode) AS unique_ids, count(c) AS contacts, count(p) AS separations, (count(c) + count(p)) * 9 AS trials FROM la"),
    "speed_cache_check": (lambda s, d: A.series_check(_cut(s, d), T.episodes(s, d)), f"""WITH {FRAMES}, f AS (SELECT episode, frame_idx, num_frames AS n, frame_idx % 31 = 5 OR frame_idx % 37 = 6 AS bad FROM frames)
 SELECT episode, count(*) FILTER (frame_idx % 29 = 3 AND frame_idx % 41 <> 7) AS missing, 1::BIGINT AS extra, count(*) FILTER (frame_idx % 29 <> 3 AND frame_idx % 41 = 7) AS repeated,
 (count(*) FILTER (bad AND frame_idx % 29 <> 3) + count(*) FILTER (bad AND frame_idx % 41 = 7))::BIGINT AS bad FROM f GROUP BY episode"""),
    "pinch_cache_check": (lambda s, d: A.neighborhood_check(_caches(s, d)), f"WITH {S._CUES} SELECT episode, true AS sorted, episode % 6 <> 0 AS near, true AS detected, episode % 6 <> 0 AS bounded FROM cues WHERE len(pinch_list) > 0"),
    "trace_audit": (lambda s, d: A.violations(_traces(s, d), "event_id", A.TRACE), _TRACES),
    "mode_isolation": (lambda s, d: A.violations(_isolation(s, d), "key", A.ISOLATION), f"WITH {S._GRID} SELECT episode || '|' || mode AS key, 'reads' AS rule FROM grid WHERE mode = 'pinch' AND episode % 9 = 0 UNION ALL SELECT episode || '|' || mode, 'fallback_count' FROM grid WHERE episode % 8 = 0 UNION ALL SELECT episode || '|' || mode, 'leak' FROM grid WHERE (mode = 'speed' AND len(list_filter(range(start, start + 9)::INT[], lambda f: list_contains(pinch_list, f) AND NOT list_contains(speed_list, f))) > 0) OR (mode = 'pinch' AND len(list_filter(range(start, start + 9)::INT[], lambda f: list_contains(speed_list, f))) > 0)"),
    "audit_summary": (lambda s, d: A.summary(_counts(s, d)), f"""WITH {Q.EXPECTED}, {TRIALS}, c AS (SELECT (SELECT count(*) FROM (SELECT * FROM expected EXCEPT SELECT episode, task, mode, trial FROM trials)) AS missing, (SELECT count(*) FROM (SELECT episode, task, mode, trial FROM trials EXCEPT SELECT * FROM expected)) AS unexpected,
 0::BIGINT AS duplicate, (SELECT count(*) FROM trials WHERE status <> 'success') AS errors) SELECT *, missing = 0 AND unexpected = 0 AND duplicate = 0 AS complete, errors = 0 AS valid, missing = 0 AND unexpected = 0 AND duplicate = 0 AND errors = 0 AS success FROM c"""),
    "similarity": (lambda s, d: _image_pairs(s, d).select("vec_id", F.round(A.similarity("a", "b"), 6).alias("similarity")), "SELECT vec_id, round(greatest(0.0, 1 - list_avg([abs(abs(x::DOUBLE) * 255 - abs(x::DOUBLE) * 200) FOR x IN embedding]) / 255), 6) AS similarity FROM embeddings"),
    "cache_plan": (lambda s, d: A.cache_plan(_gate(s, d).selectExpr("episode", "if(episode % 4 = 0, null, speed_valid) as valid", "metadata_valid")).select("episode", "recompute"), f"WITH {EPISODES} SELECT episode, NOT (episode % 4 > 0 AND episode % 7 > 0) OR episode % 5 = 0 AS recompute FROM episodes"),
    "input_gate": (lambda s, d: A.input_gate(_gate(s, d), ("speed",)).select("episode", "ready"), f"WITH {EPISODES} SELECT episode, num_frames >= 9 AND episode % 3 > 0 AND episode % 5 > 0 AND episode % 7 > 0 AS ready FROM episodes"),
    "source_frames": (lambda s, d: A.source_frames(T.files(s, d).selectExpr("page_id div 10 as episode", "page_id % 10 + if(page_id % 33 = 0, 1, 0) as index", "if(page_id % 47 = 0, 1, 2) as width", "3 as height", "size as bytes")), f"WITH {FILES}, f AS (SELECT page_id // 10 AS episode, page_id % 10 + CASE WHEN page_id % 33 = 0 THEN 1 ELSE 0 END AS i, CASE WHEN page_id % 47 = 0 THEN 1 ELSE 2 END AS w, size FROM files) SELECT episode, count(*) AS n, count(DISTINCT w) = 1 AS uniform, sum(size)::BIGINT AS bytes, min(i) = 0 AND max(i) = count(*) - 1 AND count(DISTINCT i) = count(*) AS contiguous FROM f GROUP BY 1"),
    "prompt_text": (lambda s, d: T.table(s, d, "events").selectExpr("event_id", "if(event_id % 2 = 0, 'start', 'end') as anchor", "event_type as action").select("event_id", L.prompt("anchor", "action").alias("prompt")), "SELECT event_id, replace(CASE WHEN event_id % 2 = 0 THEN '" + L.PROMPTS["start"] + "' ELSE '" + L.PROMPTS["end"] + "' END, '{action}', event_type) AS prompt FROM events"),
    "dry_run_localize": (lambda s, d: L.dry_run(S._grid(s, d), T.truths(s, d)).select("episode", "mode", "task", "trial", "cell", "prediction", "error"), f"WITH {S._GRID}, {TRUTHS}, a AS (SELECT g.episode, mode, task, start, gt, t.trial::INT AS trial, (('0x' || substr(sha256(g.episode || '|' || task || '|' || t.trial), 1, 8))::BIGINT % 9 + 1)::INT AS cell FROM grid g JOIN truths USING (episode), range(3) t(trial)) SELECT episode, mode, task, trial, cell, start + cell - 1 AS prediction, abs(start + cell - 1 - gt) AS error FROM a"),
    "closed_loop": (_loop, _LOOP),
    "long_events": (lambda s, d: L.long_events(C.minima(T.frames(s, d)), T.frames(s, d)),
        f"""WITH {S._CUES}, mi AS (SELECT m.episode, num_frames, m.frame_idx AS minimum, ('0x' || substr(sha256(m.episode || '|state|' || m.frame_idx), 1, 8))::BIGINT AS seed FROM minima m JOIN totals USING (episode) WHERE num_frames >= 9),
 ev AS (SELECT mi.episode, CASE (seed % 3)::INT WHEN 0 THEN 'Contact' WHEN 1 THEN 'Separation' ELSE 'Neither' END AS event, f.frame_idx, f.speed FROM mi JOIN frames f ON f.episode = mi.episode AND f.frame_idx = greatest(0, least(minimum - 4, mi.num_frames - 9)) + seed % 9 WHERE f.speed <> 0),
 pt AS (SELECT *, count(*) FILTER (event = 'Separation') OVER (PARTITION BY episode ORDER BY frame_idx, event = 'Separation' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM ev WHERE event <> 'Neither'),
 pairs AS (SELECT episode, (list(frame_idx ORDER BY speed, frame_idx) FILTER (event = 'Contact'))[1] AS contact, min(frame_idx) FILTER (event = 'Separation') AS separation FROM pt GROUP BY episode, part) SELECT episode, contact, separation FROM pairs WHERE contact IS NOT NULL AND separation IS NOT NULL"""),
    "bootstrap_ci": (lambda s, d: rounded(B.merged_bootstrap(Q._events(s, d), "mode", "error", ["episode", "task"], 20260908, 100).select("mode", "low", "high"), "mode"),
        f"WITH {Q.EVENTS}, {resamples_sql('events_', 'mode', 'error', ['episode', 'task'], 20260908, 100)} SELECT mode, round(low, 9) AS low, round(high, 9) AS high FROM ends"),
    "wilcoxon": (_wilcoxon, None),
    "pairwise": (_pairwise, None),
    "active_span": (lambda s, d: N.spans_by_episode(T.frames(s, d)), None),
    "minima_short": (lambda s, d: N.minima_by_episode(T.frames(s, d), "short"), None),
    "minima_long": (lambda s, d: N.minima_by_episode(T.frames(s, d), "long"), None),
    "minima_long_vda": (lambda s, d: N.minima_by_episode(T.frames(s, d), "long_vda"), None),
    "inv_speed_draw": (lambda s, d: K.weighted_draw(T.frames(s, d).where(C.usable()), "episode", "speed", 7), f"WITH {FRAMES} SELECT episode, {drawn('episode', 'speed', 7)} AS frame_idx FROM frames WHERE speed <> 0 GROUP BY episode"),
    "content_hash": (lambda s, d: T.truths(s, d).select("episode", "task", F.sha2(F.to_json(F.struct(F.col("episode"), F.col("gt"), F.col("num_frames"), F.col("task"))), 256).alias("digest")), f"WITH {TRUTHS} SELECT episode, task, sha256('{{\"episode\":' || episode || ',\"gt\":' || gt || ',\"num_frames\":' || num_frames || ',\"task\":\"' || task || '\"}}') AS digest FROM truths"),
}
