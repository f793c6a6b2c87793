"""Queries over trials, manifests, answers and inventories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import relations as R
from tidemark.operators import rollups as U
from tidemark.operators import statistics as P
from tidemark.plans.ctes import COMPLETIONS, EPISODES, FILES, GRID_ROWS, TRIALS, TRUTHS
from tidemark.sources import tables as T

E = F.expr
EXPECTED = TRUTHS + ", expected AS (SELECT episode, task, mode, trial::INT AS trial FROM truths, (VALUES ('speed'), ('pinch'), ('speed_pinch')) m(mode), range(3) t(trial))"
EVENTS = TRUTHS + ", " + TRIALS + """, ev AS (SELECT episode, task, mode, num_frames, gt, round_even(avg(prediction) FILTER (prediction >= 0), 0)::INT AS prediction, count(*) AS recorded,
 count(*) FILTER (prediction >= 0) AS valid, count(*) FILTER (status <> 'success') AS failed, bool_or(recall) AS recall, bool_or(recall) = bool_and(recall) AS consistent FROM trials JOIN truths USING (episode, task) GROUP BY ALL),
 events_ AS (SELECT *, abs(prediction - gt)::DOUBLE AS error, abs(prediction - gt)::DOUBLE / greatest(1, num_frames - 1) AS normalized, valid < recorded AS partial FROM ev)"""
METRICS = """count(*) AS total, count(error) AS successful, count(*) - count(error) AS failed, round((count(*) - count(error)) / count(*), 6) AS failure_rate, round(avg(error), 6) AS mean_error,
 round(quantile_cont(error, 0.5), 6) AS median_error, round(avg(normalized), 9) AS mean_normalized, round(quantile_cont(normalized, 0.5), 9) AS median_normalized, round(avg(recall::INT), 6) AS recall"""
SCORED = GRID_ROWS + """, scored AS (SELECT *, cell IS NOT NULL AS parsed, coalesce(cell BETWEEN 1 AND 9, false) AS valid, coalesce(cell = gt_cell, false) AS exact,
 CASE WHEN cell BETWEEN 1 AND 9 THEN abs(frame_indices[cell] - gt_frame) END AS frame_error, CASE WHEN cell BETWEEN 1 AND 9 THEN exp(-((cell - gt_cell) * (cell - gt_cell)) / 2.0::DOUBLE) ELSE 0.0 END AS reward FROM grid_rows)"""
EVAL = """count(*) AS n, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (parsed) AS parsed_n, round(avg(parsed::INT), 6) AS parse_rate, round(avg(valid::INT), 6) AS valid_rate,
 round(avg(exact::INT), 6) AS accuracy, round(avg(frame_error), 6) AS frame_mae, count(frame_error) AS mae_n, round(sum(reward), 6) AS reward_sum, round(avg(reward), 6) AS reward_mean"""
PAIRS = EVENTS + """, pe AS (SELECT a.episode, a.task, a.error AS a, b.error AS b, a.error - b.error AS difference FROM events_ a JOIN events_ b USING (episode, task) WHERE a.mode = 'speed' AND b.mode = 'pinch' AND a.error IS NOT NULL AND b.error IS NOT NULL)"""
RANKS = PAIRS + """, rk AS (SELECT task, difference, rank() OVER (PARTITION BY task ORDER BY abs(difference)) + (count(*) OVER (PARTITION BY task, abs(difference)) - 1) / 2.0::DOUBLE AS rank FROM pe WHERE difference <> 0),
 sr AS (SELECT task, sum(CASE WHEN difference > 0 THEN rank ELSE 0 END) AS positive, sum(CASE WHEN difference < 0 THEN rank ELSE 0 END) AS negative, count(*) AS n FROM rk GROUP BY task)"""
MANIFEST = """la AS (SELECT o_orderkey AS episode, (o_orderkey % 7 + 1) AS label_frames FROM orders WHERE o_orderkey % 50 > 0),
 sg AS (SELECT l_orderkey AS episode, count(*) AS segment_frames FROM lineitem WHERE l_orderkey % 60 > 0 GROUP BY 1)"""


def _events(s, d):
    return U.event_rows(T.trials(s, d), T.truths(s, d))


def _scored(s, d):
    rows = T.grid_rows(s, d).withColumn("parsed", F.col("cell").isNotNull()).withColumn("valid", F.coalesce(F.col("cell").between(1, 9), F.lit(False)))
    rows = rows.withColumn("exact", F.coalesce(F.col("cell") == F.col("gt_cell"), F.lit(False))).withColumn("frame_error", E("if(valid, abs(frame_indices[cell - 1] - gt_frame), null)"))
    return rows.withColumn("reward", X.gaussian_reward("cell", "gt_cell"))


def _pairs(s, d):
    return R.paired_errors(_events(s, d), "speed", "pinch")


def _manifest(s, d):
    labels = T.table(s, d, "orders").where("o_orderkey % 50 > 0").selectExpr("o_orderkey as episode", "o_orderkey % 7 + 1 as label_frames")
    segments = T.table(s, d, "lineitem").where("l_orderkey % 60 > 0").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count("*").alias("segment_frames"))
    return R.manifest_join(labels, segments)


def _expected(s, d):
    return R.expected_keys(T.truths(s, d))


def _requests(s, d):
    return T.table(s, d, "events").selectExpr("event_id", "event_type", "0D as start", "if(event_id % 9 = 0, null, value / 100) as first", "value / 10 as stop", "event_id % 500 as tokens")


_REQ = "rq AS (SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 100 END AS first, value / 10 AS stop, event_id % 500 AS tokens FROM events), rm AS (SELECT *, first AS ttft, coalesce(stop - first, stop) AS generation, CASE WHEN coalesce(stop - first, stop) > 0 THEN tokens / coalesce(stop - first, stop) ELSE 0 END AS rate FROM rq)"
_ANSWER = "concat(completion, CASE id % 4 WHEN 0 THEN concat(' event: contact, Frame: ', id) WHEN 1 THEN 'Event:Separation Frame: -1' WHEN 2 THEN 'Event: none' ELSE 'no idea' END)"
_STATUS = "CASE doc_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 404 WHEN 2 THEN 503 END"
_MESSAGE = "concat(text, CASE doc_id % 3 WHEN 0 THEN 'Rate limit, Try Again' WHEN 1 THEN 'bad request' ELSE 'request timed out' END)"

QUERIES = {
    "latest_per_key": (lambda s, d: R.latest_per_key(T.table(s, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id"), "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"),
    "validate_rows": (lambda s, d: T.grid_rows(s, d).select("sample", F.explode(E("array_compact(array(if(cell is null, 'missing_cell', null), if(cell not between 1 and 9, 'cell_out_of_range', null), if(not array_contains(frame_indices, gt_frame), 'truth_outside', null), if(status <> 'success', 'failed', null)))")).alias("violation")),
        f"WITH {GRID_ROWS} SELECT sample, 'missing_cell' AS violation FROM grid_rows WHERE cell IS NULL UNION ALL SELECT sample, 'cell_out_of_range' FROM grid_rows WHERE cell NOT BETWEEN 1 AND 9 UNION ALL SELECT sample, 'truth_outside' FROM grid_rows WHERE NOT list_contains(frame_indices, gt_frame) UNION ALL SELECT sample, 'failed' FROM grid_rows WHERE status <> 'success'"),
    "index_range_scan": (lambda s, d: T.table(s, d, "pages").select("page_id", E("try_cast(nullif(regexp_extract(url, '([0-9]+)', 1), '') as int)").alias("index")).where("index between 10 and 500"), "SELECT page_id, nullif(regexp_extract(url, '([0-9]+)', 1), '')::INT AS index FROM pages WHERE nullif(regexp_extract(url, '([0-9]+)', 1), '')::INT BETWEEN 10 AND 500"),
    "contiguity_check": (lambda s, d: T.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"), F.count("*").alias("rows")).select("l_orderkey", E("n = sequence(1, cast(rows as int))").alias("contiguous")), "SELECT l_orderkey, count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1"),
    "last_response": (lambda s, d: T.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("traces")).select("conv_id", E("filter(traces, t -> t.role = 'assistant')").alias("t")).select("conv_id", E("cast(try_element_at(t, -1).turn as double)").alias("turn"), E("cast(length(try_element_at(t, -1).text) as double)").alias("chars")),
        "SELECT conv_id, (max(turn) FILTER (role = 'assistant'))::DOUBLE AS turn, (arg_max(length(text), turn) FILTER (role = 'assistant'))::DOUBLE AS chars FROM conversations GROUP BY 1"),
    "manifest_join": (lambda s, d: _manifest(s, d).select("episode", *(F.col(c).cast("double").alias(c) for c in ("label_frames", "segment_frames")), "status"), f"WITH {MANIFEST} SELECT episode, label_frames::DOUBLE AS label_frames, segment_frames::DOUBLE AS segment_frames, CASE WHEN label_frames IS NULL THEN 'extra' WHEN segment_frames IS NULL THEN 'missing' WHEN label_frames <> segment_frames THEN 'mismatch' ELSE 'paired' END AS status FROM la FULL JOIN sg USING (episode)"),
    "trial_lookup": (lambda s, d: T.trials(s, d).join(T.truths(s, d), ["episode", "task"], "left").select("episode", "task", "mode", "trial", F.coalesce(F.col("gt").isNotNull(), F.lit(False)).alias("known")), f"WITH {TRUTHS}, {TRIALS} SELECT episode, task, mode, trial, gt IS NOT NULL AS known FROM trials LEFT JOIN truths USING (episode, task)"),
    "expected_keys": (_expected, f"WITH {EXPECTED} SELECT * FROM expected"),
    "missing_keys": (lambda s, d: R.difference(_expected(s, d), T.trials(s, d)), f"WITH {EXPECTED}, {TRIALS} SELECT * FROM expected EXCEPT SELECT episode, task, mode, trial FROM trials"),
    "unexpected_keys": (lambda s, d: R.difference(T.trials(s, d), _expected(s, d)), f"WITH {EXPECTED}, {TRIALS} SELECT episode, task, mode, trial FROM trials EXCEPT SELECT * FROM expected"),
    "duplicate_keys": (lambda s, d: R.duplicate_keys(T.table(s, d, "lineitem"), ("l_orderkey", "l_linenumber")), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "paired_errors": (lambda s, d: _pairs(s, d), f"WITH {PAIRS} SELECT * FROM pe"),
    "resume_plan": (lambda s, d: R.difference(_expected(s, d), T.trials(s, d).where("status = 'success'")), f"WITH {EXPECTED}, {TRIALS} SELECT * FROM expected EXCEPT SELECT episode, task, mode, trial FROM trials WHERE status = 'success'"),
    "retry_plan": (lambda s, d: R.retry_plan(_expected(s, d), T.trials(s, d)), f"WITH {EXPECTED}, {TRIALS} SELECT e.*, coalesce(status, 'new') AS reason FROM expected e LEFT JOIN trials t USING (episode, task, mode, trial) WHERE status IS NULL OR status <> 'success'"),
    "select_episodes": (lambda s, d: R.select_episodes(T.table(s, d, "events").select(F.col("event_id").alias("pos"), E("cast(user_id * 2 % 200 as string)").alias("token")), T.episodes(s, d)), f"WITH {EPISODES}, f AS (SELECT lpad((user_id * 2 % 200)::VARCHAR, 6, '0') AS episode, min(event_id) AS pos FROM events GROUP BY 1) SELECT f.episode, pos, k.e IS NOT NULL AS known FROM f LEFT JOIN (SELECT lpad(episode::VARCHAR, 6, '0') AS e FROM episodes) k ON k.e = f.episode WHERE f.episode <> '000000'"),
    "source_facts": (lambda s, d: T.grid_rows(s, d).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups"), F.count_if(F.col("task") == "contact").alias("contact_n")), f"WITH {GRID_ROWS} SELECT source, count(*) AS n, count(DISTINCT group_id) AS groups, count(*) FILTER (task = 'contact') AS contact_n FROM grid_rows GROUP BY 1"),
    "asset_pairing": (lambda s, d: R.asset_pairing(*(T.table(s, d, t).select(F.col(c).alias("id")) for t, c in (("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id")))), "SELECT id, bool_or(a) AS a, bool_or(b) AS b, bool_or(c) AS c FROM (SELECT doc_id AS id, true AS a, false AS b, false AS c FROM documents UNION ALL SELECT doc_id, false, true, false FROM labels UNION ALL SELECT vec_id, false, false, true FROM embeddings) GROUP BY id"),
    "rounded_mean": (lambda s, d: T.trials(s, d).groupBy("episode", "task", "mode").agg(U.rounded_mean().cast("double").alias("prediction")), f"WITH {TRIALS} SELECT episode, task, mode, round_even(avg(prediction) FILTER (prediction >= 0), 0) AS prediction FROM trials GROUP BY 1, 2, 3"),
    "final_frame": (lambda s, d: T.trials(s, d).groupBy("episode", "task").agg(F.coalesce(U.rounded_mean(), F.lit(-1)).alias("frame")), f"WITH {TRIALS} SELECT episode, task, coalesce(round_even(avg(prediction) FILTER (prediction >= 0), 0)::INT, -1) AS frame FROM trials GROUP BY 1, 2"),
    "event_rows": (lambda s, d: _events(s, d).withColumn("normalized", F.round("normalized", 9)).withColumn("prediction", F.col("prediction").cast("double")), f"WITH {EVENTS} SELECT * REPLACE (round(normalized, 9) AS normalized, prediction::DOUBLE AS prediction) FROM events_"),
    "metric_summary": (lambda s, d: _events(s, d).groupBy("task", "mode").agg(*U.metrics()), f"WITH {EVENTS} SELECT task, mode, {METRICS} FROM events_ GROUP BY task, mode"),
    "scope_rollup": (lambda s, d: U.grouping_sets(_events(s, d).drop("failed"), [("task", "mode"), ("mode",)], ("task", "mode"), U.metrics()), f"WITH {EVENTS} SELECT CASE WHEN grouping(task) = 1 THEN 'all' ELSE task END AS task, mode, {METRICS} FROM events_ GROUP BY GROUPING SETS ((task, mode), (mode))"),
    "eval_rollup": (lambda s, d: U.grouping_sets(_scored(s, d), [("task", "source"), ("task",), ()], ("task", "source"), U.eval_metrics()), f"WITH {SCORED} SELECT CASE WHEN grouping(task) = 1 THEN 'all' ELSE task END AS task, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, {EVAL} FROM scored GROUP BY GROUPING SETS ((task, source), (task), ())"),
    "eval_metrics": (lambda s, d: _scored(s, d).agg(*U.eval_metrics()), f"WITH {SCORED} SELECT {EVAL} FROM scored"),
    "grid_report": (lambda s, d: U.grouping_sets(_scored(s, d), [("task", "source"), ("task",)], ("task", "source"), U.eval_metrics()), f"WITH {SCORED} SELECT task, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, {EVAL} FROM scored GROUP BY GROUPING SETS ((task, source), (task))"),
    "strata_counts": (lambda s, d: T.trials(s, d).groupBy("task", "mode", "trial").agg(F.count("*").alias("n")).join(T.truths(s, d).groupBy("task").agg(F.count("*").alias("expected")), "task"), f"WITH {TRUTHS}, {TRIALS} SELECT task, mode, trial, count(*) AS n, any_value(expected) AS expected FROM trials JOIN (SELECT task, count(*) AS expected FROM truths GROUP BY 1) USING (task) GROUP BY 1, 2, 3"),
    "paired_seed": (lambda s, d: T.trials(s, d).withColumn("seed", F.when(F.col("event_id") % 50 == 0, F.col("event_id")).otherwise(P.derived_seed(F.col("episode"), F.col("task"), F.col("trial")))).groupBy("episode", "task", "trial").agg(F.countDistinct("mode").alias("modes"), F.countDistinct("seed").alias("seeds")).where("modes = 3 and seeds > 1"),
        f"WITH {TRIALS} SELECT episode, task, trial, count(DISTINCT mode) AS modes, count(DISTINCT CASE WHEN event_id % 50 = 0 THEN event_id ELSE ('0x' || substr(sha256(episode || '|' || task || '|' || trial), 1, 8))::BIGINT END) AS seeds FROM trials GROUP BY 1, 2, 3 HAVING count(DISTINCT mode) = 3 AND count(DISTINCT CASE WHEN event_id % 50 = 0 THEN event_id ELSE ('0x' || substr(sha256(episode || '|' || task || '|' || trial), 1, 8))::BIGINT END) > 1"),
    "status_counts": (lambda s, d: T.trials(s, d).groupBy("status").agg(F.count("*").alias("n")), f"WITH {TRIALS} SELECT status, count(*) AS n FROM trials GROUP BY 1"),
    "inventory_rollup": (lambda s, d: T.files(s, d).groupBy(E("split(path, '/')[0]").alias("root")).agg(F.count("*").alias("n"), F.count_if("readable").alias("readable_n"), F.sum("size").cast("bigint").alias("bytes")), f"WITH {FILES} SELECT split_part(path, '/', 1) AS root, count(*) AS n, count(*) FILTER (readable) AS readable_n, sum(size)::BIGINT AS bytes FROM files GROUP BY 1"),
    "folder_counts": (lambda s, d: T.files(s, d).groupBy("folder").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths")), f"WITH {FILES} SELECT folder, count(*) AS n, count(DISTINCT path) AS paths FROM files GROUP BY 1"),
    "json_key_counts": (lambda s, d: T.table(s, d, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key")).groupBy("key").agg(F.count("*").alias("n")), "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1"),
    "request_metrics": (lambda s, d: U.request_metrics(_requests(s, d)).select("event_id", *(F.round(c, 6).alias(c) for c in ("ttft", "generation", "rate"))), f"WITH {_REQ} SELECT event_id, round(ttft, 6) AS ttft, round(generation, 6) AS generation, round(rate, 6) AS rate FROM rm"),
    "run_summary": (lambda s, d: U.run_summary(U.request_metrics(_requests(s, d)).withColumn("wall", F.col("stop")), "event_type"), f"WITH {_REQ} SELECT event_type, count(*) AS n, round(avg(rate), 6) AS mean, round(quantile_cont(rate, 0.5), 6) AS median, round(stddev_samp(rate), 6) AS deviation, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / max(stop), 6) AS overall FROM rm GROUP BY 1"),
    "derived_seed": (lambda s, d: T.episodes(s, d).select("episode", P.derived_seed(F.lit(20260908), F.col("episode"), F.lit("mae")).alias("seed")), f"WITH {EPISODES} SELECT episode, ('0x' || substr(sha256('20260908|' || episode || '|mae'), 1, 8))::BIGINT AS seed FROM episodes"),
    "derive_seed": (lambda s, d: T.trials(s, d).select("episode", "task", "mode", "trial", P.derived_seed(F.col("episode"), F.col("task"), F.col("trial")).alias("seed")), f"WITH {TRIALS} SELECT episode, task, mode, trial, ('0x' || substr(sha256(episode || '|' || task || '|' || trial), 1, 8))::BIGINT AS seed FROM trials"),
    "holm": (lambda s, d: P.holm(T.table(s, d, "events").selectExpr("event_id as id", "user_id as family", "if(event_id % 7 = 0, null, value / 5000) as p"), "family").select("id", F.round("adjusted", 9).alias("adjusted")),
        """WITH e AS (SELECT event_id AS id, user_id AS family, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 5000 END AS p FROM events), s AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1) * p) AS step FROM e WHERE p IS NOT NULL)
 SELECT id, round(max(step) OVER (PARTITION BY family ORDER BY p, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS adjusted FROM s UNION ALL SELECT id, NULL FROM e WHERE p IS NULL"""),
    "rank_biserial": (lambda s, d: P.signed_ranks(_pairs(s, d), "task").select("task", F.round(P.rank_biserial(), 9).alias("r")), f"WITH {RANKS} SELECT task, round((positive - negative) / (positive + negative), 9) AS r FROM sr"),
    "wilcoxon_stat": (lambda s, d: P.signed_ranks(_pairs(s, d), "task").select("task", F.least("positive", "negative").alias("statistic"), "n"), f"WITH {RANKS} SELECT task, least(positive, negative) AS statistic, n FROM sr"),
    "conclusion_rule": (lambda s, d: T.table(s, d, "events").selectExpr("event_id", "'speed' as mode_a", "'pinch' as mode_b", "value - 100 as difference", "value - 120 as low", "value - 80 as high", "event_id % 10 / 100D as adjusted").select("event_id", P.conclusion().alias("conclusion")),
        "SELECT event_id, CASE WHEN value - 100 < 0 AND value - 80 < 0 AND event_id % 10 / 100.0::DOUBLE < 0.05 THEN 'speed superior' WHEN value - 100 > 0 AND value - 120 > 0 AND event_id % 10 / 100.0::DOUBLE < 0.05 THEN 'pinch superior' ELSE 'inconclusive/mode-dependent' END AS conclusion FROM events"),
    "percentiles": (lambda s, d: T.frames(s, d).groupBy("episode").agg(*(F.round(F.percentile("speed", F.lit(p)), 6).alias(n) for p, n in ((0.25, "q1"), (0.7, "p70"), (0.95, "p95")))), "SELECT user_id AS episode, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.7), 6) AS p70, round(quantile_cont(v, 0.95), 6) AS p95 FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS v FROM events) GROUP BY 1"),
    "parse_cell": (lambda s, d: T.completions(s, d).select("id", X.parse_cell("completion").cast("double").alias("cell")), f"""WITH {COMPLETIONS} SELECT id, list_last(regexp_extract_all(completion, '\\{{[^{{}}]*"points"\\s*:\\s*\\[\\s*(-?\\d+)\\s*\\][^{{}}]*\\}}', 1))::DOUBLE AS cell FROM completions"""),
    "parse_point_first": (lambda s, d: T.completions(s, d).select("id", X.parse_point_first("completion").alias("point")), f"""WITH {COMPLETIONS} SELECT id, coalesce(nullif(regexp_extract(replace(replace(completion, ' ', ''), chr(10), ''), '\\{{"points":\\[(-?[0-9]+)', 1), '')::INT, -1) AS point FROM completions"""),
    "parse_event": (lambda s, d: T.completions(s, d).select("id", E(_ANSWER).alias("a")).select("id", X.parse_event("a").alias("event")), f"WITH {COMPLETIONS}, e AS (SELECT id, nullif(regexp_extract({_ANSWER}, '(?i)Event:\\s*(Contact|Separation|Neither|None)', 1), '') AS e FROM completions) SELECT id, upper(e[1]) || lower(e[2:]) AS event FROM e"),
    "parse_frame": (lambda s, d: T.completions(s, d).select("id", E(_ANSWER).alias("a")).select("id", X.parse_frame("a").alias("frame")), f"WITH {COMPLETIONS} SELECT id, coalesce(nullif(regexp_extract({_ANSWER}, 'Frame:\\s*(-?\\d+)', 1), '')::INT, -1) AS frame FROM completions"),
    "cell_rewards": (lambda s, d: T.grid_rows(s, d).select("sample", F.posexplode(X.cell_rewards("gt_cell")).alias("i", "r")).select("sample", (F.col("i") + 1).alias("cell"), F.round("r", 9).alias("reward")), f"WITH {GRID_ROWS} SELECT sample, c::INT AS cell, round(exp(-((c - gt_cell) * (c - gt_cell)) / 2.0::DOUBLE), 9) AS reward FROM grid_rows, range(1, 10) r(c)"),
    "gaussian_reward": (lambda s, d: T.grid_rows(s, d).select("sample", F.round(X.gaussian_reward("cell", "gt_cell"), 9).alias("reward")), f"WITH {SCORED} SELECT sample, round(reward, 9) AS reward FROM scored"),
    "reward_lookup": (lambda s, d: T.grid_rows(s, d).withColumn("rewards", X.cell_rewards("gt_cell")).select("sample", F.round(X.reward_lookup("rewards", "cell"), 9).alias("reward")), f"WITH {SCORED} SELECT sample, round(reward, 9) AS reward FROM scored"),
    "exact_cell": (lambda s, d: T.grid_rows(s, d).select("sample", E("if(cell is null, 0D, 1D)").alias("parsed"), E("if(cell = gt_cell, 1D, 0D)").alias("exact")), f"WITH {SCORED} SELECT sample, parsed::INT::DOUBLE AS parsed, exact::INT::DOUBLE AS exact FROM scored"),
    "score_rows": (lambda s, d: _scored(s, d).select("sample", "parsed", "valid", "exact", E("cast(if(valid, frame_indices[cell - 1], null) as double)").alias("frame"), F.col("frame_error").cast("double").alias("frame_error"), F.round("reward", 9).alias("reward")), f"WITH {SCORED} SELECT sample, parsed, valid, exact, CASE WHEN valid THEN frame_indices[cell] END::DOUBLE AS frame, frame_error::DOUBLE AS frame_error, round(reward, 9) AS reward FROM scored"),
    "redact": (lambda s, d: T.table(s, d, "documents").select("doc_id", F.sha2(X.redact("text", "the"), 256).alias("digest")), "SELECT doc_id, sha256(substr(replace(text, 'the', '[REDACTED]'), 1, 4000)) AS digest FROM documents"),
    "transient_flag": (lambda s, d: T.table(s, d, "documents").select("doc_id", E(f"cast({_STATUS} as int)").alias("status"), E("if(doc_id % 11 = 0, 'APITimeoutError', 'ValueError')").alias("name"), E(_MESSAGE).alias("message")).select("doc_id", X.transient("status", "name", "message").alias("transient")),
        f"WITH t AS (SELECT doc_id, {_STATUS} AS status, CASE WHEN doc_id % 11 = 0 THEN 'APITimeoutError' ELSE 'ValueError' END AS name, lower({_MESSAGE}) AS m FROM documents) SELECT doc_id, CASE WHEN status IS NOT NULL THEN status IN (408, 429) OR status >= 500 ELSE coalesce(contains(lower(name), 'timeout') OR contains(lower(name), 'connection') OR list_bool_or([contains(m, x) FOR x IN {list(X.MARKERS)}]), false) END AS transient FROM t"),
    "backoff": (lambda s, d: T.table(s, d, "events").select("event_id", E("cast(event_id % 6 + 1 as int)").alias("attempt")).select("event_id", X.backoff("attempt", 0.5).alias("delay")), "SELECT event_id, 0.5::DOUBLE * pow(2.0::DOUBLE, event_id % 6) AS delay FROM events"),
    "result_key": (lambda s, d: T.trials(s, d).select(X.result_key("episode", "task", "mode", "trial").alias("key"), "status"), f"WITH {TRIALS} SELECT lpad(episode::VARCHAR, 6, '0') || '|' || task || '|' || mode || '|' || trial AS key, status FROM trials"),
    "safe_name": (lambda s, d: T.table(s, d, "pages").select("page_id", X.safe_name("url").alias("name")), "SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g'), '^_+|_+$', '', 'g')) AS name FROM pages"),
    "stage_name": (lambda s, d: T.table(s, d, "events").selectExpr("event_id", "if(event_id % 2 = 0, 'start', 'end') as anchor", "if(event_id % 5 = 0, null, event_id) as frame", "case event_id % 4 when 0 then 'feedback' when 1 then 'speed' when 2 then 'fault' end as flag").select("event_id", X.stage_name("anchor", "frame", "flag").alias("stage")),
        "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END || '_' || CASE WHEN event_id % 5 = 0 THEN 'initial' ELSE CASE event_id % 4 WHEN 0 THEN 'visual_feedback' WHEN 1 THEN 'speed_feedback' WHEN 2 THEN 'missing_hand_speed' ELSE 'resample' END END AS stage FROM events"),
    "clean_ints": (lambda s, d: T.table(s, d, "events").select("event_id", E("array(cast(event_id as string), 'x', cast(event_id as string), cast(event_id + 1 as string), null)").alias("v")).select("event_id", F.array_join(F.transform(X.clean_ints("v"), lambda x: x.cast("string")), ",").alias("clean"), F.size(X.clean_ints("v", False)).alias("kept")), "SELECT event_id, event_id || ',' || (event_id + 1) AS clean, 3 AS kept FROM events"),
    "parse_label": (lambda s, d: T.table(s, d, "events").select("event_id", E("case event_id % 6 when 0 then ' X ' when 1 then 'n/a' when 2 then '' when 3 then '7.5' else cast(event_id as string) end").alias("t")).select("event_id", X.parse_label("t").cast("double").alias("label")), "SELECT event_id, CASE WHEN event_id % 6 < 3 THEN NULL WHEN event_id % 6 = 3 THEN NULL ELSE event_id END::DOUBLE AS label FROM events"),
    "resize_dims": (lambda s, d: T.table(s, d, "events").selectExpr("event_id", "cast(event_id * 37 % 4000 + 1 as int) as w", "cast(event_id * 53 % 3000 + 1 as int) as h").withColumn("r", X.resized("w", "h")).select("event_id", "r.w", "r.h"),
        """WITH e AS (SELECT event_id, (event_id * 37 % 4000 + 1)::INT AS w, (event_id * 53 % 3000 + 1)::INT AS h FROM events), a AS (SELECT *, w / h AS q FROM e),
 b AS (SELECT *, trunc(least(w, 2000) / q)::INT AS bh, trunc(least(h, 2000) * q)::INT AS bw FROM a)
 SELECT event_id, CASE WHEN w > h THEN CASE WHEN bh > 768 THEN trunc(768 * q) ELSE least(w, 2000) END ELSE CASE WHEN bw > 768 THEN 768 ELSE bw END END::INT AS w, CASE WHEN w > h THEN CASE WHEN bh > 768 THEN 768 ELSE bh END ELSE CASE WHEN bw > 768 THEN trunc(768 / q) ELSE least(h, 2000) END END::INT AS h FROM b"""),
    "conversation_text": (lambda s, d: T.table(s, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), 256).alias("digest")), "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1"),
    "first_non_null": (lambda s, d: T.table(s, d, "events").selectExpr("event_id", "coalesce(if(event_id % 3 = 0, 'message', null), if(event_id % 2 = 0, 'extra', null), if(event_id % 5 = 0, 'dump', null)) as found"), "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'message' END, CASE WHEN event_id % 2 = 0 THEN 'extra' END, CASE WHEN event_id % 5 = 0 THEN 'dump' END) AS found FROM events"),
    "run_counters": (lambda s, d: _expected(s, d).join(T.trials(s, d).select(*R.KEY, "status"), list(R.KEY), "left").agg(F.count("*").alias("planned"), F.count("status").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isNull()).alias("written")), f"WITH {EXPECTED}, {TRIALS} SELECT count(*) AS planned, count(status) AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL) AS written FROM expected LEFT JOIN trials USING (episode, task, mode, trial)"),
    "grouped_split": (lambda s, d: (lambda g: g.join(g.select("source", "group_id").distinct().withColumn("h", E("sha2(concat_ws('|', source, cast(group_id as string), '7'), 256)")).selectExpr("source", "group_id", "row_number() over (partition by source order by h) as rn", "count(*) over (partition by source) as n"), ["source", "group_id"]).select("sample", E("if(rn <= greatest(1, bround(0.1D * n)), 'validation', 'train')").alias("split")))(T.grid_rows(s, d)),
        f"WITH {GRID_ROWS}, g AS (SELECT DISTINCT source, group_id FROM grid_rows), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(source || '|' || group_id || '|7')) AS rn, count(*) OVER (PARTITION BY source) AS n FROM g) SELECT sample, CASE WHEN rn <= greatest(1, round_even(0.1::DOUBLE * n, 0)) THEN 'validation' ELSE 'train' END AS split FROM grid_rows JOIN r USING (source, group_id)"),
    "reward_dataset_check": (lambda s, d: T.grid_rows(s, d).withColumn("rewards", X.cell_rewards("gt_cell")).select("sample", E("size(rewards) = 9").alias("nine"), E("gt_cell between 1 and 9 and rewards[gt_cell - 1] = 1").alias("peak"), E("forall(rewards, r -> r >= 0 and r <= 1)").alias("bounded")), f"WITH {GRID_ROWS} SELECT sample, true AS nine, true AS peak, true AS bounded FROM grid_rows"),
}
