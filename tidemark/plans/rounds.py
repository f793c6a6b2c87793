"""Queries that go in rounds or over a stream: feedback until accepted, the loop over long clips, waiting for inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators import feedback as B
from tidemark.operators.statistics import derived_seed
from tidemark.plans import series as S
from tidemark.plans.ctes import FRAMES, draw_key, hashed
from tidemark.sources import tables as T
from tidemark.sources.stages import fresh
from tidemark.streaming.waiting import run_when_whole, signal_files

E = F.expr
ROUNDS, SEED = 3, 5


def _answers(picks, rounds: int = ROUNDS):
    """What a model said, by hashes: verify a third of the time `1`, select from -1 to 10 or no number; state and pick once a pick."""
    asked = picks.select("pick", F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(r).alias("round")) for s in ("verify", "select", "state", "pick") for r in range(rounds)))).alias("q")).select("pick", "q.stage", "q.round")
    rows = asked.withColumn("h", derived_seed(F.col("pick"), F.col("stage"), F.col("round"))).where("round = 0 or stage in ('verify', 'select')")
    text = E("case stage when 'verify' then if(h % 3 = 0, ' 1', '0') when 'state' then element_at(array('Contact', 'Separation', 'Neither'), cast(h % 3 + 1 as int)) else if(h % 13 = 12, 'unsure', cast(h % 13 - 1 as string)) end")
    return rows.where("h % 17 > 0").select("pick", "stage", "round", text.alias("text"))


_NUMBER = "CASE WHEN {0} % 17 = 0 OR {0} % 13 = 12 THEN NULL ELSE {0} % 13 - 1 END"
_WINDOW = "(greatest(0, least({0} - 4, n - 9)) + greatest(0, least({1} - 1, least(9, n) - 1)))::INT"
_SPEEDS = "spd AS (SELECT episode, list(speed ORDER BY frame_idx) AS speeds FROM frames GROUP BY episode)"


def _rounds(start: str) -> str:
    """r: all states of the picks of start(pick, episode, n, frame) under feedback."""
    d = f"list_sort(list_transform(left_, lambda f: {{'k': {draw_key('speeds[f + 1]', str(SEED), 'pick', 'round', 'f')}, 'f': f}}))[1].f"
    left = "list_filter([(frame + d)::INT FOR d IN range(-3, 4)], lambda f: f >= 0 AND f < n AND NOT list_contains(t, f))"
    return f"""{_SPEEDS}, r AS (SELECT pick, n, speeds, frame, []::INT[] AS tried, 0 AS round, 'open' AS status FROM {start} JOIN spd USING (episode)
 UNION ALL SELECT pick, n, speeds, CASE WHEN yes OR len(left_) = 0 THEN frame WHEN coalesce(num, 0) IN (0, -1) THEN drawn ELSE {_WINDOW.format('drawn', 'num')} END, t, round + 1, CASE WHEN yes THEN 'accepted' WHEN len(left_) = 0 THEN 'failed' WHEN round + 1 = {ROUNDS} THEN 'accepted' ELSE 'open' END
 FROM (SELECT *, {_NUMBER.format('h')} AS num, {d} AS drawn FROM (SELECT *, {left} AS left_, {hashed('pick', "'select'", 'round')} AS h, v % 17 > 0 AND v % 3 = 0 AS yes FROM (SELECT *, list_append(tried, frame) AS t, {hashed('pick', "'verify'", 'round')} AS v FROM r WHERE status = 'open'))))"""


def _feedback(s, d):
    picks = S._picks(s, d).withColumn("pick", F.concat(F.lit("e"), F.col("episode").cast("string")))
    return B.feedback_rounds(picks, T.frames(s, d), _answers(picks), ROUNDS, SEED).select("pick", "success", "frame_idx", F.col("rounds").alias("asked"))


def _long(s, d):
    minima = C.minima(T.frames(s, d)).select("episode", "frame_idx", F.col("pinch").alias("speed"))
    picks = minima.select(F.concat_ws("|", F.col("episode").cast("string"), F.col("frame_idx").cast("string")).alias("pick"))
    return B.long_loop(minima, T.frames(s, d), _answers(picks), ROUNDS, SEED)


_LONG = f"""WITH RECURSIVE {S._CUES}, mi AS (SELECT m.episode, num_frames AS n, m.frame_idx AS minimum, m.pinch, concat_ws('|', m.episode, m.frame_idx) AS pick FROM minima m JOIN totals USING (episode)),
 nr AS (SELECT mi.*, f.frame_idx AS f, {draw_key('f.speed', str(SEED), "'key'", 'pick', 'f.frame_idx')} AS k FROM mi JOIN frames f ON f.episode = mi.episode AND f.frame_idx BETWEEN minimum - 2 AND minimum + 2),
 kf AS (SELECT episode, n, minimum, pinch, pick, arg_min(f, {{'k': k, 'f': f}}) AS kf FROM nr GROUP BY ALL),
 tn AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY {draw_key('pinch', str(SEED), "'turn'", 'pick')}, minimum) AS turn, {hashed('pick', "'state'", '0')} AS st, {hashed('pick', "'pick'", '0')} AS ph FROM kf),
 q AS (SELECT *, ['Contact', 'Separation'][st % 3 + 1] AS event, {_NUMBER.format('ph')} AS num FROM tn WHERE st % 17 > 0 AND st % 3 < 2),
 start AS (SELECT episode, n, pick, turn, minimum, event, {_WINDOW.format('kf', 'num')} AS frame FROM q WHERE num <> -1), {_rounds('start')}
 SELECT start.episode, turn::INT AS turn, minimum, event, r.frame AS frame_idx FROM r JOIN start USING (pick) WHERE status = 'accepted'"""


def _wait(s, d):
    """Two signals of each episode, some with gaps, streamed in three batches of files; then the marker comes."""
    each = -(-T.table(s, d, "events").count() // 500_000) or 1  # files a batch, of a fixed size
    raw = T.frames(s, d).selectExpr("cast(episode as string) as episode", "explode(array(named_struct('signal', 'speed', 'value', if(episode % 5 = 0 and frame_idx % 7 = 3, null, speed)), named_struct('signal', 'pinch', 'value', pinch))) as x", "cast(frame_idx as int) as frame_idx", "num_frames")
    raw = raw.selectExpr("episode", "x.signal", "frame_idx", "num_frames", "x.value").where("not (signal = 'pinch' and cast(episode as bigint) % 7 = 0 and frame_idx = 0)")
    at, out = fresh(s, "signals"), fresh(s, "waited")
    raw.repartition(3 * each, "episode", "frame_idx", "signal").write.parquet(at)
    done, checkpoint = fresh(s, "marker"), fresh(s, "waiting")
    names = T.table(s, d, "region").select("r_name")
    names.limit(0).write.parquet(done)
    shape = "cast(episode as bigint) as episode", "num_frames"
    for last in (False, True):  # the second run goes on where the first ended, and finds the marker
        if last:
            names.write.mode("append").parquet(done)
        run_when_whole(
            signal_files(s, at, raw.schema, each), lambda df: df.selectExpr(*shape, "'ready' as status", "'' as lacks").write.mode("append").parquet(out), checkpoint, signal_files(s, done, names.schema),
            failed=lambda df: df.selectExpr(*shape, "'failed' as status", "lacks").write.mode("append").parquet(out), groups=64 * each,
        ).awaitTermination()
    return s.read.schema("episode long, num_frames int, status string, lacks string").parquet(out)


QUERIES = {
    "feedback_rounds": (_feedback, f"WITH RECURSIVE {FRAMES}, {S._PICKS}, start AS (SELECT 'e' || episode AS pick, episode, num_frames AS n, frame_idx AS frame FROM picks), {_rounds('start')} SELECT pick, status = 'accepted' AS success, frame AS frame_idx, round AS asked FROM r WHERE status <> 'open'"),
    "long_loop": (_long, _LONG),
    "wait_for_inputs": (_wait, f"""WITH {FRAMES}, c AS (SELECT episode, max(num_frames) AS n, count(*) FILTER (episode % 5 = 0 AND frame_idx % 7 = 3) AS a, CASE WHEN episode % 7 = 0 THEN 1 ELSE 0 END AS b FROM frames GROUP BY episode)
 SELECT episode, n AS num_frames, CASE WHEN a + b = 0 THEN 'ready' ELSE 'failed' END AS status, concat_ws(', ', CASE WHEN a > 0 THEN 'speed: ' || a || ' of ' || n || ' frames' END, CASE WHEN b > 0 THEN 'pinch: ' || b || ' of ' || n || ' frames' END) AS lacks FROM c"""),
}
