"""The same views as sources/tables.py in the SQL of the oracle."""

FRAMES = """frames AS (SELECT user_id AS episode, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_idx,
 (count(*) OVER (PARTITION BY user_id))::INT AS num_frames, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS speed,
 event_type <> 'signup' AS detected, value AS pinch, value AS x, (event_id % 97)::DOUBLE AS y FROM events)"""
EPISODES = """episodes AS (SELECT episode, num_frames, CASE WHEN episode % 17 = 0 THEN NULL ELSE (episode * 7 % num_frames)::INT END AS contact,
 CASE WHEN episode % 23 = 0 THEN NULL ELSE ((episode * 7 + 3) % num_frames)::INT END AS separation
 FROM (SELECT user_id AS episode, count(*)::INT AS num_frames FROM events GROUP BY user_id))"""
TRUTHS = EPISODES + """, truths AS (SELECT episode, num_frames, 'contact' AS task, contact AS gt FROM episodes WHERE contact IS NOT NULL
 UNION ALL SELECT episode, num_frames, 'separation', separation FROM episodes WHERE separation IS NOT NULL)"""
TRIALS = """trials AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY episode, task, mode, trial ORDER BY event_id DESC) AS rn FROM (
 SELECT user_id AS episode, CASE WHEN event_id % 2 = 0 THEN 'contact' ELSE 'separation' END AS task,
 CASE event_type WHEN 'click' THEN 'speed' WHEN 'view' THEN 'pinch' ELSE 'speed_pinch' END AS mode, (event_id // 2 % 3)::INT AS trial, event_id,
 CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -1 ELSE floor(value)::INT % 60 END AS prediction,
 CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status, event_id % 4 > 0 AS recall, value AS latency
 FROM events WHERE event_type IN ('click', 'view', 'purchase'))) WHERE rn = 1)"""
HANDS = """hands AS (SELECT vec_id AS hand_id, vec_id // 2 AS video, (vec_id % 2)::INT AS hand,
 [{'x': embedding[3 * i + 1]::DOUBLE, 'y': embedding[3 * i + 2]::DOUBLE, 'conf': embedding[3 * i + 3]::DOUBLE} FOR i IN range(21)] AS kp FROM embeddings)"""
COMPLETIONS = """completions AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN text
 WHEN doc_id % 5 = 0 THEN '{"points": [2]} no ' || b WHEN doc_id % 13 = 0 THEN '{"points": [2, 3]} ' || b ELSE text || b END AS completion
 FROM (SELECT doc_id, text, '{"points": [' || (doc_id % 11 - 1)::VARCHAR || ']}' AS b FROM documents))"""
GRID_ROWS = """grid_rows AS (SELECT doc_id AS sample, CASE WHEN toxic = 0 THEN 'contact' ELSE 'separation' END AS task, source, doc_id // 9 AS group_id,
 (doc_id % 9 + 1)::INT AS gt_cell, (10 * (doc_id // 9) + doc_id % 9)::INT AS gt_frame, [(10 * (doc_id // 9) + i)::INT FOR i IN range(9)] AS frame_indices,
 (CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id * 5 % 11 END)::INT AS cell, CASE WHEN doc_id % 19 = 0 THEN 'error' ELSE 'success' END AS status
 FROM documents JOIN labels USING (doc_id))"""
FILES = """files AS (SELECT page_id, url AS path, regexp_extract(url, '^https?://([^/]+)', 1) AS folder, regexp_extract(url, '[.]([a-z0-9]+)$', 1) AS suffix,
 length(html) AS size, page_id % 10 > 0 AS readable FROM pages)"""


def hashed(*parts: str) -> str:
    """statistics.derived_seed of SQL expressions."""
    return "('0x' || substr(sha256(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::BIGINT"


def draw_key(speed: str, *parts: str) -> str:
    """feedback.exponential_key of SQL expressions."""
    return f"-ln(({hashed(*parts)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE) * ({speed} + 1e-8::DOUBLE)"


def drawn(by: str, speed: str, seed: int) -> str:
    """feedback.weighted_draw as an aggregate."""
    return f"arg_min(frame_idx, {{'k': {draw_key(speed, str(seed), by, 'frame_idx')}, 'f': frame_idx}})"
