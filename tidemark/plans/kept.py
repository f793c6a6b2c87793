"""Queries over one long recording, and over tables that batches keep up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import long_series as L
from tidemark.operators import rollups as U
from tidemark.plans import reports as Q
from tidemark.plans import series as S
from tidemark.plans.ctes import FRAMES
from tidemark.sources import lines as N
from tidemark.sources import tables as T
from tidemark.sources import views as V
from tidemark.sources.stages import fresh

E = F.expr
RUN = 2_500  # frames of a run: several at any size of the tables
RECORDING = """frames AS (SELECT 0::BIGINT AS episode, event_id AS frame_idx, event_type <> 'signup' AS detected, value AS pinch, value AS x, (event_id % 97)::DOUBLE AS y, value AS speed, 1 AS num_frames FROM events WHERE event_id % 41 < 40)"""


def _recording(s, d):
    """All events as one recording with some frames missing."""
    return T.table(s, d, "events").where("event_id % 41 < 40").selectExpr("0L as episode", "event_id as frame_idx", "event_type <> 'signup' as detected", "value as x", "cast(event_id % 97 as double) as y", "value as pinch")


def _of(name: str) -> str:
    """A series query's SQL over the recording."""
    return S.QUERIES[name][1].replace(FRAMES, RECORDING)


def _batches(rows, key: str, n: int = 3):
    for i in range(n):
        yield i, rows.where(F.pmod(F.col(key), F.lit(n)) == i)


def _view(s, d):
    view = V.LatestView(s, fresh(s, "view"), "user_id", "event_id", buckets=8)
    for _, rows in _batches(T.table(s, d, "events").select("event_id", "user_id", "event_type"), "event_id"):
        view.apply(rows)
    return view.read().select("event_id", "user_id", "event_type")


def _rollups(s, d):
    """Event rows in three batches, the last of them twice."""
    kept = V.Rollups(s, fresh(s, "partials"), ("task", "mode"), ("error", "normalized", "recall"))
    for i, rows in _batches(Q._events(s, d), "episode"):
        kept.add(i, rows)
    kept.add(i, rows)
    return U.grouping_sets(kept.merged(), [("task", "mode"), ("mode",)], ("task", "mode"), V.counted_metrics())


def _lines(s, d):
    """Events as JSON lines in several files; of each user the last line, in order of files."""
    at = fresh(s, "lines")
    rows = T.table(s, d, "events").select("event_id", "user_id", "event_type")
    rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.json(at)
    found, _ = N.strict_rows(s, rows.schema, at)
    return N.latest(found, "user_id").select("event_id", "user_id", "event_type")


QUERIES = {
    "long_gap_speed": (lambda s, d: L.detected_speed(_recording(s, d), run=RUN).select(*S.KEYS, S.R6("speed")), _of("gap_speed")),
    "long_interp_speed": (lambda s, d: L.interpolated_speed(_recording(s, d), run=RUN).select(*S.KEYS, S.R6("speed")), _of("interp_speed")),
    "long_minima": (lambda s, d: L.minima(_recording(s, d), run=RUN).select(*S.KEYS, S.R6("pinch")), _of("pinch_minima")),
    "kept_latest": (_view, Q.QUERIES["latest_per_key"][1]),
    "kept_rollups": (_rollups, Q.QUERIES["scope_rollup"][1]),
    "latest_lines": (_lines, Q.QUERIES["latest_per_key"][1]),
}
