"""Validation as DataFrames of violations: nothing raises in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

E = F.expr
CELLS = 9


def violations(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """key and rule for each row and rule whose SQL condition for being wrong holds."""
    found = F.array_compact(F.array(*(F.when(E(wrong), F.lit(name)) for name, wrong in rules.items())))
    return rows.select(F.col(key), F.explode(found).alias("rule"))


#: For label rows: start_frame, end_frame, num_frames, labels (local and global) and availability.
MANIFEST = {
    "length": "end_frame - start_frame + 1 <> num_frames",
    "contact_range": "contact_local is not null and contact_local not between 0 and num_frames - 1",
    "contact_global": "contact_local is not null and contact_global <> start_frame + contact_local",
    "contact_availability": "(contact_local is null) <> (contact_global is null)",
    "order": "contact_local is not null and separate_local is not null and separate_local < contact_local",
}

#: For one request trace with its trial: stage, mode, used frames, seed, latency.
TRACE = {
    "mode": "trace.mode <> mode",
    "seed": "trace.seed <> seed",
    "size": "size(trace.used) not in (1, 9)",
    "range": "exists(trace.used, f -> f < 0 or f >= num_frames)",
    "single": "size(trace.used) = 1 and not contains(trace.stage, 'visual_feedback')",
    "unique": "size(trace.used) = 9 and size(array_distinct(trace.used)) <> 9",
    "consecutive": "size(trace.used) = 9 and not forall(zip_with(slice(trace.used, 2, 8), slice(trace.used, 1, 8), (b, a) -> b - a), x -> x = 1)",
    "latency": "trace.latency is null or trace.latency < 0",
}

#: For one trial: what its mode may read, counts by cue, and its fallback.
ISOLATION = {
    "reads": "reads_speed <> (mode in ('speed', 'speed_pinch')) or reads_pinch <> (mode in ('pinch', 'speed_pinch'))",
    "cells": "speed_n + pinch_n + neutral_n <> 9",
    "leak": "(mode = 'speed' and pinch_n <> 0) or (mode = 'pinch' and speed_n <> 0)",
    "fallback_kind": "fallback_kind <> if(mode = 'pinch', 'chronological', 'speed_ranked')",
    "fallback_count": "fallback_n <> size(fallback_frames)",
}


def series_check(frames: DataFrame, totals: DataFrame, value: str = "speed") -> DataFrame:
    """Per episode: frames that are missing or extra against 0..n-1, repeated ones, and values that are no finite number from 0."""
    wanted = totals.select("episode", F.explode(E("sequence(0, num_frames - 1)")).alias("frame_idx"))
    have = frames.groupBy("episode", "frame_idx").agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull() | F.isnan(value) | (F.col(value) < 0) | (F.col(value) == float("inf"))).alias("bad"))
    both = wanted.withColumn("wanted", F.lit(True)).join(have, ["episode", "frame_idx"], "full_outer")
    return both.groupBy("episode").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))


def neighborhood_check(caches: DataFrame) -> DataFrame:
    """caches(episode, num_frames, minima, neighborhood, detected): which of the cache's rules hold."""
    near = E("array_sort(array_distinct(filter(flatten(transform(minima, m -> array(m - 1, m, m + 1))), f -> f >= 0 and f < num_frames)))")
    return caches.select(
        "episode", (F.col("minima") == F.array_sort(F.array_distinct("minima"))).alias("sorted"), (F.col("neighborhood") == near).alias("near"),
        (F.size(F.array_except("minima", "detected")) == 0).alias("detected"), E("forall(neighborhood, f -> f >= 0 and f < num_frames)").alias("bounded"),
    )


def cache_plan(caches: DataFrame, force: bool = False) -> DataFrame:
    """recompute: the cache or its metadata is not valid, or it is forced."""
    return caches.withColumn("recompute", F.lit(force) | ~F.coalesce("valid", F.lit(False)) | ~F.coalesce("metadata_valid", F.lit(False)))


def input_gate(episodes: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """ready: long enough, video and metadata valid, and each signal that the modes need."""
    needs_speed = F.lit(bool({"speed", "speed_pinch"} & set(modes)))
    needs_pinch = F.lit(bool({"pinch", "speed_pinch"} & set(modes)))
    return episodes.withColumn("ready", (F.col("num_frames") >= CELLS) & F.col("video_valid") & F.col("metadata_valid") & (~needs_speed | F.col("speed_valid")) & (~needs_pinch | F.col("pinch_valid")))


def similarity(a: str, b: str) -> Column:
    """1 less the mean absolute difference over 255, at least 0; 0 for different sizes."""
    far = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - far / 255.0))


def source_frames(files: DataFrame) -> DataFrame:
    """Per episode: names contiguous from 0, one size of image, total bytes."""
    return files.groupBy("episode").agg(
        F.count("*").alias("n"), (F.countDistinct("width", "height") == 1).alias("uniform"), F.sum("bytes").alias("bytes"),
        ((F.min("index") == 0) & (F.max("index") == F.count("*") - 1) & (F.countDistinct("index") == F.count("*"))).alias("contiguous"),
    )


def summary(counts: DataFrame) -> DataFrame:
    """counts(missing, unexpected, duplicate, errors): complete, valid and success; partial data never is a success."""
    out = counts.withColumn("complete", E("missing = 0 and unexpected = 0 and duplicate = 0")).withColumn("valid", F.col("errors") == 0)
    return out.withColumn("success", F.col("complete") & F.col("valid"))


def conversion(episodes: DataFrame) -> DataFrame:
    """status (converted, reused or error) and error of rows(episode, labels_valid, source_valid, there, output_valid, force), by episode.

    What is there is reused if it is valid and force is not set; else it is made anew. An output that fails its check is
    an error either way. force may be missing.
    """
    reuse = F.col("there") & ~F.col("force") if "force" in episodes.columns else F.col("there")
    bad = F.when(~F.col("labels_valid"), "labels").when(~F.col("source_valid"), "source").when(reuse & ~F.col("output_valid"), "output")
    return episodes.select("episode", F.when(bad.isNotNull(), "error").when(reuse, "reused").otherwise("converted").alias("status"), bad.alias("error"))
