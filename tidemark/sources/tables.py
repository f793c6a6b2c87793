"""Frame series, trials, answers and inventories over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

E = F.expr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per episode and 0-based frame: speed (0 where unknown), detected, pinch distance, hand centre x, y."""
    by = Window.partitionBy("episode")
    return table(spark, sf_dir, "events").withColumnRenamed("user_id", "episode").select(
        "episode",
        (F.row_number().over(by.orderBy("ts", "event_id")) - 1).alias("frame_idx"),
        F.count("*").over(by).cast("int").alias("num_frames"),
        E("if(event_type = 'error', 0D, value)").alias("speed"),
        E("event_type <> 'signup'").alias("detected"),
        F.col("value").alias("pinch"),
        F.col("value").alias("x"),
        E("cast(event_id % 97 as double)").alias("y"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, num_frames, and the labels of contact and separation (null: unavailable)."""
    return (
        table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count("*").cast("int").alias("num_frames"))
        .select("episode", "num_frames", E("if(episode % 17 = 0, null, cast(episode * 7 % num_frames as int))").alias("contact"), E("if(episode % 23 = 0, null, cast((episode * 7 + 3) % num_frames as int))").alias("separation"))
    )


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, task, num_frames, gt: the available labels in long form."""
    long = episodes(spark, sf_dir).selectExpr("episode", "num_frames", "stack(2, 'contact', contact, 'separation', separation) as (task, gt)")
    return long.where("gt is not null")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key (episode, task, mode, trial): prediction (null or -1: none), status, seed, recall, latency."""
    raw = table(spark, sf_dir, "events").where("event_type in ('click', 'view', 'purchase')").selectExpr(
        "user_id as episode", "if(event_id % 2 = 0, 'contact', 'separation') as task",
        "case event_type when 'click' then 'speed' when 'view' then 'pinch' else 'speed_pinch' end as mode",
        "cast(event_id div 2 % 3 as int) as trial", "event_id",
        "case when event_id % 11 = 0 then null when event_id % 13 = 0 then -1 else cast(floor(value) as int) % 60 end as prediction",
        "if(event_id % 11 = 0, 'failed', 'success') as status", "event_id % 4 > 0 as recall", "value as latency",
    )
    latest = Window.partitionBy("episode", "task", "mode", "trial").orderBy(F.desc("event_id"))
    return raw.withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn")


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hand_id, video, hand and kp: 21 points with x, y and confidence."""
    points = "transform(sequence(0, 20), i -> named_struct('x', cast(embedding[3 * i] as double), 'y', cast(embedding[3 * i + 1] as double), 'conf', cast(embedding[3 * i + 2] as double)))"
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hand_id"), E("vec_id div 2").alias("video"), E("cast(vec_id % 2 as int)").alias("hand"), E(points).alias("kp"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and completion: whole texts with no, one or two answer blocks."""
    block = "concat('{\"points\": [', cast(doc_id % 11 - 1 as string), ']}')"
    return table(spark, sf_dir, "documents").selectExpr("doc_id as id", f"case when doc_id % 7 = 0 then text when doc_id % 5 = 0 then concat('{{\"points\": [2]}} no ', {block}) when doc_id % 13 = 0 then concat('{{\"points\": [2, 3]}} ', {block}) else concat(text, {block}) end as completion")


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled grid rows: sample, task, source, group, gt_cell, gt_frame, frame_indices, cell (predicted), status."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.selectExpr(
        "doc_id as sample", "if(toxic = 0, 'contact', 'separation') as task", "source", "doc_id div 9 as group_id",
        "cast(doc_id % 9 + 1 as int) as gt_cell", "cast(10 * (doc_id div 9) + doc_id % 9 as int) as gt_frame",
        "transform(sequence(0, 8), i -> cast(10 * (doc_id div 9) + i as int)) as frame_indices",
        "cast(case when doc_id % 7 = 0 then null else doc_id * 5 % 11 end as int) as cell", "if(doc_id % 19 = 0, 'error', 'success') as status",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, folder, suffix, size, readable of an inventory."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url as path", "regexp_extract(url, '^https?://([^/]+)', 1) as folder", "regexp_extract(url, '[.]([a-z0-9]+)$', 1) as suffix", "cast(length(html) as bigint) as size", "page_id % 10 > 0 as readable")
