"""Shared plumbing of the training-data operators: tables, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh one if all run in one process (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.isLocal:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def tidy(spark: SparkSession) -> None:
    """From now on shuffle files go when the query that wrote them ends; a query that is run again writes them again."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder, in partitions by its last column if that is named, and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    tidy(spark)
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored = path
    return out


def bucketed(df: DataFrame, label: str, key: str, parts: int) -> DataFrame:
    """As materialize, in as many buckets by key as a shuffle has partitions: joins by key read it as it lies, however often. df should come from a shuffle by key, so a task has few buckets."""
    spark = df.sparkSession
    tidy(spark)
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tidemark/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(name)
    out = spark.table(name)
    out.stored, out.table_name = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() and bucketed() that nothing reads any more."""
    for t in tables:
        if "table_name" in t.__dict__:
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.table_name}")
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches that Python workers get, so that long texts stay within memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df on at most one task for `each` of its rows: small tables take few tasks, however many partitions a shuffle has."""
    return df.coalesce(max(1, -(-rows // each)))


def numbered(df: DataFrame, group: str, order: list[Column], rows: int) -> DataFrame:
    """df, stored in sorted runs, with idx (place in its group by order, from 0) and n (rows of the group).

    Runs are ranges of (group, order), so a large group lies in many; the counts of the runs, a row for each run and
    group in it, give where each begins.
    """
    runs = df.repartitionByRange(-(-rows // 50_000) or 1, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    runs = materialize(runs.withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)), "runs")
    heads = runs.groupBy(group, "run").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    of = Window.partitionBy(group)
    heads = heads.select(group, "run", (F.sum("size").over(of.orderBy("run")) - F.col("size") - F.col("first")).alias("shift"), F.sum("size").over(of).alias("n"))
    heads = materialize(spread(heads, rows), "heads")  # stored, so its size is known before the join
    return runs.join(heads, [group, "run"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "run", "shift")


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find over edges(a, b): alternating large-star and small-star until nothing moves.

    Returns (node, component) for each node that has an edge; component is the smallest node reachable.
    Each turn is DataFrame joins and partial aggregates on hashed keys; the driver gets a count and a checksum.
    """
    u, v = F.col("u"), F.col("v")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(u != v).distinct()
    sign, before, rows = None, None, 0
    while True:
        edges = materialize(edges, "star")
        if before is not None:
            discard(before)
        before = edges
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64(u, v).cast("decimal(38,0)"))).first()
        if seen == sign or not seen[0]:
            break
        sign, rows = seen, seen[0]
        # large-star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = spread(edges.unionAll(edges.select(v.alias("u"), u.alias("v"))), 2 * rows)
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = spread(both.join(low, "u").where(v > u).select(v.alias("u"), F.least("u", "m").alias("v")), 2 * rows)
        # small-star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = spread(large.join(low, "u"), 2 * rows).select(F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v")).where(u != v)
        edges = spread(edges.distinct(), rows)
    out = edges.select(u.alias("node"), v.alias("component"))
    out = out.unionAll(edges.select(v.alias("node"), v.alias("component")).distinct())
    return spread(out, 2 * rows)


def joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """label(node, component) with the components that links(a, b) join; only links between components go through union-find."""
    if label is None:
        return materialize(components(links), "labels")
    rows = label.count() + 2 * links.count()
    name = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    ends = spread(spread(links.join(name("a"), "a", "left"), rows).join(name("b"), "b", "left"), rows)
    ends = materialize(ends.select("a", "b", F.coalesce("a_component", "a").alias("c"), F.coalesce("b_component", "b").alias("d")), "ends")
    roots = components(ends.select(F.col("c").alias("a"), F.col("d").alias("b")))
    every = label.unionAll(ends.select("a", "c")).unionAll(ends.select("b", "d")).distinct()
    out = spread(every, rows).join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    out = materialize(spread(out, rows).select("node", F.coalesce("root", "component").alias("component")), "labels")
    discard(ends)
    return out
