"""Tables kept up to date batch by batch: the latest record of each key, and roll-ups from mergeable partials."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class LatestView:
    """The latest record of each key, as Parquet by bucket of the key.

    apply() merges a batch into the buckets that it touches and rewrites those alone. Of records with one key the one
    with the greatest `order` stays, of equals the one already there, so a batch may come again. What is to be written
    is staged first and named in a pending file; a rewrite that broke off is done again from there before anything else.
    One writer at a time; readers see each bucket as it was or as it is.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _exists(self, path: str) -> bool:
        p, fs = _files(self.spark, path)
        return fs.exists(p)

    def _write(self, path: str, text: str) -> None:
        p, fs = _files(self.spark, path)
        out = fs.create(p, True)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def _delete(self, path: str) -> None:
        p, fs = _files(self.spark, path)
        fs.delete(p, True)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self) -> DataFrame:
        self.recover()
        return self._table().drop("bucket")

    def _table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def recover(self) -> None:
        """Finishes a rewrite that broke off."""
        if self._exists(f"{self.path}/pending"):
            p, fs = _files(self.spark, f"{self.path}/pending")
            staged = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "utf-8")
            self._swap(staged)

    def _swap(self, staged: str) -> None:
        rows = self.spark.read.parquet(staged)
        rows.repartition(self.buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        self._delete(f"{self.path}/pending")
        self._delete(staged)

    def apply(self, batch: DataFrame) -> list[int]:
        """Merges a batch and names the buckets that it rewrote."""
        self.recover()
        best = lambda rows: rows.groupBy(self.key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != self.key)), self.order).alias("r_")).select(self.key, "r_.*")
        new = best(batch).withColumn("bucket", self.bucket())
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most `buckets` numbers
        if not touched:
            return []
        merged = new
        if self._exists(f"{self.path}/rows"):
            old = self._table().where(F.col("bucket").isin(touched)).select(*new.columns)
            newer = new.join(old.select(F.col(self.key).alias("k_"), F.col(self.order).alias("o_")), F.col(self.key) == F.col("k_"), "left").where(F.col("k_").isNull() | (F.col(self.order) > F.col("o_"))).select(*new.columns)
            merged = old.join(newer.select(self.key), self.key, "left_anti").select(*new.columns).unionByName(newer)
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        merged.write.parquet(staged)
        self._write(f"{self.path}/pending", staged)
        self._swap(staged)
        return touched


class Rollups:
    """Partials of batches, merged at read.

    A partial counts the rows of a batch that agree in the dimensions and in the measures; from such counts sums, means
    and exact percentiles of all batches together follow. A batch id names a partition, so a batch that comes again
    replaces itself and counts once. Partials are as many as distinct rows, not as rows.
    """

    def __init__(self, spark: SparkSession, path: str, dimensions: tuple[str, ...], measures: tuple[str, ...]):
        self.spark, self.path, self.dimensions, self.measures = spark, path.rstrip("/"), dimensions, measures

    def add(self, batch_id: int, rows: DataFrame) -> None:
        parts = rows.groupBy(*self.dimensions, *self.measures).agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch_id))
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def merged(self) -> DataFrame:
        """Dimensions, measures and n over all batches."""
        return self.spark.read.parquet(self.path).groupBy(*self.dimensions, *self.measures).agg(F.sum("n").alias("n"))

    def compact(self, into: int, batches: list[int]) -> None:
        """Puts several batches into the one named `into`, which should be among them; the others are left empty, so a replay of theirs must not come any more."""
        old = self.spark.read.parquet(self.path).where(F.col("batch").isin(batches))
        whole = old.groupBy(*self.dimensions, *self.measures).agg(F.sum("n").alias("n"))
        staged = f"{self.path}-staged-{uuid.uuid4().hex}"
        whole.write.parquet(staged)
        self.spark.read.parquet(staged).withColumn("batch", F.lit(into)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)
        for p in (f"{self.path}/batch={b}" for b in batches if b != into):
            path, fs = _files(self.spark, p)
            fs.delete(path, True)
        path, fs = _files(self.spark, staged)
        fs.delete(path, True)


def counted_mean(value: str) -> Column:
    """Mean of rows with counts n."""
    v = F.col(value).cast("double")
    return F.sum(v * F.col("n")) / F.sum(F.when(v.isNotNull(), F.col("n")))


def counted_percentile(value: str, share: float) -> Column:
    return F.percentile(F.col(value).cast("double"), F.lit(share), F.col("n"))


def counted_metrics() -> list[Column]:
    """The aggregates of rollups.metrics() over merged partials of (error, normalized, recall)."""
    total, good = F.sum("n"), F.coalesce(F.sum(F.when(F.col("error").isNotNull(), F.col("n"))), F.lit(0))
    return [
        total.alias("total"), good.alias("successful"), (total - good).alias("failed"), F.round((total - good) / total, 6).alias("failure_rate"), F.round(counted_mean("error"), 6).alias("mean_error"),
        F.round(counted_percentile("error", 0.5), 6).alias("median_error"), F.round(counted_mean("normalized"), 9).alias("mean_normalized"), F.round(counted_percentile("normalized", 0.5), 9).alias("median_normalized"), F.round(counted_mean("recall"), 6).alias("recall"),
    ]
