"""Readers and writers: JSON lines, signal caches, the append-only result store, inventories."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.lines import PLACE, json_rows, place, read_lines, tails

# What a result may end as.
STATUSES = ("success", "terminal_failure", "failed", "error")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON lines with `line`, their place; malformed lines have only _corrupt_record. The last record of a key is the one of the largest line."""
    rows = json_rows(read_lines(spark, path), schema)
    return rows.select(place().alias("line"), *(c for c in rows.columns if c not in PLACE))


def torn_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose last line lacks its newline: only that line may be dropped, any other bad one is an error."""
    return tails(read_lines(spark, path)).select(F.col("file").alias("path"), "torn")


def speed_series(rows: DataFrame, base: int = 0) -> DataFrame:
    """episode, frame_idx, speed of caches(episode, value): a JSON object of frames or a list of [frame, speed]; null speed is NaN."""
    pairs = F.transform(F.from_json("value", "array<array<double>>"), lambda p: F.struct(p[0].cast("int").alias("key"), p[1].alias("value")))
    long = rows.withColumn("kind", F.substring(F.trim("value"), 1, 1)).select("episode", F.explode(F.when(F.col("kind") == "{", F.transform(F.map_entries(F.from_json("value", "map<string,double>")), lambda p: F.struct(p["key"].cast("int").alias("key"), p["value"].alias("value")))).otherwise(pairs)).alias("p"))
    return long.select("episode", (F.col("p.key") - base).alias("frame_idx"), F.coalesce("p.value", F.lit(float("nan"))).alias("speed"))


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def content_hash(value: object, without: tuple[str, ...] = ()) -> str:
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if k not in without}
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def sample_id(task: Column, dataset: Column, row: dict[str, Column]) -> Column:
    """sha256 of the canonical JSON of task, dataset_name and the row's fields, null ones too: keys sorted, no spaces."""
    fields = {"task": task, "dataset_name": dataset} | row
    text = F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), F.coalesce(_json(fields[k]), F.lit("null"))) for k in sorted(fields)))
    return F.sha2(F.concat(F.lit("{"), text, F.lit("}")), 256)


def _json(value: Column) -> Column:
    """A value as JSON, cut out of an object of one field; null stays null."""
    text = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substr(text, F.lit(6), F.length(text) - 6))


class StoreBusy(RuntimeError):
    """Another writer holds the store."""


class ResultStore:
    """Append-only Parquet store with unique keys and one config hash.

    A writer holds a lock file beside the store while it appends; a second one gets StoreBusy. A lock that is older than
    `stale` seconds was left by a writer that died, and is taken over.
    """

    def __init__(self, spark: SparkSession, path: str, config_hash: str, stale: float = 3600.0):
        self.spark, self.path, self.config, self.stale = spark, path.rstrip("/"), config_hash, stale

    @contextmanager
    def writing(self):
        lock = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}.lock")
        files = lock.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.createNewFile(lock):
            if time.time() - files.getFileStatus(lock).getModificationTime() / 1000 < self.stale:
                raise StoreBusy(self.path)
            files.delete(lock, False)
            if not files.createNewFile(lock):
                raise StoreBusy(self.path)
        try:
            yield
        finally:
            files.delete(lock, False)

    def exists(self) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def append(self, rows: DataFrame) -> int:
        """Adds rows(key, status, ...) whose keys are new and says how many; so a repeated append writes nothing.

        Rows with an unknown status, or a store of another configuration, are errors. The store is read once, its keys
        alone; the count comes from the write.
        """
        with self.writing():
            return self._append(rows)

    def _append(self, rows: DataFrame) -> int:
        if not rows.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).isEmpty():
            raise ValueError("unknown status")
        seen = Observation()
        new = rows.dropDuplicates(["key"]).withColumn("config_hash", F.lit(self.config))
        if self.exists():
            if not self.read().where(F.col("config_hash") != self.config).isEmpty():
                raise ValueError("the store has another configuration")
            new = new.join(self.read().select("key"), "key", "left_anti")
        new.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(self.path)
        return seen.get["n"]


def inventory(spark: SparkSession, root: str, pattern: str = "*", hash_below: int = 100_000_000) -> DataFrame:
    """path, size, suffix and sha256 (null for large files) of the files below root; .git and .venv are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    files = files.where(~F.col("path").rlike(r"/(\.git|\.venv)/"))
    return files.select("path", F.col("length").alias("size"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), F.when(F.col("length") < hash_below, F.sha2("content", 256)).alias("sha256"))


def write_report(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report in one file; reports have bounded numbers of rows."""
    writer = rows.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """The first rows of a report as a table; null reads as a dash."""
    cols = rows.columns
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()]) + "\n"


def atomic_json(path: str | Path, value: object) -> None:
    """Writes canonical JSON so that readers see the old file or the new one whole, and the new one survives a crash. The driver's files only."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.{time.time_ns()}")
    try:
        with part.open("w", encoding="utf-8") as f:
            f.write(canonical_json(value) + "\n")
            f.flush()
            os.fsync(f.fileno())
        part.replace(path)
        folder = os.open(path.parent, os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)
    finally:
        part.unlink(missing_ok=True)


def append_status(path: str | Path, record: dict) -> None:
    """One line of canonical JSON at the end of a file, under a lock; a torn last line of an earlier crash gets its newline first."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab+") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        size = f.seek(0, os.SEEK_END)
        torn = False
        if size:
            f.seek(size - 1)
            torn = f.read(1) != b"\n"
        f.write(b"\n" * torn + (canonical_json(record) + "\n").encode())
        f.flush()
        os.fsync(f.fileno())


def archive(paths: list[str | Path], into: str | Path, stamp: str | None = None) -> Path | None:
    """Moves the files that exist into a new folder named by the time, and returns it; None if there is nothing to move."""
    there = [Path(p) for p in paths if Path(p).exists()]
    if not there:
        return None
    name = stamp or time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
    folder, k = Path(into) / name, 1
    while folder.exists():
        folder, k = Path(into) / f"{name}-{k}", k + 1
    folder.mkdir(parents=True)
    for p in there:
        p.rename(folder / p.name)
    return folder


def predictions(path: str | Path, rows: list | None = None) -> list:
    """A JSON list of predictions: written if rows are given, else read; a file that is missing is made, empty."""
    path = Path(path)
    if rows is not None or not path.exists():
        atomic_json(path, rows or [])
    return json.loads(path.read_text())


def config_snapshot(settings: dict, code: list[str | Path]) -> dict:
    """settings with code_sha256, the digest of each code file by name, and config_hash of it all: what a run is stored under."""
    digests = {Path(p).name: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in code}
    out = settings | {"code_sha256": digests}
    return out | {"config_hash": content_hash(out)}
