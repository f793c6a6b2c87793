"""Lines of text files with their place: file, block and order in the block, or exact byte offsets.

A large file is read in splits, many small ones in one task, so a row number over partitions is no order of lines. Each
line here has the file, the byte at which its split begins and its order within the split; (block, at) is the order of
lines in a file whatever the splits, and (file, block, at) one over files. Only "\\n" ends a line; a "\\r" before it goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PLACE = ("file", "block", "at")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file, block, at, value, bytes (with the line's end, if it has one or not), size (of the file) of each line."""
    lines = spark.read.text(list(paths), lineSep="\n")
    m = F.col("_metadata")
    return lines.select(m.file_path.alias("file"), m.file_block_start.alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"), (F.octet_length("value") + 1).cast("long").alias("bytes"), m.file_size.alias("size"))


def place() -> Column:
    """Orders lines."""
    return F.struct(*PLACE)


def offsets(lines: DataFrame) -> DataFrame:
    """lines with offset, the byte at which each begins: the bytes of the splits before, and of the lines before in its split."""
    splits = lines.groupBy("file", "block").agg(F.sum("bytes").alias("n"))
    before = splits.select(F.col("file").alias("f_"), F.col("block").alias("b_"), (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    here = F.sum("bytes").over(Window.partitionBy("file", "block").orderBy("at")) - F.col("bytes")
    return lines.withColumn("here", here).join(before, (F.col("file") == F.col("f_")) & (F.col("block") == F.col("b_"))).withColumn("offset", F.col("here") + F.col("before")).drop("here", "before", "f_", "b_")


def tails(lines: DataFrame) -> DataFrame:
    """file, last (place of its last line), torn (that line has no end) of each file with a line."""
    return lines.groupBy("file").agg(F.max(place()).alias("last"), (F.sum("bytes") > F.max("size")).alias("torn"))


def json_rows(lines: DataFrame, schema: StructType) -> DataFrame:
    """file, block, at, the fields, and _corrupt_record (null but where a line is not JSON); blank lines are left out."""
    fields = StructType([*schema.fields]).add("_corrupt_record", "string")
    parsed = F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.where(F.trim("value") != "").select(*PLACE, parsed.alias("r")).select(*PLACE, "r.*")


class NotJson(ValueError):
    """A line other than a torn last one is not JSON."""


def strict_rows(spark: SparkSession, schema: StructType, *paths: str) -> tuple[DataFrame, list[str]]:
    """json_rows of whole files, and the files whose torn last line was dropped. Any other line that is not JSON is an error."""
    lines = read_lines(spark, *paths)
    ends = tails(lines).where("torn").select("last")
    rows = json_rows(lines.join(ends, place() == F.col("last"), "left_anti"), schema)
    bad = rows.where("_corrupt_record is not null").orderBy(*PLACE).select("file", "_corrupt_record").first()
    if bad is not None:
        raise NotJson(f"{bad['file']}: a line is not JSON: {bad['_corrupt_record'][:80]!r}")
    torn = sorted(r["file"] for r in ends.select("last.file").collect())  # files, of which one writer leaves one
    return rows.drop("_corrupt_record"), torn


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last record of each key, by file and place in it."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), place()).alias("r_")).select(*keys, "r_.*")
