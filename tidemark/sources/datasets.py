"""Loaders of data sets: checked tables, strict JSON lines, labelled grid rows, image folders, training logs, annotations."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.lines import PLACE, place, strict_rows

E = F.expr


def column_faults(have: list[str], want: list[str]) -> list[tuple[int, str | None, str | None]]:
    """Place, wanted and found name of each column that is not where it must be."""
    n = max(len(have), len(want))
    pad = lambda x: [*x, *[None] * (n - len(x))]
    return [(i, w, h) for i, (w, h) in enumerate(zip(pad(want), pad(have), strict=True)) if w != h]


def read_checked(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV table, or the first sheet of a workbook, whose columns are exactly those of the schema, in order; else an error.

    A workbook is a bounded file of labels: it is read on the driver, and needs the package that pandas reads it with.
    """
    if path.lower().endswith((".xlsx", ".xls")):
        sheet = pd.read_excel(path, dtype=object)
        have = [str(c) for c in sheet.columns]
    else:
        first = spark.read.text(path).limit(1).collect()  # one line
        have = next(csv.reader([first[0][0]]), []) if first else []
    if faults := column_faults(have, schema.names):
        raise ValueError(f"{path}: columns differ: " + ", ".join(f"{i}: {w!r} wanted, {h!r} found" for i, w, h in faults))
    if path.lower().endswith((".xlsx", ".xls")):
        return spark.createDataFrame(sheet.astype(object).where(sheet.notna(), None).values.tolist(), schema)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, bool]:
    """Rows of JSON lines (one file or more) with their place `at`, and whether the last line of a file was torn (has no newline): such a line is dropped.

    Blank lines are skipped; any other line that is not JSON is an error, which is raised here.
    """
    rows, torn = strict_rows(spark, schema, path)
    return rows.select(place().alias("at"), *(c for c in rows.columns if c not in PLACE)), bool(torn)


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path of a list that is there, on any file system that Spark reads."""
    for c in candidates:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(c)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return c
    return None


# Where data sets and signal caches lie.
TRAIN = ("train/metadata.jsonl", "metadata.jsonl")
EVALUATION = ("validation/metadata.jsonl", "eval/metadata.jsonl", "eval_metadata.jsonl")
SIGNALS = {"speed": ("metrics/{}_hand_speed.json", "{}_speed.json"), "pinch": ("metrics/{}_pinch_distance.json", "{}_pinch.json")}
HANDS = {"either": "{}_speed.json", "left": "{}_speed_left.json", "right": "{}_speed_right.json"}


def metadata_path(spark: SparkSession, root: str, train: bool) -> str | None:
    """The metadata file of a data set; without one, training is an error and evaluation None."""
    found = first_existing(spark, [f"{root.rstrip('/')}/{c}" for c in (TRAIN if train else EVALUATION)])
    if found is None and train:
        raise FileNotFoundError(f"no training metadata under {root}")
    return found


def signal_path(spark: SparkSession, root: str, name: str, signal: str = "speed", hand: str | None = None) -> str:
    """The cache of a clip's signal: the first layout that is there, else where it would be written; a hand has a file of its own."""
    layouts = (HANDS[hand],) if hand else SIGNALS[signal]
    paths = [f"{root.rstrip('/')}/{c.format(name)}" for c in layouts]
    return first_existing(spark, paths) or paths[0]


GRID = "file_name string, prompt string, video_source string, video_index int, gt_frame int, gt_cell int, cell_number int, frame_indices array<int>, offset int"


def grid_metadata(lines: DataFrame, task: Column | str, folder: Column | str, value: str = "value") -> DataFrame:
    """Labelled grid rows of JSON lines whose labels stand in `metadata` or beside it: image path, prompt, answer, task, source, labels.

    gt_cell comes before cell_number. lines may have a column `split`, which stays.
    """
    r = F.from_json(value, f"{GRID}, metadata struct<{', '.join(f'{n}:{t}' for n, t in (f.split(' ') for f in GRID.split(', ')[2:]))}>")
    rows = lines.where(F.trim(value) != "").withColumn("r", r)
    own = lambda c: F.coalesce(F.col(f"r.metadata.{c}"), F.when(F.col("r.metadata").isNull(), F.col(f"r.{c}")))
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    cell = F.coalesce(own("gt_cell"), own("cell_number"))
    out = rows.select(*[c for c in lines.columns if c == "split"], F.concat_ws("/", lit(folder), F.col("r.file_name")).alias("image"), F.col("r.prompt").alias("prompt"), lit(task).alias("task"), *(own(c).alias(c) for c in ("video_source", "video_index", "gt_frame")), cell.alias("cell_number"), own("frame_indices").alias("frame_indices"), own("offset").alias("offset"))
    return out.withColumn("answer", F.concat(F.lit('{"points": ['), F.col("cell_number").cast("string"), F.lit("]}")))


def tagged_metadata(spark: SparkSession, root: str, task: str) -> DataFrame:
    """grid_metadata of a data set's train and validation files, with their split."""
    lines = spark.read.text([p for p in (metadata_path(spark, root, True), metadata_path(spark, root, False)) if p])
    lines = lines.withColumn("split", F.when(F.input_file_name().rlike("/(validation|eval)/|eval_metadata"), "validation").otherwise("train"))
    return grid_metadata(lines, task, root.rstrip("/"))


def image_folder(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """split, path, size and content of the images of a folder with a sub-folder for each split; all splits must be there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower("path").rlike(r"[.](png|jpe?g|bmp|webp)$"))
    rows = files.withColumn("split", F.regexp_extract("path", rf"/({'|'.join(splits)})/[^/]+(?:/[^/]+)*$", 1)).where("split <> ''")
    missing = {*splits} - {r[0] for r in rows.select("split").distinct().collect()}  # as many as splits
    if missing:
        raise ValueError(f"{root}: no images of {sorted(missing)}")
    return rows.select("split", "path", F.col("length").alias("size"), "content")


LOG = "step bigint, epoch double, loss double, eval_loss double, reward double, learning_rate double, grad_norm double"


def trainer_log(spark: SparkSession, pattern: str) -> DataFrame:
    """The loss rows of the trainer state with the highest step among the files of a pattern: path and the columns of LOG."""
    files = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", f"global_step bigint, log_history array<struct<{LOG.replace(' ', ':').replace(',:', ',')}>>").alias("s"))
    best = files.agg(F.max_by("path", F.struct("s.global_step", "path")).alias("path"))
    rows = files.join(F.broadcast(best), "path").select("path", F.explode("s.log_history").alias("h")).select("path", "h.*")  # one row
    return rows.where("loss is not null")


SUMMARY = "path string, suffix string, size_bytes bigint, readable boolean, kind string, top_keys string, num_items bigint, error string"
_KINDS = {dict: "dict", list: "list", str: "str", int: "int", float: "float", bool: "bool", type(None): "NoneType"}


def _summary(suffix: str, text: str) -> tuple[str, str, int | None]:
    """kind, first 30 keys or columns, and number of items of one annotation file."""
    keys = lambda x: ",".join([*x][:30])
    if suffix == ".json":
        value = json.loads(text)
        lead = value[0] if isinstance(value, list) and value else value
        return _KINDS[type(value)], keys(lead) if isinstance(lead, dict) else "", len(value) if isinstance(value, dict | list) else None
    if suffix == ".jsonl":
        rows = [x for x in text.split("\n") if x.strip()]
        lead = json.loads(rows[0]) if rows else None
        return "jsonl", keys(lead) if isinstance(lead, dict) else "", len(rows)
    if suffix == ".csv":
        rows = list(csv.reader(io.StringIO(text, newline="")))
        return "csv", keys(rows[0]) if rows else "", max(0, len(rows) - 1)
    if suffix == ".txt":
        rows = text.splitlines()
        return "txt", rows[0][:200] if rows else "", len(rows)
    return suffix.lstrip("."), "", None


def annotation_summary(files: DataFrame) -> DataFrame:
    """SUMMARY of each of files(path, content binary, size_bytes): kind, keys and items, or the error that reading gave.

    Serialized objects (.pkl, .pickle) are never loaded, as loading can run code: they have a kind and no items.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for path, content, size in zip(pdf["path"], pdf["content"], pdf["size_bytes"], strict=True):
                suffix = Path(path).suffix.lower()
                try:
                    kind, top, n = _summary(suffix, bytes(content).decode("utf-8", "replace"))
                    out.append((path, suffix, size, True, kind, top, n, None))
                except ValueError as error:
                    out.append((path, suffix, size, False, "", "", None, f"{type(error).__name__}: {error}"))
            rows = pd.DataFrame(out, columns=[f.split(" ")[0] for f in SUMMARY.split(", ")])
            yield rows.astype({"num_items": "Int64"})

    return files.select("path", "content", "size_bytes").mapInPandas(run, SUMMARY)
