"""Stacked tensors in files as a Spark data source: one row a frame, planned by ranges of frames, read by member.

    register(spark)
    spark.read.format("tidemark_tensors").option("path", "/data/*.npz").load().where("frame between 3 and 9")

A .npy file holds one stack (frames x height x width ...); a .npz archive one stack under `member`, or a member for each
frame whose name ends in its number. A partition is a range of frames of a file. Filters on frame and file prune at
planning, so members outside them are never opened; a stored stack is read from the place of the range's first frame,
a compressed one is inflated up to its last. Objects are never unpickled.

Paths are such that driver and executors can open them (a mounted or shared folder).
"""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

SCHEMA = "file string, frame int, shape array<int>, values array<double>"


def header(f: BinaryIO) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of a stack at the current place; leaves the place at its data."""
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran or kind.hasobject or not shape:
        raise ValueError("a stack in row order, of plain numbers, is wanted")
    return shape, kind


def frames_of(archive: zipfile.ZipFile) -> dict[int, str]:
    """Members by frame, of an archive with one for each."""
    found = {}
    for name in archive.namelist():
        if m := re.search(r"(\d+)\.npy$", name):
            found[int(m[1])] = name
    return found


def stack_name(archive: zipfile.ZipFile, member: str | None) -> str | None:
    """The member that holds all frames, if one does."""
    names = archive.namelist()
    wanted = f"{member}.npy" if member else names[0] if len(names) == 1 and not re.search(r"\d+\.npy$", names[0]) else None
    if member and wanted not in names:
        raise ValueError(f"no member {member}")
    return wanted


def numbers(path: str, member: str | None) -> list[int]:
    """The frames in a file, from headers and the archive's directory alone."""
    if path.endswith(".npy"):
        with open(path, "rb") as f:
            return list(range(header(f)[0][0]))
    with zipfile.ZipFile(path) as z:
        name = stack_name(z, member)
        if name is None:
            return sorted(frames_of(z))
        with z.open(name) as f:
            return list(range(header(f)[0][0]))


def stack(f: BinaryIO, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    shape, kind = header(f)
    size = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
    f.seek(first * size, io.SEEK_CUR)
    for i in range(first, last + 1):
        yield i, np.frombuffer(f.read(size), kind).reshape(shape[1:])


@dataclass
class Range(D.InputPartition):
    path: str
    frames: tuple[int, ...]

    def read(self, member: str | None) -> Iterator[tuple[int, np.ndarray]]:
        if self.path.endswith(".npy"):
            with open(self.path, "rb") as f:
                yield from stack(f, self.frames[0], self.frames[-1])
            return
        with zipfile.ZipFile(self.path) as z:
            name = stack_name(z, member)
            if name is not None:
                with z.open(name) as f:
                    yield from stack(f, self.frames[0], self.frames[-1])
                return
            names = frames_of(z)
            for i in self.frames:
                with z.open(names[i]) as f:
                    yield i, np.lib.format.read_array(f, allow_pickle=False)


class Reader(D.DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("option path: files or patterns, parted by commas")
        self.member, self.each = options.get("member"), int(options.get("framesperpartition", 64))
        self.paths = [p.removeprefix("file://") for p in options["path"].split(",")]
        self.low, self.high, self.only, self.files = float("-inf"), float("inf"), None, None

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Takes bounds on frame and equality on file; the rest goes back to Spark."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("frame",) and isinstance(f, D.EqualTo | D.GreaterThan | D.GreaterThanOrEqual | D.LessThan | D.LessThanOrEqual):
                if isinstance(f, D.EqualTo | D.GreaterThan | D.GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, D.GreaterThan))
                if isinstance(f, D.EqualTo | D.LessThan | D.LessThanOrEqual):
                    self.high = min(self.high, value - isinstance(f, D.LessThan))
            elif name == ("frame",) and isinstance(f, D.In):
                self.only = set(value) if self.only is None else self.only & set(value)
            elif name == ("file",) and isinstance(f, D.EqualTo):
                self.files = {value} if self.files is None else self.files & {value}
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for pattern in self.paths:
            for path in sorted(glob.glob(os.path.join(pattern, "*.np[yz]") if os.path.isdir(pattern) else pattern)):
                if self.files is None or path in self.files:
                    asked = [i for i in numbers(path, self.member) if self.low <= i <= self.high and (self.only is None or i in self.only)]
                    out += [Range(path, tuple(asked[i : i + self.each])) for i in range(0, len(asked), self.each)]
        return out

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # nothing was planned
            return
        asked = set(partition.frames)
        for i, values in partition.read(self.member):
            if i in asked:
                yield partition.path, i, list(values.shape), values.astype(float).ravel().tolist()


class TensorSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorSource)
