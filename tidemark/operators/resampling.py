"""Mergeable bootstrap: how often a row comes in a resample is a hash of (seed, row, resample).

The counts are Poisson with mean 1, so resamples need no order, no group size and no shared random state: each task adds
up its rows' counts and weighted values for every resample, Spark adds the tasks, and the interval is the quantiles of
the resamples' means. A group may lie in any number of tasks, and a seed gives one result however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.statistics import derived_seed

#: Count k from the k-th threshold of a 32-bit hash on: the distribution function of Poisson(1).
THRESHOLDS = [int(2**32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(12)]
# Shifts and odd multipliers of a 32-bit integer mix, and the step between resamples.
SHIFTS, FACTORS, STEP = (16, 15, 16), (0x7FEB352D, 0x846CA68B), 0x9E3779B9
CELLS = 1 << 21  # counts made at once


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(SHIFTS[0]))
    x = x * np.uint32(FACTORS[0])
    x = x ^ (x >> np.uint32(SHIFTS[1]))
    x = x * np.uint32(FACTORS[1])
    return x ^ (x >> np.uint32(SHIFTS[2]))


def counts(rows: np.ndarray, resamples: int) -> np.ndarray:
    """rows x resamples counts of 32-bit row hashes."""
    step = np.arange(resamples, dtype=np.uint32) * np.uint32(STEP)
    h = mixed(mixed(rows.astype(np.uint32))[:, None] ^ step[None, :])
    return np.searchsorted(np.array(THRESHOLDS, np.uint64), h.astype(np.uint64), "right")


def resample_sums(rows: DataFrame, by: str, value: str, order: list[str], seed: int, resamples: int) -> DataFrame:
    """by, resample, n, total: rows in each resample and the sum of their values. order names a row; equal rows share their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        names = ["by_", "resample", "n", "total"]

        def sent() -> pa.RecordBatch:
            groups = [g for g in total for _ in range(resamples)]
            n, s = (np.concatenate([t[k] for t in total.values()]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(groups, kind), pa.array(np.tile(np.arange(resamples, dtype=np.int32), len(total))), pa.array(n.astype(np.int64)), pa.array(s)], names=names)

        kind = None
        for b in batches:
            kind = b.schema.field("by_").type
            groups = np.array(b.column("by_").to_pylist(), dtype=object)
            keys, values = b.column("row_").to_numpy(), b.column("value_").to_numpy().astype(float)
            for g in dict.fromkeys(groups):
                own = np.flatnonzero(groups == g) if g is not None else np.flatnonzero([x is None for x in groups])
                n, s = total.setdefault(g, (np.zeros(resamples), np.zeros(resamples)))
                for i in range(0, len(own), max(1, CELLS // resamples)):
                    at = own[i : i + max(1, CELLS // resamples)]
                    c = counts(keys[at], resamples).astype(float)
                    n += c.sum(0)
                    s += values[at] @ c
            if len(total) * resamples > CELLS:
                yield sent()
                total.clear()
        if total:
            yield sent()

    fine = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    parts = rows.where(fine).select(F.col(by).alias("by_"), derived_seed(F.lit(seed), *map(F.col, order)).alias("row_"), F.col(value).cast("double").alias("value_"))
    made = parts.mapInArrow(run, f"by_ {dict(rows.dtypes)[by]}, resample int, n long, total double")
    return made.groupBy(F.col("by_").alias(by), "resample").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def merged_bootstrap(rows: DataFrame, by: str, value: str, order: list[str], seed: int, resamples: int = 10_000, level: float = 0.95) -> DataFrame:
    """by, mean, n, low, high: percentile interval of each group's mean; of one finite value itself twice, groups of none are left out."""
    fine = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    plain = rows.groupBy(by).agg(F.avg(fine).alias("mean"), F.count(fine).alias("n")).where("n > 0")
    means = resample_sums(rows, by, value, order, seed, resamples).where("n > 0").groupBy(F.col(by).alias("g_"))
    ends = [(1 - level) / 2, (1 + level) / 2]
    spread = means.agg(F.percentile(F.col("total") / F.col("n"), F.array(*map(F.lit, ends))).alias("ends"))
    low, high = (F.when(F.col("n") == 1, F.col("mean")).otherwise(F.col("ends")[i]).alias(name) for i, name in ((0, "low"), (1, "high")))
    return plain.join(spread, F.col(by).eqNullSafe(F.col("g_"))).select(by, "mean", "n", low, high)


def paired_bootstrap(rows: DataFrame, by: str, a: str, b: str, order: list[str], seed: int, resamples: int = 10_000) -> DataFrame:
    """by, difference (mean of a - b), n, low, high over the rows where both are finite numbers."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (a, b)]
    pairs = rows.where(finite[0] & finite[1]).withColumn("difference_", F.col(a) - F.col(b))
    return merged_bootstrap(pairs, by, "difference_", order, seed, resamples).withColumnRenamed("mean", "difference")
