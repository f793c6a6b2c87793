"""Paired statistics: ranks and Holm over scopes of any size, probabilities from their sums, bootstrap of short lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.runs import carried, in_runs
from tidemark.sources.stages import stored

E = F.expr


def derived_seed(*parts: Column) -> Column:
    """The first 8 hex digits of sha256 of the parts, parted by |, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 8), 16, 10).cast("bigint")


def holm(rows: DataFrame, family: str, p: str = "p", tie: str = "id", run: int = 200_000) -> DataFrame:
    """Holm-adjusted probabilities within each family; null and NaN stay null and do not count.

    A family may be of any size: its order lies in runs of about `run` rows, whose counts and largest steps are carried.
    """
    fine = F.col(p).isNotNull() & ~F.isnan(p)
    own = [family]
    tests = rows.where(fine)
    placed = carried(in_runs(tests, own, [p, tie], run), own, [p, tie], {"before": ("sum", F.lit(1))})
    size = tests.groupBy(F.col(family).alias("family_")).agg(F.count("*").alias("tests_"))
    steps = placed.join(size, F.col(family).eqNullSafe(F.col("family_"))).withColumn("step", F.least(F.lit(1.0), (F.col("tests_") - F.col("before")) * F.col(p)))
    steps = stored(steps.drop("family_", "tests_", "before"), "steps")
    out = carried(steps, own, [p, tie], {"most": ("max", F.col("step"))}).withColumn("adjusted", F.greatest("step", "most"))
    return out.select(*rows.columns, "adjusted").unionByName(rows.where(~fine).withColumn("adjusted", F.lit(None).cast("double")))


def size_counts(differences: DataFrame, by: str, value: str = "difference") -> DataFrame:
    """by, size, up, down: how many differences of each absolute size other than 0 are positive and negative. NaN and null do not count."""
    rows = differences.where((F.col(value) != 0) & ~F.isnan(value))
    return rows.groupBy(by, F.abs(value).alias("size")).agg(F.count_if(F.col(value) > 0).alias("up"), F.count_if(F.col(value) < 0).alias("down"))


def signed_ranks(differences: DataFrame, by: str, value: str = "difference", run: int = 200_000) -> DataFrame:
    """Sums of the average ranks of absolute non-zero differences, by sign; n, and ties: the sum of c ** 3 - c over groups of c equal sizes.

    The rows of a scope are counted by size before anything is ordered; the sizes lie in runs, whose counts are carried,
    so a scope of any number of sizes is ranked in many tasks.
    """
    sizes = in_runs(size_counts(differences, by, value), [by], ["size"], run)
    n = F.col("up") + F.col("down")
    ranked = carried(sizes, [by], ["size"], {"before": ("sum", n)}).withColumn("rank", F.col("before") + (n + 1) / F.lit(2.0))
    c = n.cast("double")
    return ranked.groupBy(by).agg(F.sum(F.col("rank") * F.col("up")).alias("positive"), F.sum(F.col("rank") * F.col("down")).alias("negative"), F.sum(n).alias("n"), F.sum(c * c * c - c).alias("ties"))


def rank_biserial() -> Column:
    """Of signed_ranks; 0 where every difference is 0."""
    return F.coalesce((F.col("positive") - F.col("negative")) / (F.col("positive") + F.col("negative")), F.lit(0.0))


def conclusion(mode_a: str = "mode_a", mode_b: str = "mode_b") -> Column:
    """A mode is superior only if sign, confidence interval and adjusted probability (< 0.05) agree."""
    clear = F.col("adjusted") < 0.05
    a = (F.col("difference") < 0) & (F.col("high") < 0) & clear
    b = (F.col("difference") > 0) & (F.col("low") > 0) & clear
    return F.when(a, F.concat(F.col(mode_a), F.lit(" superior"))).when(b, F.concat(F.col(mode_b), F.lit(" superior"))).otherwise("inconclusive/mode-dependent")


def bootstrap(values: np.ndarray, seed: int, resamples: int = 10_000, level: float = 0.95) -> tuple[float | None, float | None]:
    """Percentile interval of the mean; of no value none, of one value itself twice. The order of values matters."""
    values = np.asarray(values, float)
    values = values[np.isfinite(values)]
    if len(values) < 2:
        return (None, None) if not len(values) else (float(values[0]),) * 2
    r = np.random.default_rng(seed)
    means = np.concatenate([values[r.integers(0, len(values), (min(1000, resamples - i), len(values)))].mean(axis=1) for i in range(0, resamples, 1000)])
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def signed_rank_probability(w: float, n: int, zeros: bool, ties: float) -> float:
    """Two-sided probability of the lesser rank sum w of n non-zero differences: exact up to 50 without ties or zeros, else normal with tie correction."""
    if not n:
        return 1.0
    if n <= 50 and not zeros and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[: len(ways) - k]
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(math.erfc(abs(w - mean) / math.sqrt(2 * var))) if var > 0 else 1.0


def wilcoxon_p(differences: np.ndarray) -> tuple[float | None, float | None]:
    """Statistic and probability of a short list; of none null, of zeros alone 0 and 1."""
    d = np.asarray(differences, float)
    if not len(d):
        return None, None
    zeros, d = bool((d == 0).any()), d[d != 0]
    value, where, count = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[where]
    w = float(min(rank[d > 0].sum(), rank[d < 0].sum())) if len(d) else 0.0
    return w, signed_rank_probability(w, len(d), zeros, float((count**3 - count).sum()))


def wilcoxon(differences: DataFrame, by: str, value: str = "difference", run: int = 200_000) -> DataFrame:
    """by, statistic, p, effect (rank-biserial): from the rank sums of signed_ranks, one row a scope; the probability is worked out from that row."""
    known = differences.where(F.col(value).isNotNull() & ~F.isnan(value))
    zeros = known.groupBy(F.col(by).alias("by_")).agg(F.max(F.col(value) == 0).alias("zeros"))
    rows = zeros.join(signed_ranks(known, by, value, run), F.col(by).eqNullSafe(F.col("by_")), "left").select(F.col("by_").alias(by), "zeros", rank_biserial().alias("effect"), F.coalesce(F.least("positive", "negative"), F.lit(0.0)).alias("statistic"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ties", F.lit(0.0)).alias("ties"))

    def p(w: pd.Series, n: pd.Series, zeros: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_probability(*x) for x in zip(w, n, zeros, ties, strict=True)], dtype=float)

    return rows.select(by, "statistic", F.pandas_udf(p, "double")("statistic", "n", "zeros", "ties").alias("p"), "effect")
