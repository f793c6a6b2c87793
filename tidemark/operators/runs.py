"""Scans over series of any length: sorted runs, a carry from run to run, and rows with their carry.

A window function puts a whole series in one task. Here the rows are range-partitioned by (series, order), so a long
series lies in many runs; each run is reduced to one small row (its sum, largest or last value), the carry of a run is
the reduction of the runs before it, and the rows of a run are scanned in a task of their own, from the carry on. The
only window over a whole series is over its runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.stages import stored

RUN = "run_"


def in_runs(df: DataFrame, by: list[str], order: list[str], rows: int = 200_000) -> DataFrame:
    """df, stored, with the number of its run; about `rows` rows a run, in order of (by, order). Orders within a series should be unique."""
    df = df if "stored" in df.__dict__ else stored(df, "series")  # the range partitioning reads it more than once
    n = df.count()
    keys = [F.col(c) for c in (*by, *order)]
    placed = df.repartitionByRange(max(1, -(-n // rows)), *keys).withColumn(RUN, F.spark_partition_id())
    return stored(placed, "runs")


def carried(runs: DataFrame, by: list[str], order: list[str], how: dict[str, tuple[str, Column]], backwards: bool = False) -> DataFrame:
    """runs with the columns of how: name -> (kind, value), each over the rows of the series before the row.

    kind: sum (0 at the start), max (null), last (the last value that is not null). backwards: over the rows after it.
    """
    turn = [F.col(c).desc() if backwards else F.col(c) for c in order]
    sign = F.desc(RUN) if backwards else F.asc(RUN)
    place = F.struct(*order)
    reduce = {
        "sum": lambda v: F.sum(v), "max": lambda v: F.max(v),
        "last": lambda v: (F.min_by if backwards else F.max_by)(v, F.when(v.isNotNull(), place)),
    }
    over = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}
    heads = runs.groupBy(*by, RUN).agg(*(reduce[kind](value).alias(name) for name, (kind, value) in how.items()))
    before = Window.partitionBy(*by).orderBy(sign).rowsBetween(Window.unboundedPreceding, -1)
    heads = stored(heads.select(*(F.col(c).alias(f"{c}_of") for c in (*by, RUN)), *(over[kind](F.col(name)).over(before).alias(f"{name}_carry") for name, (kind, _) in how.items())), "carries")
    same = runs[RUN] == heads[f"{RUN}_of"]
    for c in by:
        same = same & runs[c].eqNullSafe(heads[f"{c}_of"])
    out = runs.join(heads, same)
    here = Window.partitionBy(*by, RUN).orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)
    columns = []
    for name, (kind, value) in how.items():
        own, carry = over[kind](value).over(here), F.col(f"{name}_carry")
        join = {"sum": F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)), "max": F.greatest(own, carry), "last": F.coalesce(own, carry)}
        columns.append(join[kind].alias(name))
    return out.select(*runs.columns, *columns)
