"""Keys, joins and set differences over manifests, trials and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

E = F.expr
KEY = ("episode", "task", "mode", "trial")
MODES = ("speed", "pinch", "speed_pinch")


def manifest_join(labels: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per episode of either side with its status: paired, missing or extra segment."""
    both = labels.join(segments, "episode", "full_outer")
    status = F.when(F.col("label_frames").isNull(), "extra").when(F.col("segment_frames").isNull(), "missing").when(F.col("label_frames") != F.col("segment_frames"), "mismatch").otherwise("paired")
    return both.withColumn("status", status)


def expected_keys(truths: DataFrame, trials: int = 3) -> DataFrame:
    """Every mode and trial of each available label; a bounded number of keys for each row, without a cross join."""
    modes = F.explode(F.array(*map(F.lit, MODES)))
    return truths.select("episode", "task", modes.alias("mode")).withColumn("trial", F.explode(E(f"sequence(0, {trials - 1})")))


def difference(left: DataFrame, right: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(*key).join(right.select(*key).distinct(), list(key), "left_anti")


def duplicate_keys(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def retry_plan(plan: DataFrame, latest: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Keys without a result, and those whose latest one is no success if retry_failed."""
    both = plan.join(latest.select(*KEY, "status"), list(KEY), "left")
    again = F.col("status") != "success" if retry_failed else F.lit(False)
    return both.where(F.col("status").isNull() | again).select(*KEY, F.coalesce("status", F.lit("new")).alias("reason"))


def paired_errors(events: DataFrame, mode_a: str, mode_b: str) -> DataFrame:
    """Errors of both modes for events where both have one."""
    side = lambda m, name: events.where((F.col("mode") == m) & F.col("error").isNotNull()).select("episode", "task", F.col("error").alias(name))
    return side(mode_a, "a").join(side(mode_b, "b"), ["episode", "task"]).withColumn("difference", F.col("a") - F.col("b"))


def paired_modes(events: DataFrame, modes: tuple[str, ...], scopes: bool = True) -> DataFrame:
    """episode, task, scope, mode_a, mode_b, difference (error of a less that of b) for each two modes, in their order, of an event that both have.

    One pass: the errors of an event meet in one row, from which its pairs come. scopes: each row also in scope `combined`.
    """
    wide = events.where(F.col("mode").isin(*modes) & F.col("error").isNotNull()).groupBy("episode", "task").agg(*(F.max(F.when(F.col("mode") == m, F.col("error"))).alias(f"e{i}") for i, m in enumerate(modes)))
    pairs = F.array(*(F.struct(F.lit(a).alias("mode_a"), F.lit(b).alias("mode_b"), (F.col(f"e{i}") - F.col(f"e{j}")).alias("difference")) for i, a in enumerate(modes) for j, b in enumerate(modes) if i < j))
    names = F.array("task", F.lit("combined")) if scopes else F.array("task")
    long = wide.select("episode", "task", F.explode(pairs).alias("p")).select("episode", "task", "p.*").where("difference is not null")
    return long.withColumn("scope", F.explode(names))


def select_episodes(tokens: DataFrame, known: DataFrame, limit: int | None = None) -> DataFrame:
    """Zero-padded ids of tokens(pos, token) in order of first mention, marked known or unknown."""
    padded = tokens.select("pos", F.lpad(F.trim("token"), 6, "0").alias("episode")).where("episode <> '000000'")
    first = padded.groupBy("episode").agg(F.min("pos").alias("pos"))
    out = first.join(known.select(F.lpad(F.col("episode").cast("string"), 6, "0").alias("episode"), F.lit(True).alias("known")).distinct(), "episode", "left")
    out = out.withColumn("known", F.coalesce("known", F.lit(False)))
    return out.orderBy("pos").limit(limit) if limit else out


def asset_pairing(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """Which of three lists have each id."""
    mark = lambda t, name: t.select("id").distinct().withColumn(name, F.lit(True))
    out = mark(first, "a").join(mark(second, "b"), "id", "full_outer").join(mark(third, "c"), "id", "full_outer")
    has = [F.coalesce(c, F.lit(False)).alias(c) for c in ("a", "b", "c")]
    return out.select("id", *has)
