"""Trial roll-ups, summaries at several granularities, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

E = F.expr


def rounded_mean(prediction: str = "prediction") -> Column:
    """Half-even mean of the predictions that are not negative; null if there are none."""
    return F.bround(F.avg(F.when(F.col(prediction) >= 0, F.col(prediction).cast("double")))).cast("int")


def event_rows(trials: DataFrame, truths: DataFrame) -> DataFrame:
    """Trials rolled up by event and mode: prediction, error, normalized error, counts, recall, partial flag."""
    out = trials.join(truths, ["episode", "task"]).groupBy("episode", "task", "mode", "num_frames", "gt").agg(
        rounded_mean().alias("prediction"), F.count("*").alias("recorded"), F.count_if(F.col("prediction") >= 0).alias("valid"),
        F.count_if(F.col("status") != "success").alias("failed"), F.bool_or("recall").alias("recall"), (F.bool_or("recall") == F.bool_and("recall")).alias("consistent"),
    )
    error = F.abs(F.col("prediction") - F.col("gt")).cast("double")
    return out.withColumn("error", error).withColumn("normalized", error / F.greatest(F.lit(1), F.col("num_frames") - 1)).withColumn("partial", F.col("valid") < F.col("recorded"))


def metrics() -> list[Column]:
    """Aggregates of event rows: failed events count in totals, not in means."""
    return [
        F.count("*").alias("total"), F.count("error").alias("successful"), (F.count("*") - F.count("error")).alias("failed"),
        F.round((F.count("*") - F.count("error")) / F.count("*"), 6).alias("failure_rate"), F.round(F.avg("error"), 6).alias("mean_error"), F.round(F.percentile("error", F.lit(0.5)), 6).alias("median_error"),
        F.round(F.avg("normalized"), 9).alias("mean_normalized"), F.round(F.percentile("normalized", F.lit(0.5)), 9).alias("median_normalized"), F.round(F.avg(F.col("recall").cast("double")), 6).alias("recall"),
    ]


def eval_metrics() -> list[Column]:
    """Aggregates of scored rows: rates over all rows, frame error over rows that have one."""
    rate = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 6)
    return [
        F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if("parsed").alias("parsed_n"), rate("parsed").alias("parse_rate"), rate("valid").alias("valid_rate"),
        rate("exact").alias("accuracy"), F.round(F.avg("frame_error"), 6).alias("frame_mae"), F.count("frame_error").alias("mae_n"), F.round(F.sum("reward"), 6).alias("reward_sum"), F.round(F.avg("reward"), 6).alias("reward_mean"),
    ]


def grouping_sets(rows: DataFrame, sets: list[tuple[str, ...]], columns: tuple[str, ...], aggregates: list[Column]) -> DataFrame:
    """One aggregation over several grouping sets; a column outside a set reads `all`."""
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*aggregates, *(F.grouping(c).alias(f"g_{c}") for c in columns))
    return out.select(*(F.when(F.col(f"g_{c}") == 1, "all").otherwise(F.col(c)).alias(c) for c in columns), *(c for c in out.columns if c not in columns and not c.startswith("g_")))


def run_summary(requests: DataFrame, by: str) -> DataFrame:
    """Mean, median and sample deviation of token rates, and totals over wall time."""
    return requests.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg("rate"), 6).alias("mean"), F.round(F.percentile("rate", F.lit(0.5)), 6).alias("median"),
        F.round(F.stddev_samp("rate"), 6).alias("deviation"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.max("wall"), 6).alias("overall"),
    )


def request_metrics(requests: DataFrame) -> DataFrame:
    """Time to first content, generation time (total time where there was none) and tokens a second."""
    out = requests.withColumn("ttft", F.col("first") - F.col("start")).withColumn("generation", F.coalesce(F.col("stop") - F.col("first"), F.col("stop") - F.col("start")))
    return out.withColumn("rate", F.when(F.col("generation") > 0, F.col("tokens") / F.col("generation")).otherwise(0.0))
