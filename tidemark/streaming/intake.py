"""Incremental intake: episodes go to the result store as their signals become valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.sources.store import ResultStore


def intake(spark: SparkSession, source: str, schema: StructType, evaluate: Callable[[DataFrame], DataFrame], store: ResultStore, checkpoint: str, wait: bool = False, every: str = "5 seconds"):
    """A query over new files of `source`; each batch is evaluated and appended to the store.

    evaluate gives rows with unique keys, so a batch that is run again after a failure adds nothing. wait: keep
    polling; else take what is there and end.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, _: int) -> None:
        store.append(evaluate(df))

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if wait else writer.trigger(availableNow=True)).start()
