"""Bounded micro-batches: additive partial results that merge like the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_counts(spark: SparkSession, source: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Counts each micro-batch of a stream by ``keys`` and appends it under its batch number, so a retried batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The sum of all partials."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))
