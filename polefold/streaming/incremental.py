"""Angles that arrive one after another: micro-batches of data rows update a running solution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import schema


def data_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """data(a, y, j, b) from Parquet files as they appear."""
    return spark.readStream.schema(schema("data")).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fit_stream(stream: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], start: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Run ``step(x, batch) -> x`` on every batch; generation n of the state is a folder, so a replay is harmless."""
    spark = start.sparkSession
    start.write.mode("overwrite").parquet(f"{state_path}/gen=0")

    def update(batch: DataFrame, epoch: int) -> None:
        x = spark.read.parquet(f"{state_path}/gen={epoch}")
        step(x, batch).write.mode("overwrite").parquet(f"{state_path}/gen={epoch + 1}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def angle_totals(stream: DataFrame) -> DataFrame:
    """Running totals and row counts per angle."""
    return stream.groupBy("a").agg(F.sum("b").alias("total"), F.count("*").alias("n"))
