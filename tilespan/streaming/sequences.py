"""Structured Streaming over files of whole sequences: every micro-batch holds complete sequences, so each is treated by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "feature_set string, seq_id string, start long, end long, feature string"


def read_sequences(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of annotation rows from parquet files as they appear; a file holds whole sequences."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def per_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Applies work to every micro-batch and adds its rows under target, one folder a batch, so that a batch tried again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_lengths(stream: DataFrame) -> DataFrame:
    """Length of every label so far, kept as state by label."""
    return stream.groupBy("feature_set", "feature").agg(F.sum(F.col("end") - F.col("start")).alias("bp"))


def event_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and value sums of timed events by window and type; rows later than the watermark go."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")
