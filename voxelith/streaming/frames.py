"""Frames as a stream: each micro-batch of voxel files updates per-frame label volumes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_frames(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def label_volumes(stream: DataFrame) -> DataFrame:
    """Running volumes by frame and label."""
    return stream.groupBy("t", "label").agg(F.count("*").alias("volume"))


def windowed(events: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))


def for_each_frame(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``step`` on each micro-batch in order of arrival; restarts go on after the last finished one."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
