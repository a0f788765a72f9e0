"""Resumable runs over a growing folder: a file stream with a checkpoint, so each file is done once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.images import PATTERN, decoded


def new_images(spark: SparkSession, folder: str, files_each: int = 5) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", files_each).load(folder)


def process_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, measure: Callable[[DataFrame], DataFrame] | None = None, files_each: int = 5) -> int:
    """Decodes and measures the files not yet done, appends to the Parquet table out, and returns how many batches that took.

    Killed and started again, it goes on after the last batch that was committed; files added in between are taken too.
    """
    done = decoded(new_images(spark, folder, files_each))
    if measure is not None:
        done = measure(done)
    query = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums by event type and tumbling window, for streams and tables alike; later events than late are dropped from streams."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
