"""Streams into cubes: windowed sums with late data, and appends of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Event files as a stream, some files a micro-batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_sums(events: DataFrame, width: str = "3 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """window_start, event_type, n, cents: counts and summed values of overlapping windows; events up to ``late`` late still count.

    Works on a stream (the watermark bounds its state) and on a table alike.
    """
    cents = F.floor(F.col("value") * 100).cast("long")
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    sums = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))
    return sums.select(F.col("w.start").alias("window_start"), "event_type", "n", "cents")


def append_to(cube, batches: DataFrame, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of rows (codes and value) to a mutable cube's delta, once each, until the input is used up."""
    folder = f"{checkpoint.rstrip('/')}-deltas"
    cube.attach(folder)  # what an earlier run appended

    def one(batch: DataFrame, number: int) -> None:
        cube.insert(batch, f"{folder}/batch-{number:012d}")  # a batch that is tried again, after a restart too, replaces itself

    return batches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
