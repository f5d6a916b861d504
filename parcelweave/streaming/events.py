"""Event counts as a stream.  The batch plans are full rebuilds; this is their incremental form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Counts and sums by window and type; rows later than ``lateness`` are dropped, finished windows leave the state."""
    keys = F.window("ts", window).alias("w"), F.col("event_type")
    counts = events.withWatermark("ts", lateness).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def distinct_events(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Without repeated ids, of which the state keeps those within ``lateness``."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that has arrived, once, exactly once; the checkpoint remembers what has been read."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
