"""Messages that arrive as files: parsed and de-duplicated as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postloom.operators.dedup import body_key
from postloom.operators.parse import parse_messages


def read_messages(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of (file, message) from Parquet files dropped into a folder."""
    return spark.readStream.schema("file string, message string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique_messages(raw: DataFrame, late: str | None = None, event_time: str | None = None) -> DataFrame:
    """Parsed messages, each body once. With ``event_time`` and ``late`` the state only keeps keys that can still recur: copies later than that pass."""
    parsed = parse_messages(raw).withColumn("body_key", body_key(F.col("body")))
    if late and event_time:
        timed = parsed.withColumn(event_time, F.try_to_timestamp("date")).withWatermark(event_time, late)
        return timed.dropDuplicatesWithinWatermark(["body_key"])
    return parsed.dropDuplicates(["body_key"])


def sender_counts(parsed: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Messages per sender and time window, late ones within ``late`` counted in."""
    timed = parsed.withColumn("ts", F.try_to_timestamp("date")).filter("ts is not null").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "from_addr").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "from_addr", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there and stops; the checkpoint makes a restart go on where it ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
