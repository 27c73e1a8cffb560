"""Event logs as streams: append to a table, running counters, windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append to a Parquet table; what is there is worked off, then it ends."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """seen and sum of ``value`` by key; as a stream to be written in update or complete mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("seen"), F.sum(value).alias("total"))


def windowed(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window; rows later than ``late`` behind the newest are left out of a stream."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str) -> DataFrame:
    """Runs of events with pauses shorter than ``gap``."""
    out = events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "n")
