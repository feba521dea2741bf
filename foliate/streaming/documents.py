"""Documents as they arrive: the stateless operators on a file stream, and counts kept up to date.

The batch operators work on a stream as they are where a row needs no other row;
aggregates over the stream use a watermark on the time of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.operators import profile
from foliate.sources.documents import SCHEMA


def document_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    rows = spark.readStream.schema(SCHEMA).option("multiLine", True).option("maxFilesPerTrigger", files_a_batch).json(folder)
    return rows.select(F.regexp_extract("_metadata.file_name", r"(.*)\.json$", 1).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def typed(stream: DataFrame) -> DataFrame:
    """Type and chunk sizes of each document."""
    return profile.typed(stream)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type in windows of time; later than ``late`` they are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events with no gap as long as ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
