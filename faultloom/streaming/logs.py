"""Log events from a growing folder of log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logs import is_log_line, log_fields


def log_stream(spark: SparkSession, path: str, system: Column, files_per_trigger: int = 100) -> DataFrame:
    """``file, class, type, content, line`` of the log lines of new files, statelessly."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    lines = raw.select(F.col("_metadata.file_name").alias("file"), "value").filter(is_log_line(F.col("value")))
    return lines.select("file", log_fields(F.col("value"), system).alias("e")).filter("e IS NOT NULL").select("file", "e.*")


def level_counts(events: DataFrame, at: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by level in tumbling windows of event time, late ones bounded by a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), "type").agg(F.count(F.lit(1)).alias("events"))
