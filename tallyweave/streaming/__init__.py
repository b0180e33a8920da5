"""Streaming twins of the log's operators: accuracy over event time, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(log: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Decisions in each window of event time; ``log`` may be a stream or a table."""
    stamped = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if log.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    counted = stamped.groupBy(F.window("ts", size)).agg(F.count_if(F.col("kind") == "proposal").alias("proposals"), F.count_if(F.col("kind") == "confirm").alias("confirmed"), F.count_if(F.col("kind") == "correct").alias("corrected"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "proposals", "confirmed", "corrected")


def sessions(log: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    stamped = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if log.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    s = stamped.groupBy("key", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select("key", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n_events")
