"""Streams of observations: the newest revision of each key, and hourly means under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_revisions(stream: DataFrame) -> DataFrame:
    """The revision with the highest sequence of each key so far; late older revisions change nothing."""
    return stream.groupBy("source_id", "source_record_id").agg(F.max(F.struct("revision_sequence", "known_at", "value")).alias("top")).select("source_id", "source_record_id", "top.*")


def hourly_means(stream: DataFrame, late: str = "2 hours", time: str = "event_time") -> DataFrame:
    """Mean of each source and hour, emitted once the watermark has passed the hour."""
    windows = stream.withWatermark(time, late).groupBy("source_id", F.window(time, "1 hour").alias("w"))
    return windows.agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).select("source_id", F.col("w.start").alias("hour"), "value", "n")


def without_repeats(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each revision once, within the watermark."""
    return stream.withWatermark("known_at", late).dropDuplicatesWithinWatermark(["source_id", "source_record_id", "revision_sequence"])
