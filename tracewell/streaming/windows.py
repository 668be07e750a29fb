"""Counts of a stream in windows of event time, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(events: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """start, by, n: rows in each window of `width`; rows later than `late` behind the newest are left out."""
    seen = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    return seen.groupBy(F.window("__at", width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
