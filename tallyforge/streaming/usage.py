"""The hourly usage cube as a stream: late records within the watermark still count, copies of a request count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """``records``: (at timestamp, model, request, input, output); sums by hour and model."""
    named = records.withWatermark("at", late).dropDuplicatesWithinWatermark(["request"])
    return named.groupBy(F.window("at", "1 hour"), "model").agg(
        F.sum("input").alias("input"), F.sum("output").alias("output"), F.count(F.lit(1)).alias("requests")
    ).select(F.col("window.start").alias("hour"), "model", "input", "output", "requests")
