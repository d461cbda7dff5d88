"""Tumbling means of a stream; the batch operator is its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide import config


def stream_resample(readings: DataFrame, minutes: int = config.RESAMPLE_MINUTES, late: str = "30 minutes") -> DataFrame:
    """Mean count per location and grid step, emitted once the watermark has passed it.

    ``observed_at`` is a TIMESTAMP here, as watermarks need one.
    """
    return (
        readings.withWatermark("observed_at", late)
        .groupBy("location_id", F.window("observed_at", f"{minutes} minutes").alias("w"))
        .agg(F.avg("current_capacity").alias("mean_count"), F.count("*").alias("samples"))
        .select("location_id", F.col("w.start").alias("bucket_ts"), "mean_count", "samples")
    )
