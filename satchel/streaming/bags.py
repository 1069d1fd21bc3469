"""Bags from streams: windows of events as bags, and cluster predictions against a fixed model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusterers import KMeans


def windowed_bags(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per user and window of event time a bag of (value, hour); rows later than the watermark are left out.

    State is one list per user and open window: it is bounded by what a user does within the window.
    """
    x = F.array(F.col("value") + F.lit(0.0), F.hour("ts").cast("double"))
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "user_id")
    return grouped.agg(F.sort_array(F.collect_list(F.struct("event_id", x.alias("x")))).alias("b")).select(F.col("user_id").alias("bag_idx"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("b.x").alias("bag"))


def predicted(bags: DataFrame, model: KMeans) -> DataFrame:
    """Nearest centroid of each bag, in the row: no state."""
    return model.predict(bags)
