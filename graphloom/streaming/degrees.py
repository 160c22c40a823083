"""Degrees of a growing graph, kept up to date as edges stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degrees(edges: DataFrame, time_col: str | None = None, late: str = "10 minutes", window: str | None = None) -> DataFrame:
    """Out-degrees of a stream of arcs (src, dst): running totals, or by event-time window with a watermark."""
    if time_col and window:
        marked = edges.withWatermark(time_col, late)
        return marked.groupBy(F.window(time_col, window).alias("window"), F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
