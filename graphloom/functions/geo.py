"""Distances on the globe as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the radius of the earth in centimetres.
EARTH_CM = 637_100_000.0


def geo_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, legacy: bool = False) -> Column:
    """Great-circle distance in centimetres of points in radians.

    ``legacy`` leaves the differences unhalved, which roughly doubles distances; kept for comparing old results.
    """
    half = 1.0 if legacy else 0.5
    s = F.pow(F.sin((lat2 - lat1) * half), 2) + F.pow(F.sin((lon2 - lon1) * half), 2) * F.cos(lat1) * F.cos(lat2)
    return 2 * F.atan2(F.sqrt(s), F.sqrt(1 - s)) * EARTH_CM


def estimates_to(coordinates: DataFrame, dest: int, legacy: bool = False) -> DataFrame:
    """``id, hint``: the distance of each vertex (id, lat, lon) to ``dest``, cut to whole centimetres."""
    goal = coordinates.where(F.col("id") == dest).select("lat", "lon").head()
    if goal is None:
        raise ValueError(f"no coordinates of vertex {dest}")
    return coordinates.select("id", F.floor(geo_distance(F.col("lat"), F.col("lon"), F.lit(goal["lat"]), F.lit(goal["lon"]), legacy)).cast("long").alias("hint"))
