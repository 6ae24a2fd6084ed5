"""Geo searches over a frame."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G


def radius(df: DataFrame, field: str, lat: float, lon: float, km: float) -> DataFrame:
    """Rows at most km away with ``distance_km``, nearest first, ties by key. NaN matches nothing."""
    return df.where(G.within(df, field, lat, lon, km)).withColumn("distance_km", G.distance_to(df, field, lat, lon)).orderBy("distance_km", "key")


def nearest(df: DataFrame, field: str, lat: float, lon: float, k: int) -> DataFrame:
    if any(math.isnan(x) for x in (lat, lon)):
        return df.withColumn("distance_km", F.lit(0.0)).limit(0)
    return df.withColumn("distance_km", G.distance_to(df, field, lat, lon)).where("distance_km is not null").orderBy("distance_km", "key").limit(k)


def box(df: DataFrame, field: str, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> DataFrame:
    return df.where(G.in_box(df, field, min_lat, min_lon, max_lat, max_lon)).orderBy("key")
