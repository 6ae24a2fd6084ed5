"""Distances and boxes on the sphere as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from .kinds import number_of, resolve

#: Mean radius of the Earth in km.
EARTH_KM = 6371.0088
#: Degrees of a cell of the geo layout.
CELL = 0.1


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres along the great circle."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() and greatest() skip nulls, so a missing point needs a guard of its own.
    return F.when(a.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.greatest(F.sqrt(a), F.lit(0.0)), F.lit(1.0))))


def haversine_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(max(math.sqrt(a), 0.0), 1.0))


def point(df: DataFrame, path: str) -> tuple[Column, Column]:
    """(lat, lon) of a field: a struct, map or VARIANT object with lat and lon, or an array of two numbers; null where it is no point."""
    none = F.lit(None).cast("double")
    at, kind = resolve(df, path)
    if at is None:
        return none, none
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        two = F.size(at) == 2
        return F.when(two, F.get(at, F.lit(0)).cast("double")), F.when(two, F.get(at, F.lit(1)).cast("double"))
    if isinstance(kind, T.StructType) or isinstance(kind, T.MapType):
        (a, ka), (b, kb) = resolve(df, f"{path}.lat"), resolve(df, f"{path}.lon")
        return (none, none) if a is None or b is None else (number_of(a, ka), number_of(b, kb))
    if isinstance(kind, T.VariantType):
        got = lambda p: number_of(F.try_variant_get(at, p, "variant"), kind)
        extra = F.try_variant_get(at, "$[2]", "variant").isNull()
        return F.coalesce(got("$.lat"), F.when(extra, got("$[0]"))), F.coalesce(got("$.lon"), F.when(extra, got("$[1]")))
    return none, none


def distance_to(df: DataFrame, path: str, lat: float, lon: float) -> Column:
    a, b = point(df, path)
    return haversine(F.lit(float(lat)), F.lit(float(lon)), a, b)


def near_box(df: DataFrame, path: str, lat: float, lon: float, km: float) -> Column | None:
    """Latitude and longitude bounds of a circle as plain comparisons, which reach the files' statistics; None near poles and the date line, where a box isn't simple."""
    delta = km / EARTH_KM
    if not all(map(math.isfinite, (lat, lon, km))) or km < 0 or delta >= math.pi / 2 or abs(lat) + math.degrees(delta) >= 89.9:
        return None
    wide = math.degrees(math.asin(min(1.0, math.sin(delta) / math.cos(math.radians(lat))))) + 1e-9
    high = math.degrees(delta) + 1e-9
    if abs(lon) + wide > 180:
        return None
    a, b = point(df, path)
    return a.between(lat - high, lat + high) & b.between(lon - wide, lon + wide)


def within(df: DataFrame, path: str, lat: float, lon: float, km: float) -> Column:
    """Whether a field is a point at most km away; nothing is within a distance that isn't a number."""
    if any(math.isnan(x) for x in (lat, lon, km)):
        return F.lit(False)
    exact, box = distance_to(df, path, lat, lon) <= float(km), near_box(df, path, lat, lon, km)
    return exact if box is None else box & exact


def in_box(df: DataFrame, path: str, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """Whether a field is a point of the box, bounds included; min_lon > max_lon goes across the date line."""
    if not (-90 <= min_lat <= max_lat <= 90) or not (-180 <= min_lon <= 180 and -180 <= max_lon <= 180):
        raise InvalidArgument("bounds of a box: -90 <= min_lat <= max_lat <= 90 and longitudes from -180 to 180")
    a, b = point(df, path)
    across = (b >= min_lon) | (b <= max_lon) if min_lon > max_lon else b.between(min_lon, max_lon)
    return a.between(min_lat, max_lat) & across


def cells(df: DataFrame, path: str) -> DataFrame:
    """df with lat_cell and lon_cell, by which the geo layout clusters its files."""
    a, b = point(df, path)
    return df.withColumns({"lat_cell": F.floor(a / CELL).cast("int"), "lon_cell": F.floor(b / CELL).cast("int")})
