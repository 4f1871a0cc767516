"""Great-circle distance and trip speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Bounds of plausible coordinates: latitude, longitude (fixed values).
LATITUDES, LONGITUDES = (42.0, 42.6), (-71.3, -70.8)

_ENDS = ("start_station_latitude", "start_station_longitude", "end_station_latitude", "end_station_longitude")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres between two points in degrees; null if a coordinate is."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.atan2(F.sqrt(h), F.sqrt(1 - h)) * 2 * EARTH_RADIUS_M


def add_distance_and_speed(df: DataFrame, seconds: str = "tripduration", zero_missing: bool = False) -> DataFrame:
    """Add ``distance_meters`` and ``average_speed_kmh`` to a trip with start and end coordinates.

    Speed is 0 without a positive duration. Missing coordinates leave distance and speed null; with ``zero_missing``
    they make both 0, and a trip without distance has speed 0.
    """
    distance = haversine_m(*[F.col(c) for c in _ENDS])
    if zero_missing:
        distance = F.coalesce(distance, F.lit(0.0))
    df = df.withColumn("distance_meters", distance)
    t, d = F.col(seconds), F.col("distance_meters")
    moving = (t > 0) & (d > 0) if zero_missing else t > 0
    return df.withColumn("average_speed_kmh", F.when(moving, d / t * 3.6).otherwise(F.when(d.isNull() & (t > 0), F.lit(None)).otherwise(0.0)))


def plausible_speed(df: DataFrame, most_kmh: float = 50.0) -> DataFrame:
    """Trips faster than 0 and slower than ``most_kmh``."""
    return df.where((F.col("average_speed_kmh") > 0) & (F.col("average_speed_kmh") < most_kmh))


def plausible_coordinates(df: DataFrame) -> DataFrame:
    """Trips whose four coordinates lie within the bounds."""
    lat1, lon1, lat2, lon2 = (F.col(c) for c in _ENDS)
    return df.where(lat1.between(*LATITUDES) & lat2.between(*LATITUDES) & lon1.between(*LONGITUDES) & lon2.between(*LONGITUDES))
