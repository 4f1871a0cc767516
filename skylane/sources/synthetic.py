"""Generated trips, rides and observations, the same for the same seed and row count on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = 86_400


def _pick(names: list[str], seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(F.rand(seed) * len(names)) + 1).cast("int"))


def _when(start: str, days: int, seed: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.floor(F.rand(seed) * days * _DAY))


def bikes(spark: SparkSession, n: int, seed: int = 1, start: str = "2024-01-01", days: int = 7) -> DataFrame:
    at = lambda k: F.round(F.rand(seed + k) * 0.5 + 42.05, 5)
    across = lambda k: F.round(F.rand(seed + k) * 0.4 - 71.25, 5)
    return spark.range(n).select(
        F.col("id").alias("trip_no"), _when(start, days, seed).alias("start_time_ts"), (F.floor(F.rand(seed + 1) * 3540) + 60).cast("int").alias("duration_seconds"),
        _pick(["Subscriber", "Customer"], seed + 2).alias("user_type"), at(3).alias("start_station_latitude"), across(4).alias("start_station_longitude"),
        at(5).alias("end_station_latitude"), across(6).alias("end_station_longitude"),
    )


def taxis(spark: SparkSession, n: int, seed: int = 2, start: str = "2024-01-01", days: int = 7) -> DataFrame:
    return spark.range(n).select(
        F.col("id").alias("trip_no"), _when(start, days, seed).alias("datetime_ts"), _pick(["Uber", "Lyft"], seed + 1).alias("cab_type"),
        F.round(F.rand(seed + 2) * 45 + 5, 2).alias("price"), F.round(F.rand(seed + 3) * 9.5 + 0.5, 2).alias("distance"),
        _pick(["1.0", "1.25", "1.5", "2.0"], seed + 4).cast("double").alias("surge_multiplier"),
    )


def weather(spark: SparkSession, n: int, seed: int = 3, start: str = "2024-01-01", every_seconds: int = 900) -> DataFrame:
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("id") * every_seconds)
    return spark.range(n).select(
        F.col("id").alias("obs_no"), ts.alias("datetime_ts"), F.round(F.rand(seed) * 45 - 12, 1).alias("temp_c"),
        F.round(F.rand(seed + 1) * 18, 1).alias("wind_speed_ms"), F.floor(F.rand(seed + 2) * 25_000).cast("double").alias("visibility_m"),
    )
