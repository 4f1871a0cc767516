"""Statements behind the dashboard's panels, over the views ``bike_weather_distance`` and the statistics tables."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.functions.weather import precipitation_level
from skylane.operators import stats


def in_range(trips: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Trips that start at or after ``start`` and stop at or before ``end``; compared as timestamps."""
    if start is not None:
        trips = trips.where(F.col("starttime") >= F.lit(start).cast("timestamp"))
    if end is not None:
        trips = trips.where(F.col("stoptime") <= F.lit(end).cast("timestamp"))
    return trips


def _minutes() -> Column:
    return F.round(F.avg("tripduration") / 60, 1).alias("avg_duration_min")


def _moving(trips: DataFrame, most: float | None = None) -> DataFrame:
    speed = F.col("average_speed_kmh")
    return trips.where(speed > 0 if most is None else (speed > 0) & (speed < most))


def rank(column: str, names: list[str]) -> Column:
    """Place of a label in a fixed order; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)), F.lit(0)), F.lit(len(names) + 1))


def time_range(trips: DataFrame) -> DataFrame:
    return _moving(trips).agg(F.min("starttime").alias("min_time"), F.max("stoptime").alias("max_time"), F.count("*").alias("total_trips"))


def trips_by_hour(trips: DataFrame) -> DataFrame:
    return _moving(trips).groupBy(F.hour("starttime").alias("hour_of_day")).agg(F.count("*").alias("trip_count"), _minutes()).orderBy("hour_of_day")


def precipitation_panel(trips: DataFrame) -> DataFrame:
    by_level = _moving(trips, 50).groupBy(precipitation_level(F.col("precip_daily_mm")).alias("precip_level"))
    out = by_level.agg(F.count("*").alias("trip_count"), F.round(F.avg("average_speed_kmh"), 2).alias("avg_speed"), _minutes())
    return out.orderBy(rank("precip_level", ["None", "Light", "Moderate", "Heavy"]))


def temperature_and_speed(trips: DataFrame) -> DataFrame:
    out = _moving(trips, 50).groupBy(F.round("temp_c", 0).alias("temperature"))
    return out.agg(
        F.round(F.avg("average_speed_kmh"), 2).alias("avg_speed"), F.count("*").alias("trip_count"), F.round(F.avg("precip_daily_mm"), 2).alias("avg_precip")
    ).orderBy("temperature")


def speed_histogram(trips: DataFrame, step: int = 2, most: float = 30) -> DataFrame:
    bucket = (F.floor(F.col("average_speed_kmh") / step) * step).alias("speed_bucket")
    return _moving(trips, most).groupBy(bucket).agg(F.count("*").alias("trip_count")).orderBy("speed_bucket")


def distance_histogram(trips: DataFrame, step: int = 500, most: float = 8000) -> DataFrame:
    d = F.col("distance_meters")
    return trips.where((d > 0) & (d < most)).groupBy((F.floor(d / step) * step).alias("distance_bucket")).agg(F.count("*").alias("trip_count"), _minutes()).orderBy("distance_bucket")


def _rounded(*names: str, **renamed: str) -> list[Column]:
    return [F.round(n, 2).alias(n) for n in names] + [F.round(old, 2).alias(new) for new, old in renamed.items()]


def overall_panel(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of the overall statistics: the one with the most trips."""
    names = ["mean_speed", "median_speed", "stddev_speed", "min_speed", "max_speed", "mean_temp", "mean_distance", "mean_duration"]
    return snapshots.orderBy(F.desc("total_trips")).limit(1).select(*_rounded(*names), "total_trips")


def condition_panel(by_condition: DataFrame) -> DataFrame:
    out = by_condition.select("weather_condition", *_rounded("mean_speed", "median_speed", "stddev_speed", "mean_distance", "mean_temp"), "sample_size")
    return out.orderBy(rank("weather_condition", ["good", "fair", "poor"]))


def temperature_panel(by_temperature: DataFrame) -> DataFrame:
    out = by_temperature.select("temp_bucket", *_rounded("mean_speed", "median_speed", "mean_distance", avg_temp="avg_temp_in_bucket"), "sample_size")
    return out.orderBy(rank("temp_bucket", ["Below 0°C", "0-10°C", "10-20°C", "20-30°C", "Above 30°C"]))


def taxi_trips_by_hour(rides: DataFrame) -> DataFrame:
    return rides.groupBy(F.hour("datetime_ts").alias("hour_of_day")).agg(F.count("*").alias("trip_count")).orderBy("hour_of_day").limit(24)


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted_mean"))


def register_views(spark: SparkSession, trips: DataFrame) -> None:
    """Register the views that the statements name."""
    trips.createOrReplaceTempView("bike_weather_distance")
    stats.overall(trips).createOrReplaceTempView("weather_transport_statistics_overall")
    stats.by_condition(trips).createOrReplaceTempView("weather_transport_statistics_by_condition")
    stats.by_temperature(trips).createOrReplaceTempView("weather_transport_statistics_by_temperature")
    stats.by_precipitation(trips).createOrReplaceTempView("weather_transport_statistics_by_precipitation")


_READS = re.compile(r"\s*(?:--[^\n]*\n\s*)*(select|with|show|describe|desc|explain|values)\b", re.I)


def sql(spark: SparkSession, statement: str) -> DataFrame:
    """Run one reading statement (SELECT, WITH, SHOW, DESCRIBE, EXPLAIN, VALUES); a closing semicolon is dropped."""
    statement = statement.strip().rstrip(";").rstrip()
    if not _READS.match(statement):
        raise ValueError("only reading statements are accepted")
    return spark.sql(statement)


def answer(spark: SparkSession, statement: str, most_rows: int = 10_000) -> dict:
    """A statement's rows for a client: status, columns, data, row_count and whether there are more.

    At most ``most_rows`` rows leave the cluster; ``truncated`` says that the statement has more than those.
    """
    df = sql(spark, statement)
    rows = [list(r) for r in df.limit(most_rows + 1).collect()]
    return {"status": "success", "columns": df.columns, "data": rows[:most_rows], "row_count": len(rows[:most_rows]), "truncated": len(rows) > most_rows}


_DEFINES = re.compile(r"\s*(create\s+(?:or\s+replace\s+)?(?:external\s+)?|drop\s+)(database|schema|table|view)\b", re.I)


def define(spark: SparkSession, statement: str) -> None:
    """Run one statement that creates or drops a database, a table (external ones included) or a view."""
    statement = statement.strip().rstrip(";").rstrip()
    if not _DEFINES.match(statement):
        raise ValueError("only CREATE and DROP of databases, tables and views are accepted")
    spark.sql(statement)
