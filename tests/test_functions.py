"""Thresholds one step below, at and above each bound, with values typed by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skylane.functions import geo, weather


def _one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string" if isinstance(v, str) else "double").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "field", "scale", "want"),
    [("+0056,1", 0, 10.0, 5.6), ("-0128,1", 0, 10.0, -12.8), ("160,1,N,0046,1", 3, 10.0, 4.6), ("016000,1,9,9", 0, 1.0, 16000.0), ("", 0, 1.0, None), ("160,1", 3, 10.0, None), ("abc,1", 0, 1.0, None), ("7.5", 0, 10.0, 7.5), (None, 0, 1.0, None)],
)
def test_coded_numbers(spark, text, field, scale, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(weather.coded_number(F.col("t"), field, scale)).first()[0]
    assert got == want or math.isclose(got, want)


@pytest.mark.parametrize(
    ("value", "want"),
    [(-10.01, "below_-10C"), (-10, "-10_to_-5C"), (-5, "-5_to_0C"), (-0.1, "-5_to_0C"), (0, "0_to_5C"), (5, "5_to_10C"), (10, "10_to_15C"), (15, "15_to_20C"), (20, "20_to_25C"), (25, "25_to_30C"), (29.9, "25_to_30C"), (30, "above_30C"), (None, "unknown")],
)
def test_temperature_buckets(spark, value, want):
    assert _one(spark, weather.temperature_bucket(F.col("v")), v=value) == want


@pytest.mark.parametrize(("value", "want"), [(1.4, "calm"), (1.5, "light_breeze"), (5.5, "moderate"), (10.8, "fresh"), (17.1, "fresh"), (17.2, "strong_wind"), (None, "unknown")])
def test_wind_categories(spark, value, want):
    assert _one(spark, weather.wind_category(F.col("v")), v=value) == want


@pytest.mark.parametrize(
    ("t", "w", "v", "want"),
    [(20.0, 1.0, 25000.0, 100.0), (15.0, 1.5, 20000.0, 90.0), (25.0, 5.5, 10000.0, 70.0), (10.0, 10.8, 4000.0, 45.0), (30.1, None, None, 20.0), (-1.0, 20.0, 100.0, 20.0), (None, 1.0, 25000.0, 50.0), (0.0, 1.0, 4001.0, 65.0), (5.0, 1.0, 4001.0, 70.0), (27.0, 1.0, 4001.0, 80.0)],
)
def test_comfort_score(spark, t, w, v, want):
    got = _one(spark, weather.comfort_score(F.col("t"), F.col("w"), F.col("v")), t=t, w=w, v=v)
    assert got == want and 20 <= got <= 100


@pytest.mark.parametrize(("mm", "short", "long"), [(0.0, "None", "None (0mm)"), (0.9, "Light", "Light (<1mm)"), (1.0, "Moderate", "Moderate (1-5mm)"), (5.0, "Heavy", "Heavy (>5mm)"), (-1.0, "Light", "Heavy (>5mm)"), (None, "Heavy", "Heavy (>5mm)")])
def test_precipitation_levels(spark, mm, short, long):
    assert _one(spark, weather.precipitation_level(F.col("v")), v=mm) == short
    assert _one(spark, weather.precipitation_level(F.col("v"), True), v=mm) == long


def test_strict_missing(spark):
    df = spark.createDataFrame([("+9999,9", "999,9,9,9999,9", "999999,9,9,9")], "temperature string, wind string, visibility string")
    loose, strict = weather.enrich_weather(df).first(), weather.enrich_weather(df, strict_missing=True).first()
    assert loose.temp_c == 999.9 and loose.wind_speed_ms == 999.9 and loose.visibility_m == 999999.0
    assert strict.temp_c is None and strict.wind_speed_ms is None and strict.visibility_m is None and strict.weather_condition_score == 50.0


def test_speed_modes(spark):
    rows = [(600.0, 42.3, -71.1, 42.31, -71.1), (0.0, 42.3, -71.1, 42.31, -71.1), (600.0, None, -71.1, 42.31, -71.1), (600.0, 42.3, -71.1, 42.3, -71.1), (0.0, None, -71.1, 42.3, -71.1)]
    df = spark.createDataFrame(rows, "tripduration double, start_station_latitude double, start_station_longitude double, end_station_latitude double, end_station_longitude double")
    plain = [(r.distance_meters, r.average_speed_kmh) for r in geo.add_distance_and_speed(df).collect()]
    zeros = [(r.distance_meters, r.average_speed_kmh) for r in geo.add_distance_and_speed(df, zero_missing=True).collect()]
    assert plain[0][0] == pytest.approx(1111.95, abs=0.01) and plain[0][1] == pytest.approx(6.6717, abs=1e-4)
    assert plain[1][1] == 0.0 and plain[2] == (None, None) and plain[4] == (None, 0.0)
    assert zeros[2] == (0.0, 0.0) and zeros[3] == (0.0, 0.0)


def test_bounds_are_strict(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (49.9,), (50.0,), (None,)], "average_speed_kmh double")
    assert [r[0] for r in geo.plausible_speed(df).collect()] == [0.1, 49.9]
