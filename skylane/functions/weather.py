"""Coded weather observations, their categories, and a comfort score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions.ladders import above, below, flag

#: Category bounds (fixed values): a value belongs to the first bound that lies above it.
TEMPERATURE_RUNGS = [
    (-10, "below_-10C"), (-5, "-10_to_-5C"), (0, "-5_to_0C"), (5, "0_to_5C"), (10, "5_to_10C"),
    (15, "10_to_15C"), (20, "15_to_20C"), (25, "20_to_25C"), (30, "25_to_30C"),
]
WIND_RUNGS = [(1.5, "calm"), (5.5, "light_breeze"), (10.8, "moderate"), (17.2, "fresh")]
VISIBILITY_RUNGS = [(1000, "very_poor"), (4000, "poor"), (10000, "moderate"), (20000, "good")]
#: Comfort points (fixed values).
_WIND_POINTS = [(1.5, 30.0), (5.5, 25.0), (10.8, 15.0)]
_VISIBILITY_POINTS = [(20000, 30.0), (10000, 25.0), (4000, 15.0)]
#: Codes that mean 'missing' in the coded fields.
MISSING_TEMPERATURE_C, MISSING_WIND_MS, MISSING_VISIBILITY_M = 999.9, 999.9, 999999.0


def coded_number(text: Column, field: int, scale: float = 1.0, plain: bool = True) -> Column:
    """A field of a comma-separated code as a number over ``scale``; a text without a comma is a plain number.

    Text that is no number, a missing field and null give null. With ``plain=False`` plain text gives null.
    """
    text = text.cast("string")
    value = F.get(F.split(text, ","), F.lit(field)).try_cast("double") / F.lit(scale)
    bare = text.try_cast("double") if plain else F.lit(None).cast("double")
    return F.when(text.contains(","), value).otherwise(bare)


def parse_temperature(text: Column) -> Column:
    return coded_number(text, 0, 10.0)


def parse_wind_speed(text: Column) -> Column:
    return coded_number(text, 3, 10.0)


def parse_visibility(text: Column) -> Column:
    return coded_number(text, 0)


def temperature_bucket(temp_c: Column) -> Column:
    return below(temp_c, TEMPERATURE_RUNGS, "above_30C", "unknown")


def wind_category(wind_ms: Column) -> Column:
    return below(wind_ms, WIND_RUNGS, "strong_wind", "unknown")


def visibility_category(visibility_m: Column) -> Column:
    return below(visibility_m, VISIBILITY_RUNGS, "excellent", "unknown")


def comfort_score(temp_c: Column, wind_ms: Column, visibility_m: Column) -> Column:
    """20 to 100, higher is better; 50 without a temperature. Unknown wind and visibility get the fewest points."""
    warmth = (
        F.when(temp_c.between(15, 25), 40.0)
        .when(temp_c.between(10, 15) | temp_c.between(25, 30), 35.0)
        .when(temp_c.between(5, 10), 25.0)
        .when(temp_c.between(0, 5), 20.0)
        .otherwise(10.0)
    )
    total = warmth + below(wind_ms, _WIND_POINTS, 5.0) + above(visibility_m, _VISIBILITY_POINTS, 5.0)
    return F.when(temp_c.isNull(), F.lit(50.0)).otherwise(total)


def enrich_weather(df: DataFrame, strict_missing: bool = False) -> DataFrame:
    """Add parsed values, categories, score and flags to ``temperature, wind, visibility``.

    ``strict_missing`` also treats the codes for 'missing' as null; by default they count as values.
    """
    temp, wind, sight = parse_temperature(F.col("temperature")), parse_wind_speed(F.col("wind")), parse_visibility(F.col("visibility"))
    if strict_missing:
        temp = F.when(F.abs(temp) < MISSING_TEMPERATURE_C, temp)
        wind = F.when(wind < MISSING_WIND_MS, wind)
        sight = F.when(sight < MISSING_VISIBILITY_M, sight)
    parsed = df.withColumns({"temp_c": temp, "wind_speed_ms": wind, "visibility_m": sight})
    t, w, v = F.col("temp_c"), F.col("wind_speed_ms"), F.col("visibility_m")
    scored = parsed.withColumns(
        {"temp_bucket": temperature_bucket(t), "wind_category": wind_category(w), "visibility_category": visibility_category(v), "weather_condition_score": comfort_score(t, w, v)}
    )
    score = F.col("weather_condition_score")
    return scored.withColumns({"is_good_weather": flag(score >= 70), "is_bad_weather": flag(score <= 30)})


def add_precipitation_flags(df: DataFrame) -> DataFrame:
    """Likely precipitation from the score: ``has_precipitation`` below 40 and its category."""
    score = F.col("weather_condition_score")
    wet = flag(score < 40)
    return df.withColumns({"has_precipitation": wet, "precip_category": F.when(~wet, F.lit("none")).otherwise(below(score, [(20, "heavy"), (30, "moderate")], "light"))})


def condition_by_visibility(temp_c: Column, visibility_m: Column) -> Column:
    return (
        F.when(temp_c.isNull(), "unknown")
        .when(temp_c.between(15, 25) & (visibility_m > 10000), "good")
        .when(temp_c.between(10, 30) & (visibility_m > 5000), "fair")
        .otherwise("poor")
    )


def condition_by_precipitation(temp_c: Column, precip_mm: Column) -> Column:
    return F.when(temp_c.between(10, 25) & (precip_mm == 0), "good").when((temp_c < 5) | (temp_c > 30) | (precip_mm > 5), "poor").otherwise("fair")


#: Short labels of temperature ranges and precipitation levels (fixed values).
SHORT_TEMPERATURES = [(0, "Below 0°C"), (10, "0-10°C"), (20, "10-20°C"), (30, "20-30°C")]
LONG_TEMPERATURES = [(0, "Below 0°C (Freezing)"), (10, "0-10°C (Cold)"), (20, "10-20°C (Mild)"), (30, "20-30°C (Warm)")]


def temperature_range(temp_c: Column, long_labels: bool = False) -> Column:
    """Ranges of ten degrees; null falls into the top range."""
    return below(temp_c, LONG_TEMPERATURES, "Above 30°C (Hot)") if long_labels else below(temp_c, SHORT_TEMPERATURES, "Above 30°C")


def precipitation_level(precip_mm: Column, long_labels: bool = False) -> Column:
    """None, Light, Moderate or Heavy; null is Heavy. Long labels also count negative amounts as Heavy."""
    names = ["None (0mm)", "Light (<1mm)", "Moderate (1-5mm)", "Heavy (>5mm)"] if long_labels else ["None", "Light", "Moderate", "Heavy"]
    some = precip_mm > 0 if long_labels else F.lit(True)
    return F.when(precip_mm == 0, names[0]).when(some & (precip_mm < 1), names[1]).when(some & (precip_mm < 5), names[2]).otherwise(names[3])


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32) * 5 / 9
