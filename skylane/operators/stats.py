"""Descriptive statistics of trips, over all and by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions.weather import precipitation_level, temperature_range
from skylane.operators.percentiles import exact_percentiles, value_counts, with_percentiles

#: Accuracy of percentiles on streams: a rank is off by one in this many at most, and a sketch holds about as many values.
ACCURACY = 10_000
PERCENTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75}
SHORT = {"speed": "average_speed_kmh", "temp": "temp_c", "distance": "distance_meters", "duration": "tripduration", "precip": "precip_daily_mm"}
_MEASURES = {
    "mean": F.avg, "stddev": F.stddev, "variance": F.variance, "min": F.min, "max": F.max, "skewness": F.skewness, "kurtosis": F.kurtosis,
    **{name: lambda c, q=q: F.percentile_approx(c, q, ACCURACY) for name, q in PERCENTILES.items()},
}

#: Measures of each statistic: 'speed: mean median' stands for mean_speed and median_speed.
OVERALL = ["speed: mean median stddev variance min max skewness kurtosis p25 p75", "temp: mean median stddev min max", "distance: mean median stddev", "duration: mean median stddev"]
BY_CONDITION = ["speed: mean median stddev min max p25 p75", "temp: mean stddev min max", "distance: mean stddev", "duration: mean stddev", "precip: mean max"]
BY_TEMPERATURE = ["speed: mean median stddev min max", "distance: mean", "duration: mean"]
BY_PRECIPITATION = ["speed: mean median stddev", "distance: mean", "duration: mean", "temp: mean"]


def measures_of(specs: list[str]) -> list[tuple[str, str, str]]:
    """``(measure, name, alias)`` of all that is asked for."""
    return [(m, name, f"{m}_{name}") for name, measures in (spec.split(":") for spec in specs) for m in measures.split()]


def asked_percentiles(wanted: list[tuple[str, str, str]]) -> dict[str, tuple[str, float]]:
    return {alias: (name, PERCENTILES[m]) for m, name, alias in wanted if m in PERCENTILES}


def _grouped(trips: DataFrame, by: list[str], specs: list[str], *more: Column) -> DataFrame:
    """Statistics by category. Percentiles of batch frames are exact; those of streams are sketched."""
    wanted = measures_of(specs)
    asked = {} if trips.isStreaming else asked_percentiles(wanted)
    grouped = trips.groupBy(*by).agg(*[_MEASURES[m](SHORT[name]).alias(alias) for m, name, alias in wanted if alias not in asked], *more)
    if not asked:
        return grouped
    counts = value_counts(trips, by, {name: SHORT[name] for name, _ in asked.values()})
    kinds = trips.schema
    out = with_percentiles(grouped, exact_percentiles(counts, by, asked), by)
    first = [F.col(alias).cast(kinds[SHORT[name]].dataType).alias(alias) if alias in asked else F.col(alias) for _, name, alias in wanted]
    return out.select(*by, *first, *[c for c in grouped.columns if c not in by and c not in {alias for _, _, alias in wanted}])


def spread(df: DataFrame) -> DataFrame:
    """Range, coefficient of variation (null for a mean of 0) and interquartile range of speed."""
    return df.withColumns(
        {
            "range_speed": F.col("max_speed") - F.col("min_speed"),
            "cv_speed": F.try_divide("stddev_speed", "mean_speed"),
            "iqr_speed": F.col("p75_speed") - F.col("p25_speed"),
        }
    )


def overall(trips: DataFrame) -> DataFrame:
    """One row over all trips."""
    return spread(_grouped(trips, [], OVERALL, F.count("*").alias("total_trips")))


def by_condition(trips: DataFrame) -> DataFrame:
    """By ``weather_condition``."""
    return spread(_grouped(trips, ["weather_condition"], BY_CONDITION, F.count("*").alias("sample_size")))


def by_temperature(trips: DataFrame, long_labels: bool = False) -> DataFrame:
    """By ranges of ten degrees."""
    placed = trips.withColumn("temp_bucket", temperature_range(F.col("temp_c"), long_labels))
    return _grouped(placed, ["temp_bucket"], BY_TEMPERATURE, F.avg("temp_c").alias("avg_temp_in_bucket"), F.count("*").alias("sample_size"))


def by_precipitation(trips: DataFrame, long_labels: bool = False) -> DataFrame:
    """By precipitation level."""
    placed = trips.withColumn("precip_level", precipitation_level(F.col("precip_daily_mm"), long_labels))
    return _grouped(placed, ["precip_level"], BY_PRECIPITATION, F.avg("precip_daily_mm").alias("avg_precip_in_level"), F.count("*").alias("sample_size"))
