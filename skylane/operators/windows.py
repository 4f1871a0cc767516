"""Tumbling and sliding window aggregations. All work on batch frames and, with watermarks, on streams.

The ``window`` struct stays a column, because joins and second aggregations of streams need it as the key;
:func:`flat` turns it into ``window_start`` and ``window_end``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylane.functions.ladders import below, flag, share


def _window(ts: str, duration: str, slide: str | None):
    return (F.window(ts, duration, slide) if slide else F.window(ts, duration)).alias("window")


def _count(condition):
    return F.count(F.when(condition, 1))


def flat(df: DataFrame) -> DataFrame:
    """Replace ``window`` by its start and end."""
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in df.columns if c != "window"])


def bike_windows(df: DataFrame, duration: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Rentals by window and user type."""
    seconds = F.col("duration_seconds")
    grouped = df.groupBy(_window("start_time_ts", duration, slide), "user_type").agg(
        F.count("*").alias("rental_count"), F.avg(seconds).alias("avg_duration_seconds"), F.min(seconds).alias("min_duration_seconds"),
        F.max(seconds).alias("max_duration_seconds"), F.stddev(seconds).alias("stddev_duration"), F.count("start_station_id").alias("total_trips_started"),
        F.avg("birth_year").alias("avg_birth_year"),
        *[_count(F.col("gender") == code).alias(name) for code, name in ((2, "female_count"), (1, "male_count"), (0, "unknown_gender_count"))],
    )
    known = F.col("male_count") + F.col("female_count")
    return grouped.withColumns(
        {"avg_duration_minutes": F.col("avg_duration_seconds") / 60.0, "gender_diversity_ratio": share(F.col("female_count"), known, otherwise=None)}
    )


def taxi_windows(df: DataFrame, duration: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Rides by window and cab type."""
    means = {
        "price": "avg_price", "distance": "avg_distance", "surge_multiplier": "avg_surge", "temperature": "avg_temperature",
        "apparent_temperature": "avg_feels_like_temp", "humidity": "avg_humidity", "wind_speed": "avg_wind_speed", "precip_intensity": "avg_precip_intensity",
    }
    grouped = df.groupBy(_window("datetime_ts", duration, slide), "cab_type").agg(
        F.count("*").alias("ride_count"), F.sum("price").alias("total_revenue"), F.max("surge_multiplier").alias("max_surge"),
        *[F.avg(c).alias(name) for c, name in means.items()],
    )
    return grouped.withColumns({"revenue_per_ride": F.col("total_revenue") / F.col("ride_count"), "high_surge_indicator": flag(F.col("avg_surge") > 1.5)})


def weather_windows(df: DataFrame, duration: str = "15 minutes", slide: str | None = None, tie: str | None = None) -> DataFrame:
    """Observations by window. The dominant categories are those of the earliest observation (smallest ``tie`` first)."""
    first = F.struct("datetime_ts", *([tie] if tie else []))
    t, w, v = F.col("temp_c"), F.col("wind_speed_ms"), F.col("visibility_m")
    grouped = df.groupBy(_window("datetime_ts", duration, slide)).agg(
        F.count("*").alias("observation_count"),
        F.avg(t).alias("avg_temperature_c"), F.min(t).alias("min_temperature_c"), F.max(t).alias("max_temperature_c"),
        F.avg(w).alias("avg_wind_speed_ms"), F.max(w).alias("max_wind_speed_ms"),
        F.avg(v).alias("avg_visibility_m"), F.min(v).alias("min_visibility_m"),
        F.avg("weather_condition_score").alias("avg_weather_score"),
        _count(F.col("is_good_weather")).alias("good_weather_obs_count"), _count(F.col("is_bad_weather")).alias("bad_weather_obs_count"),
        *[F.min_by(c, first).alias(f"dominant_{c}") for c in ("temp_bucket", "wind_category", "visibility_category")],
    )
    return grouped.withColumns(
        {
            "temperature_range_c": F.col("max_temperature_c") - F.col("min_temperature_c"),
            "good_weather_ratio": share(F.col("good_weather_obs_count"), F.col("observation_count")),
        }
    )


def accident_windows(df: DataFrame, duration: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Accidents by window and mode."""
    place = F.col("location_type")
    grouped = df.groupBy(_window("dispatch_timestamp", duration, slide), "mode_type").agg(
        F.count("*").alias("accident_count"), _count(place == "Intersection").alias("intersection_accidents"), _count(place == "Street").alias("street_accidents"),
        F.avg("lat").alias("avg_accident_lat"), F.avg("long").alias("avg_accident_long"),
    )
    return grouped.withColumn("intersection_accident_ratio", share(F.col("intersection_accidents"), F.col("accident_count")))


def combined_windows(bikes: DataFrame, taxis: DataFrame, weather: DataFrame, duration: str = "15 minutes", weighted: bool = False, tie: str | None = None) -> DataFrame:
    """Bike, taxi and weather totals of each window that has a trip or a ride.

    Means over user and cab types are means of the types' means; ``weighted`` gives means over trips instead.
    """
    mean = (lambda c, n: F.sum(F.col(c) * F.col(n)) / F.sum(n)) if weighted else (lambda c, n: F.avg(c))
    by_bike = bike_windows(bikes, duration).groupBy("window").agg(
        F.sum("rental_count").alias("total_bike_rentals"), mean("avg_duration_minutes", "rental_count").alias("avg_bike_duration_min")
    )
    by_taxi = taxi_windows(taxis, duration).groupBy("window").agg(
        F.sum("ride_count").alias("total_taxi_rides"), mean("avg_price", "ride_count").alias("avg_taxi_price"), mean("avg_surge", "ride_count").alias("avg_taxi_surge")
    )
    kept = ["avg_temperature_c", "avg_wind_speed_ms", "avg_weather_score", "good_weather_ratio", "dominant_temp_bucket", "dominant_wind_category"]
    sky = weather_windows(weather, duration, tie=tie).select("window", *kept)
    joined = by_bike.join(by_taxi, "window", "full_outer").join(sky, "window", "left").fillna(0, ["total_bike_rentals", "total_taxi_rides"])
    bikes_, total = F.col("total_bike_rentals"), F.col("total_transport_usage")
    return joined.withColumn("total_transport_usage", bikes_ + F.col("total_taxi_rides")).withColumn("bike_share_pct", share(bikes_, total, 100))


#: Bins of the binned aggregates: column, bounds, label above all, and whether the spread and total are reported (fixed values).
BINS = {
    "temp": ("avg_temperature_c", [(0, "-5_to_0C"), (5, "0_to_5C"), (10, "5_to_10C"), (15, "10_to_15C"), (20, "15_to_20C"), (25, "20_to_25C")], "25_to_30C"),
    "wind": ("avg_wind_speed_ms", [(3, "0_to_3ms"), (6, "3_to_6ms"), (9, "6_to_9ms"), (12, "9_to_12ms")], "12+ms"),
    "score": ("avg_weather_score", [(30, "poor_0-30"), (50, "fair_30-50"), (70, "good_50-70")], "excellent_70+"),
}


def usage_by_bin(combined: DataFrame, by: str) -> DataFrame:
    """Mean usage of windows by bins of temperature, wind or score; windows without the value are left out."""
    column, rungs, top = BINS[by]
    name = {"temp": "temp_bin", "wind": "wind_bin", "score": "weather_score_bin"}[by]
    measures = [
        F.avg("total_bike_rentals").alias(f"avg_bike_rentals_in_{by}_bin"), F.avg("total_taxi_rides").alias(f"avg_taxi_rides_in_{by}_bin"), F.count("*").alias("sample_count"),
    ]
    if by == "temp":
        measures += [F.avg("total_transport_usage").alias("avg_total_usage_in_temp_bin"), F.stddev("total_bike_rentals").alias("stddev_bike_rentals")]
    if by == "score":
        measures.append(F.avg("avg_weather_score").alias("avg_score_in_bin"))
    kind = {"temp": "by_temperature_bin", "wind": "by_wind_bin", "score": "by_weather_score_bin"}[by]
    binned = combined.withColumn(name, below(F.col(column), rungs, top, "unknown")).where(F.col(name) != "unknown")
    return binned.groupBy(name).agg(*measures).withColumn("aggregation_type", F.lit(kind))


def session_counts(df: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """Rows of each session: rows of a key that follow each other within ``gap`` (batch frames and, with a watermark, streams)."""
    return df.groupBy(*keys, F.session_window(ts, gap).alias("window")).agg(F.count("*").alias("n"))


def forward_fill(df: DataFrame, keys: list[str], ts: str, value: str, out: str, tie: str | None = None) -> DataFrame:
    """``df`` with ``out``: the last ``value`` that isn't null at or before each row of its keys, in order of ``ts`` (and ``tie``).

    Filled within each day; what stands before a day's first value comes from the last values of earlier days, one row a
    day, so no window holds more than a day of one key. Null keys are a key of their own.
    """
    day = F.substring(ts, 1, 10) if dict(df.dtypes)[ts] == "string" else F.to_date(ts)  # ISO text begins with the day
    rows = df.withColumn("__day", day)
    order = F.struct(ts, *([tie] if tie else []))
    latest = rows.where(F.col(value).isNotNull()).groupBy(*keys, "__day").agg(F.max_by(value, order).alias("latest"))
    days = rows.select(*keys, "__day").distinct().alias("a").join(latest.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "__day")], "left")
    days = days.select(*[F.col(f"a.{c}").alias(f"__{k}") for k, c in enumerate(keys)], F.col("a.__day").alias("__d"), "latest")
    earlier = Window.partitionBy(*[f"__{k}" for k in range(len(keys))]).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__before", F.last("latest", ignorenulls=True).over(earlier)).drop("latest")
    within = Window.partitionBy(*keys, "__day").orderBy(ts, *([tie] if tie else []))
    filled = rows.withColumn("__within", F.last(value, ignorenulls=True).over(within))
    same = [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(keys)] + [F.col("__day").eqNullSafe(F.col("__d"))]
    return filled.join(days, same, "left").select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.coalesce("__within", "__before").alias(out))
