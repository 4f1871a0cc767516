"""Row-wise scores over combined windows, rides and accident windows.

All are plain expressions, so Catalyst folds each into one projection over the stored window table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions.ladders import below, flag, one_if, share
from skylane.functions.weather import TEMPERATURE_RUNGS
from skylane.operators.windows import accident_windows, flat

#: Hours of heavy traffic; days of the week count from Sunday = 1 (fixed values).
RUSH_HOURS, WEEKEND_DAYS = [7, 8, 9, 17, 18, 19], [1, 7]


def _hour() -> Column:
    return F.hour("window_start")


def _rush() -> Column:
    return F.hour("window_start").isin(RUSH_HOURS)


def _weekend() -> Column:
    return F.dayofweek("window_start").isin(WEEKEND_DAYS)


def weather_transport(combined: DataFrame) -> DataFrame:
    """Weather flags, mode preferences, elasticities against comfortable weather, and deviations from expected demand."""
    n_bikes = F.col("total_bike_rentals")
    n_taxis = F.col("total_taxi_rides")
    all_trips = F.col("total_transport_usage")
    temp = F.col("avg_temperature_c")
    wind_speed = F.col("avg_wind_speed_ms")
    comfort = F.col("avg_weather_score")
    mild = flag(temp.between(15, 25))
    cold, hot, windy, poor = flag(temp < 5), flag(temp > 25), flag(wind_speed > 10), flag(comfort < 40)
    for_bikes = F.when(mild, 0.0).when(cold, -0.3).when(hot, -0.2).when(windy, -0.25).otherwise(-0.15)
    for_taxis = F.when(mild, 0.0).when(poor, 0.4).otherwise(0.1)
    expected_bikes, expected_taxis = (for_bikes + 1) * 100, (for_taxis + 1) * 50
    return combined.withColumns(
        {
            "is_cold": cold.cast("int"), "is_hot": hot.cast("int"), "is_comfortable": mild.cast("int"), "is_windy": windy.cast("int"), "is_poor_weather": poor.cast("int"),
            "bike_preference_score": F.when(all_trips > 0, n_bikes / all_trips * comfort).otherwise(0.0),
            "taxi_preference_score": F.when(all_trips > 0, n_taxis / all_trips * (100 - comfort)).otherwise(0.0),
            "bike_weather_elasticity": for_bikes, "taxi_weather_elasticity": for_taxis,
            "expected_bike_rentals": expected_bikes, "expected_taxi_rides": expected_taxis,
            "bike_demand_deviation": n_bikes - expected_bikes, "taxi_demand_deviation": n_taxis - expected_taxis,
            "weather_transport_impact_score": (comfort - 50) * 2,
        }
    )


def precipitation_impact(combined: DataFrame) -> DataFrame:
    """Likely rain from the score, mode shares, and how far rain moves riders from bikes to taxis."""
    n_bikes = F.col("total_bike_rentals")
    n_taxis = F.col("total_taxi_rides")
    all_trips = F.col("total_transport_usage")
    comfort = F.col("avg_weather_score")
    wet, taxi_share = flag(comfort < 40), share(n_taxis, all_trips, 100)
    lost = F.when(wet, (100 - comfort) / 2).otherwise(0.0)
    return combined.withColumns(
        {
            "precipitation_indicator": below(comfort, [(30, "likely_precipitating"), (50, "possibly_precipitating")], "dry"),
            "precipitation_binary": wet.cast("int"),
            "bike_mode_share_pct": share(n_bikes, all_trips, 100),
            "taxi_mode_share_pct": taxi_share,
            "precip_bike_impact_score": lost,
            "precip_taxi_boost_score": lost,
            "weather_driven_mode_substitution": wet & flag(taxi_share > 60),
        }
    )


def temporal_segments(combined: DataFrame) -> DataFrame:
    """Segment of the week, its weather sensitivity and expected correlation, and the intensity of use."""
    all_trips = F.col("total_transport_usage")
    segment = (
        F.when(~_weekend() & _rush(), "weekday_rush_hour").when(~_weekend(), "weekday_off_peak").when(_hour().between(8, 20), "weekend_day").otherwise("weekend_night")
    )
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), segment)
    return combined.withColumns(
        {
            "hour_of_day": _hour(), "day_of_week": F.dayofweek("window_start"), "is_weekend": _weekend(), "is_rush_hour": _rush(), "temporal_segment": segment,
            "segment_weather_sensitivity": of({"weekday_rush_hour": "low", "weekday_off_peak": "medium", "weekend_day": "high", "weekend_night": "very_high"}),
            "expected_temp_bike_correlation": of({"weekday_rush_hour": 0.25, "weekday_off_peak": 0.45, "weekend_day": 0.75, "weekend_night": 0.60}),
            "usage_intensity_category": below(all_trips, [(50, "very_low"), (150, "low"), (300, "moderate"), (500, "high")], "very_high"),
        }
    )


def surge_reasons(rides: DataFrame) -> DataFrame:
    """Whether a ride's surge price goes with its weather."""
    signs = {
        "is_raining": (F.col("precip_intensity") > 0, 30), "is_very_cold": (F.col("temperature") < 0, 20),
        "is_very_hot": (F.col("temperature") > 30, 15), "is_humid": (F.col("humidity") > 0.8, 10),
    }
    points = sum((one_if(c) * p for c, p in signs.values()), F.lit(0))
    surge = flag(F.col("surge_multiplier") > 1.0)
    reason = F.when(~surge, "no_surge").when(points > 40, "weather_driven").when(points > 20, "partially_weather").otherwise("demand_driven")
    return rides.withColumns({**{k: one_if(c) for k, (c, _) in signs.items()}, "is_surge": surge.cast("int"), "weather_driven_surge_score": points, "surge_reason": reason})


def usage_summary(bikes: DataFrame, taxis: DataFrame, duration: str = "1 hour") -> DataFrame:
    """Bike and taxi use side by side for each window, with mode shares, peak hours and weekends."""
    of = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    by_bike = bikes.groupBy(F.window("start_time_ts", duration).alias("window")).agg(
        F.count("*").alias("bike_count"), F.avg("duration_seconds").alias("avg_bike_duration"),
        of("user_type", "Subscriber").alias("subscriber_count"), of("user_type", "Customer").alias("customer_count"),
    )
    by_taxi = taxis.groupBy(F.window("datetime_ts", duration).alias("window")).agg(
        F.count("*").alias("taxi_count"), F.avg("price").alias("avg_taxi_price"), F.sum("price").alias("total_taxi_revenue"), F.avg("surge_multiplier").alias("avg_surge"),
        of("cab_type", "Uber").alias("uber_count"), of("cab_type", "Lyft").alias("lyft_count"),
    )
    counts = ["bike_count", "taxi_count", "subscriber_count", "customer_count", "uber_count", "lyft_count"]
    joined = flat(by_bike.join(by_taxi, "window", "full_outer").fillna(0, counts)).withColumn("total_transport_count", F.col("bike_count") + F.col("taxi_count"))
    total = F.col("total_transport_count")
    return joined.withColumns(
        {
            "hour_of_day": _hour(), "day_of_week": F.dayofweek("window_start"),
            "bike_mode_share_pct": share(F.col("bike_count"), total, 100), "taxi_mode_share_pct": share(F.col("taxi_count"), total, 100),
            "is_peak_hour": _rush(), "is_weekend": _weekend(),
        }
    )


def correlation_products(combined: DataFrame) -> DataFrame:
    """Products of use and weather (unknown weather counts as 0) and labels of the usual strength of correlation."""
    n_bikes = F.col("total_bike_rentals")
    n_taxis = F.col("total_taxi_rides")
    temp = F.col("avg_temperature_c")
    wind_speed = F.col("avg_wind_speed_ms")
    comfort = F.col("avg_weather_score")
    pairs = {
        "bike_temp_product": (n_bikes, temp), "bike_wind_product": (n_bikes, wind_speed), "bike_weather_score_product": (n_bikes, comfort),
        "taxi_temp_product": (n_taxis, temp), "taxi_wind_product": (n_taxis, wind_speed),
    }
    warm = (
        F.when(temp.isNull(), "unknown").when(temp < 0, "strong_negative").when(temp.between(0, 10), "moderate_negative").when(temp > 30, "moderate_negative").otherwise("positive")
    )
    windy = below(wind_speed, [(5, "neutral"), (10, "moderate_negative")], "strong_negative", "unknown")
    products = {k: a * F.coalesce(b, F.lit(0.0)) for k, (a, b) in pairs.items()}
    return combined.withColumns({**products, "bike_temp_correlation_strength": warm, "bike_wind_correlation_strength": windy})


def correlations(combined: DataFrame) -> DataFrame:
    """Pearson coefficients of use and weather over all windows, one row."""
    uses, skies = {"bike": "total_bike_rentals", "taxi": "total_taxi_rides"}, {"temp": "avg_temperature_c", "wind": "avg_wind_speed_ms", "score": "avg_weather_score"}
    return combined.agg(*[F.corr(u, s).alias(f"r_{a}_{b}") for a, u in uses.items() for b, s in skies.items()], F.count("*").alias("windows"))


def weather_bins(combined: DataFrame, floor: bool = False) -> DataFrame:
    """Numeric bins and labels of temperature, wind and score, and use for each unit of them.

    Numeric bins cut towards zero, so -5 to 5 degrees share bin 0; ``floor`` rounds down instead.
    """
    n_bikes = F.col("total_bike_rentals")
    temp = F.col("avg_temperature_c")
    wind_speed = F.col("avg_wind_speed_ms")
    comfort = F.col("avg_weather_score")
    cut = F.floor if floor else (lambda x: x.cast("int"))
    number = lambda value, step: F.when(value.isNull(), -999).otherwise((cut(value / step) * step).cast("int"))
    return combined.withColumns(
        {
            "temp_bin_numeric": number(temp, 5),
            "temp_bin_label": below(temp, TEMPERATURE_RUNGS, "above_30C", "unknown"),
            "wind_bin_numeric": number(wind_speed, 2),
            "wind_bin_label": below(wind_speed, [(2, "calm_0-2ms"), (5, "light_2-5ms"), (8, "moderate_5-8ms"), (12, "fresh_8-12ms")], "strong_12+ms", "unknown"),
            "weather_score_bin": below(comfort, [(20, "very_poor_0-20"), (40, "poor_20-40"), (60, "moderate_40-60"), (80, "good_60-80")], "excellent_80-100", "unknown"),
            "bikes_per_degree": F.when(temp != 0, n_bikes / temp),
            "bikes_per_weather_score_point": F.when(comfort > 0, n_bikes / comfort),
        }
    )


def multi_variable(combined: DataFrame) -> DataFrame:
    """Normalised measures, a square, an interaction, two flags, and a linear demand index with its error."""
    n_bikes = F.col("total_bike_rentals")
    n_taxis = F.col("total_taxi_rides")
    temp = F.col("avg_temperature_c")
    wind_speed = F.col("avg_wind_speed_ms")
    comfort = F.col("avg_weather_score")
    bike = F.when(n_bikes > 0, n_bikes / 100.0).otherwise(0.0)
    warmth, wind, score = F.coalesce((temp + 10) / 40.0, F.lit(0.5)), F.coalesce(wind_speed / 20.0, F.lit(0.0)), F.coalesce(comfort / 100.0, F.lit(0.5))
    predicted, actual = warmth * 40 + (1 - wind) * 30 + score * 30, bike * 100
    return combined.withColumns(
        {
            "bike_usage_normalized": bike, "taxi_usage_normalized": F.when(n_taxis > 0, n_taxis / 50.0).otherwise(0.0),
            "temperature_normalized": warmth, "wind_normalized": wind, "weather_score_normalized": score,
            "temperature_squared": temp * temp, "temp_wind_interaction": temp * wind_speed,
            "strong_positive_weather_for_bikes": flag(temp.between(15, 25) & (wind_speed < 8) & (comfort > 70)),
            "strong_negative_weather_for_bikes": flag((temp < 0) | (wind_speed > 12) | (comfort < 30)),
            "predicted_bike_demand_index": predicted, "actual_bike_demand_index": actual, "demand_prediction_error": actual - predicted,
        }
    )


def safety_risk(accidents: DataFrame, weather: DataFrame, duration: str = "1 hour") -> DataFrame:
    """Accident counts by window and mode, weighed by the weather of the window."""
    comfort = F.col("avg_weather_score")
    counted = accidents.groupBy(F.window("dispatch_timestamp", duration).alias("window"), "mode_type").agg(F.count("*").alias("accident_count"))
    sky = weather.groupBy(F.window("datetime_ts", duration).alias("window")).agg(
        F.avg("temp_c").alias("avg_temp"), F.avg("wind_speed_ms").alias("avg_wind"), F.avg("visibility_m").alias("avg_visibility"),
        F.avg("weather_condition_score").alias("avg_weather_score"), F.count(F.when(F.col("is_bad_weather"), 1)).alias("bad_weather_obs"),
    )
    times = below(comfort, [(20, 3.0), (40, 2.0), (60, 1.5)], 1.0, 1.0)
    index = F.col("accident_count") * times
    capped = F.least(index, F.lit(10.0))
    modes = F.when(F.col("mode_type") == "bike", "cycling").when(F.col("mode_type") == "ped", "pedestrian").when(F.col("mode_type") == "mv", "vehicle").otherwise("unknown")
    return flat(counted.join(sky, "window", "left")).withColumns(
        {
            "base_accident_risk": F.col("accident_count"), "weather_risk_multiplier": times, "safety_risk_index": index, "safety_risk_index_normalized": capped,
            "risk_category": below(capped, [(2, "low"), (5, "moderate"), (8, "high")], "very_high"), "high_risk_mode": modes,
        }
    )


def accident_weather(combined: DataFrame, accidents: DataFrame, duration: str = "15 minutes") -> DataFrame:
    """Accident windows against weather and traffic: rates, risk points and categories, expected numbers and alerts.

    ``combined`` has the ``window`` struct.
    """
    all_trips = F.col("total_transport_usage")
    temp = F.col("avg_temperature_c")
    wind_speed = F.col("avg_wind_speed_ms")
    comfort = F.col("avg_weather_score")
    kept = ["avg_temperature_c", "avg_wind_speed_ms", "avg_weather_score", "total_bike_rentals", "total_taxi_rides", "total_transport_usage"]
    counted = accident_windows(accidents, duration).drop("street_accidents", "intersection_accident_ratio")
    joined = flat(counted.join(combined.select("window", *kept), "window", "left"))
    wet, freezing, windy, dim = flag(comfort < 40), flag(temp < 0), flag(wind_speed > 11), flag(comfort < 30)
    add = lambda base, *parts: sum((F.when(c, p).otherwise(0) for c, p in parts), F.lit(base))
    points, times = add(50, (wet, 20), (freezing, 25), (windy, 15), (dim, 15)), add(1.0, (wet, 0.7), (freezing, 1.2), (windy, 0.5))
    rate = share(F.col("accident_count"), all_trips, 1000, None)
    mode = F.col("mode_type")
    exposed = F.when(((mode == "bike") & (wet | windy)) | ((mode == "mv") & freezing), "high_vulnerability").when((mode == "ped") & windy, "medium_vulnerability").otherwise("low_vulnerability")
    expected = times * 2.0 * (all_trips / 1000.0)
    return joined.withColumns(
        {
            "has_precipitation": wet, "is_freezing": freezing, "is_high_wind": windy, "accident_rate_per_1000_trips": rate,
            "weather_accident_risk_score": points, "weather_accident_risk_category": below(points, [(60, "low"), (75, "medium"), (90, "high")], "critical"),
            "mode_weather_vulnerability": exposed, "hour_of_day": _hour(), "is_rush_hour": _rush(),
            "expected_accident_multiplier": times, "baseline_accident_rate": F.lit(2.0), "expected_accidents_in_weather": expected,
            "accident_deviation": F.col("accident_count") - expected, "should_send_safety_alert": flag(points >= 85) | flag(rate > 10),
        }
    )
