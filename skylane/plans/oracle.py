"""DuckDB SQL for each registered query: same columns, rows and rounding, written without the operators' code."""

from __future__ import annotations

import re

from skylane.sources.adapters import adapter_sql

_MINUTES15 = "INTERVAL '15 minutes'"


def _case(value: str, rungs: str, top: str, missing: str | None = None) -> str:
    """'5:a 10:b' as CASE WHEN value < 5 THEN 'a' ..."""
    steps = " ".join(f"WHEN {value} < {b} THEN '{r}'" for b, r in (x.rsplit(":", 1) for x in rungs.split(" ")))
    null = f"WHEN {value} IS NULL THEN '{missing}' " if missing else ""
    return f"CASE {null}{steps} ELSE '{top}' END"


_TEMP_RUNGS = "-10:below_-10C -5:-10_to_-5C 0:-5_to_0C 5:0_to_5C 10:5_to_10C 15:10_to_15C 20:15_to_20C 25:20_to_25C 30:25_to_30C"
_FIELD = "CASE WHEN contains({c}, ',') THEN TRY_CAST(string_split({c}, ',')[{i}] AS DOUBLE) / {d} ELSE TRY_CAST({c} AS DOUBLE) END"

CTES = {
    **{t: adapter_sql(t) for t in ("bike_trips", "taxi_rides", "weather_raw", "accidents")},
    "sky0": "SELECT *, " + ", ".join(_FIELD.format(c=c, i=i, d=d) + f" AS {n}" for c, i, d, n in (("temperature", 1, "10.0", "temp_c"), ("wind", 4, "10.0", "wind_speed_ms"), ("visibility", 1, "1.0", "visibility_m"))) + " FROM weather_raw",
    "sky1": f"""SELECT *, {_case('temp_c', _TEMP_RUNGS, 'above_30C', 'unknown')} AS temp_bucket,
        {_case('wind_speed_ms', '1.5:calm 5.5:light_breeze 10.8:moderate 17.2:fresh', 'strong_wind', 'unknown')} AS wind_category,
        {_case('visibility_m', '1000:very_poor 4000:poor 10000:moderate 20000:good', 'excellent', 'unknown')} AS visibility_category,
        CAST(CASE WHEN temp_c IS NULL THEN 50 ELSE
          (CASE WHEN temp_c BETWEEN 15 AND 25 THEN 40 WHEN temp_c BETWEEN 10 AND 15 THEN 35 WHEN temp_c BETWEEN 25 AND 30 THEN 35 WHEN temp_c BETWEEN 5 AND 10 THEN 25 WHEN temp_c BETWEEN 0 AND 5 THEN 20 ELSE 10 END)
          + (CASE WHEN wind_speed_ms < 1.5 THEN 30 WHEN wind_speed_ms < 5.5 THEN 25 WHEN wind_speed_ms < 10.8 THEN 15 ELSE 5 END)
          + (CASE WHEN visibility_m > 20000 THEN 30 WHEN visibility_m > 10000 THEN 25 WHEN visibility_m > 4000 THEN 15 ELSE 5 END) END AS DOUBLE) AS weather_condition_score FROM sky0""",
    "sky": "SELECT *, weather_condition_score >= 70 AS is_good_weather, weather_condition_score <= 30 AS is_bad_weather FROM sky1",
    "metered": """SELECT *, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS distance_meters FROM (SELECT *,
        power(sin((radians(end_station_latitude) - radians(start_station_latitude)) / 2), 2) + cos(radians(start_station_latitude)) * cos(radians(end_station_latitude))
        * power(sin((radians(end_station_longitude) - radians(start_station_longitude)) / 2), 2) AS h FROM bike_trips)""",
    "speedy": "SELECT *, CASE WHEN duration_seconds > 0 THEN distance_meters / duration_seconds * 3.6 ELSE 0 END AS average_speed_kmh FROM metered",
    "pairs": "SELECT b.trip_no, w.obs_no, b.start_time_ts, w.datetime_ts AS weather_ts, abs(epoch_us(b.start_time_ts) - epoch_us(w.datetime_ts)) AS gap FROM bike_trips b JOIN weather_raw w ON w.datetime_ts BETWEEN b.start_time_ts - INTERVAL '1 hour' AND b.start_time_ts + INTERVAL '1 hour'",
    "near": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_no ORDER BY gap, weather_ts, obs_no) AS rn FROM pairs) WHERE rn = 1",
    "trips": """SELECT s.trip_no, s.start_time_ts AS starttime, s.start_time_ts + to_seconds(s.duration_seconds) AS stoptime, CAST(s.duration_seconds AS DOUBLE) AS tripduration, s.distance_meters,
        s.average_speed_kmh, k.temp_c, k.precip_daily_mm, CASE WHEN k.temp_c BETWEEN 10 AND 25 AND k.precip_daily_mm = 0 THEN 'good' WHEN k.temp_c < 5 OR k.temp_c > 30 OR k.precip_daily_mm > 5 THEN 'poor' ELSE 'fair' END AS weather_condition
        FROM speedy s JOIN near n USING (trip_no) JOIN sky k ON k.obs_no = n.obs_no""",
    "bikes15": f"""SELECT time_bucket({_MINUTES15}, start_time_ts) AS window_start, user_type, count(*) AS rental_count, avg(duration_seconds) AS avg_duration_seconds, min(duration_seconds) AS min_duration_seconds,
        max(duration_seconds) AS max_duration_seconds, stddev(duration_seconds) AS stddev_duration, count(start_station_id) AS total_trips_started, avg(birth_year) AS avg_birth_year, count(*) FILTER (gender = 2) AS female_count,
        count(*) FILTER (gender = 1) AS male_count, count(*) FILTER (gender = 0) AS unknown_gender_count FROM bike_trips GROUP BY ALL""",
    "taxis15": f"""SELECT time_bucket({_MINUTES15}, datetime_ts) AS window_start, cab_type, count(*) AS ride_count, sum(price) AS total_revenue, max(surge_multiplier) AS max_surge, avg(price) AS avg_price, avg(distance) AS avg_distance,
        avg(surge_multiplier) AS avg_surge, avg(temperature) AS avg_temperature, avg(apparent_temperature) AS avg_feels_like_temp, avg(humidity) AS avg_humidity, avg(wind_speed) AS avg_wind_speed, avg(precip_intensity) AS avg_precip_intensity FROM taxi_rides GROUP BY ALL""",
    "sky15": f"""SELECT time_bucket({_MINUTES15}, datetime_ts) AS window_start, count(*) AS observation_count, avg(temp_c) AS avg_temperature_c, min(temp_c) AS min_temperature_c, max(temp_c) AS max_temperature_c, avg(wind_speed_ms) AS avg_wind_speed_ms,
        max(wind_speed_ms) AS max_wind_speed_ms, avg(visibility_m) AS avg_visibility_m, min(visibility_m) AS min_visibility_m, avg(weather_condition_score) AS avg_weather_score, count(*) FILTER (is_good_weather) AS good_weather_obs_count,
        count(*) FILTER (is_bad_weather) AS bad_weather_obs_count, arg_min(temp_bucket, (datetime_ts, obs_no)) AS dominant_temp_bucket, arg_min(wind_category, (datetime_ts, obs_no)) AS dominant_wind_category, arg_min(visibility_category, (datetime_ts, obs_no)) AS dominant_visibility_category FROM sky GROUP BY ALL""",
    "accidents15": f"""SELECT time_bucket({_MINUTES15}, dispatch_timestamp) AS window_start, mode_type, count(*) AS accident_count, count(*) FILTER (location_type = 'Intersection') AS intersection_accidents, count(*) FILTER (location_type = 'Street') AS street_accidents,
        avg(lat) AS avg_accident_lat, avg(long) AS avg_accident_long FROM accidents GROUP BY ALL""",
    "joined": """SELECT coalesce(b.window_start, t.window_start) AS window_start, coalesce(b.n, 0) AS total_bike_rentals, b.m AS avg_bike_duration_min, b.wm AS w_bike, coalesce(t.n, 0) AS total_taxi_rides, t.p AS avg_taxi_price, t.s AS avg_taxi_surge, t.wp AS w_price, t.ws AS w_surge
        FROM (SELECT window_start, CAST(sum(rental_count) AS BIGINT) AS n, avg(avg_duration_seconds / 60) AS m, sum(avg_duration_seconds / 60 * rental_count) / sum(rental_count) AS wm FROM bikes15 GROUP BY 1) b
        FULL JOIN (SELECT window_start, CAST(sum(ride_count) AS BIGINT) AS n, avg(avg_price) AS p, avg(avg_surge) AS s, sum(avg_price * ride_count) / sum(ride_count) AS wp, sum(avg_surge * ride_count) / sum(ride_count) AS ws FROM taxis15 GROUP BY 1) t ON b.window_start = t.window_start""",
    "combined": f"""SELECT j.*, j.window_start + {_MINUTES15} AS window_end, s.avg_temperature_c, s.avg_wind_speed_ms, s.avg_weather_score, CAST(s.good_weather_obs_count AS DOUBLE) / s.observation_count AS good_weather_ratio, s.dominant_temp_bucket, s.dominant_wind_category,
        total_bike_rentals + total_taxi_rides AS total_transport_usage, CASE WHEN total_bike_rentals + total_taxi_rides > 0 THEN total_bike_rentals / (total_bike_rentals + total_taxi_rides) * 100 ELSE 0 END AS bike_share_pct FROM joined j LEFT JOIN sky15 s ON s.window_start = j.window_start""",
    "risk": """SELECT a.window_start, a.window_start + INTERVAL '1 hour' AS window_end, mode_type, accident_count, avg_temp, avg_wind, avg_visibility, avg_weather_score, bad_weather_obs,
        CAST(CASE WHEN avg_weather_score IS NULL THEN 1 WHEN avg_weather_score < 20 THEN 3 WHEN avg_weather_score < 40 THEN 2 WHEN avg_weather_score < 60 THEN 1.5 ELSE 1 END AS DOUBLE) AS weather_risk_multiplier
        FROM (SELECT time_bucket(INTERVAL '1 hour', dispatch_timestamp) AS window_start, mode_type, count(*) AS accident_count FROM accidents GROUP BY ALL) a
        LEFT JOIN (SELECT time_bucket(INTERVAL '1 hour', datetime_ts) AS window_start, avg(temp_c) AS avg_temp, avg(wind_speed_ms) AS avg_wind, avg(visibility_m) AS avg_visibility, avg(weather_condition_score) AS avg_weather_score, count(*) FILTER (is_bad_weather) AS bad_weather_obs FROM sky GROUP BY ALL) w USING (window_start)""",
    "surge": """SELECT *, CAST(precip_intensity > 0 AS INT) AS is_raining, CAST(temperature < 0 AS INT) AS is_very_cold, CAST(temperature > 30 AS INT) AS is_very_hot, CAST(humidity > 0.8 AS INT) AS is_humid, CAST(surge_multiplier > 1 AS INT) AS is_surge,
        30 * CAST(precip_intensity > 0 AS INT) + 20 * CAST(temperature < 0 AS INT) + 15 * CAST(temperature > 30 AS INT) + 10 * CAST(humidity > 0.8 AS INT) AS points FROM taxi_rides""",
    "surges": "SELECT *, points AS weather_driven_surge_score, CASE WHEN is_surge = 0 THEN 'no_surge' WHEN points > 40 THEN 'weather_driven' WHEN points > 20 THEN 'partially_weather' ELSE 'demand_driven' END AS surge_reason FROM surge",
}


def _with(body: str) -> str:
    """The body with the CTEs it needs, and R(x) for rounding."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in needed)
    return re.sub(r"\bSTRING\b", "VARCHAR", (f"WITH {ctes} " if ctes else "") + body)


def _r(expr: str, name: str | None = None) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6) AS {name or expr}"


def _rs(names: str) -> str:
    return ", ".join(_r(n) for n in names.split())


def _stats(name: str, column: str, measures: str) -> str:
    forms = {
        "mean": "avg({c})", "stddev": "stddev({c})", "variance": "variance({c})", "min": "min({c})", "max": "max({c})", "kurtosis": "kurtosis_pop({c})",
        "skewness": "skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0))",
        "median": "quantile_disc({c}, 0.5)", "p25": "quantile_disc({c}, 0.25)", "p75": "quantile_disc({c}, 0.75)",
    }
    return ", ".join(_r(forms[m].format(c=column), f"{m}_{name}") for m in measures.split())


_SPEED = "average_speed_kmh"
_SPREAD = f"{_r(f'max({_SPEED}) - min({_SPEED})', 'range_speed')}, {_r(f'stddev({_SPEED}) / nullif(avg({_SPEED}), 0)', 'cv_speed')}, {_r(f'quantile_disc({_SPEED}, 0.75) - quantile_disc({_SPEED}, 0.25)', 'iqr_speed')}"
_SHORT_TEMP = "CASE WHEN temp_c < 0 THEN 'Below 0°C' WHEN temp_c < 10 THEN '0-10°C' WHEN temp_c < 20 THEN '10-20°C' WHEN temp_c < 30 THEN '20-30°C' ELSE 'Above 30°C' END"
_LONG_TEMP = "CASE WHEN temp_c < 0 THEN 'Below 0°C (Freezing)' WHEN temp_c < 10 THEN '0-10°C (Cold)' WHEN temp_c < 20 THEN '10-20°C (Mild)' WHEN temp_c < 30 THEN '20-30°C (Warm)' ELSE 'Above 30°C (Hot)' END"
_LEVEL = "CASE WHEN precip_daily_mm = 0 THEN 'None' WHEN precip_daily_mm < 1 THEN 'Light' WHEN precip_daily_mm < 5 THEN 'Moderate' ELSE 'Heavy' END"
_LONG_LEVEL = "CASE WHEN precip_daily_mm = 0 THEN 'None (0mm)' WHEN precip_daily_mm > 0 AND precip_daily_mm < 1 THEN 'Light (<1mm)' WHEN precip_daily_mm >= 1 AND precip_daily_mm < 5 THEN 'Moderate (1-5mm)' ELSE 'Heavy (>5mm)' END"
_CONDITION = f"""SELECT weather_condition, {_stats('speed', _SPEED, 'mean median stddev min max p25 p75')}, {_stats('temp', 'temp_c', 'mean stddev min max')}, {_stats('distance', 'distance_meters', 'mean stddev')},
    {_stats('duration', 'tripduration', 'mean stddev')}, {_stats('precip', 'precip_daily_mm', 'mean max')}, count(*) AS sample_size, {_SPREAD} FROM trips GROUP BY 1"""
_BIKE_WINDOW = """rental_count, {d}, min_duration_seconds, max_duration_seconds, total_trips_started, female_count, male_count, unknown_gender_count""".format(d=_rs("avg_duration_seconds stddev_duration avg_birth_year"))
_BIKE_DERIVED = f"{_r('avg_duration_seconds / 60', 'avg_duration_minutes')}, {_r('CASE WHEN male_count + female_count > 0 THEN female_count / (male_count + female_count) END', 'gender_diversity_ratio')}"
_HOUR, _DAY = "hour(window_start)", "dayofweek(window_start) + 1"
_RUSH = f"{_HOUR} IN (7, 8, 9, 17, 18, 19)"
_WEEKEND = "dayofweek(window_start) IN (0, 6)"
_C = "window_start, window_end"
_T, _W, _S, _B, _X, _N = "avg_temperature_c", "avg_wind_speed_ms", "avg_weather_score", "total_bike_rentals", "total_taxi_rides", "total_transport_usage"


def _flag(condition: str) -> str:
    return f"coalesce({condition}, false)"


_WET, _ICE, _GALE, _DIM = (_flag(c) for c in (f"{_S} < 40", f"{_T} < 0", f"{_W} > 11", f"{_S} < 30"))
_POINTS = f"(50 + CASE WHEN {_WET} THEN 20 ELSE 0 END + CASE WHEN {_ICE} THEN 25 ELSE 0 END + CASE WHEN {_GALE} THEN 15 ELSE 0 END + CASE WHEN {_DIM} THEN 15 ELSE 0 END)"
_TIMES = f"(1.0::DOUBLE + CASE WHEN {_WET} THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN {_ICE} THEN 1.2::DOUBLE ELSE 0 END + CASE WHEN {_GALE} THEN 0.5::DOUBLE ELSE 0 END)"
_RATE = f"(CASE WHEN {_N} > 0 THEN accident_count / {_N} * 1000 END)"
_MILD = _flag(f"{_T} BETWEEN 15 AND 25")
_EB = f"CAST(CASE WHEN {_MILD} THEN 0 WHEN {_T} < 5 THEN -0.3 WHEN {_T} > 25 THEN -0.2 WHEN {_W} > 10 THEN -0.25 ELSE -0.15 END AS DOUBLE)"
_ET = f"CAST(CASE WHEN {_MILD} THEN 0 WHEN {_S} < 40 THEN 0.4 ELSE 0.1 END AS DOUBLE)"
_WARM, _WN, _SN, _BN = f"coalesce(({_T} + 10) / 40.0, 0.5)", f"coalesce({_W} / 20.0, 0)", f"coalesce({_S} / 100.0, 0.5)", f"(CASE WHEN {_B} > 0 THEN {_B} / 100.0 ELSE 0 END)"
_SEGMENT = f"CASE WHEN NOT {_WEEKEND} AND {_RUSH} THEN 'weekday_rush_hour' WHEN NOT {_WEEKEND} THEN 'weekday_off_peak' WHEN {_HOUR} BETWEEN 8 AND 20 THEN 'weekend_day' ELSE 'weekend_night' END"
_CAPPED = "least(accident_count * weather_risk_multiplier, 10)"
_CATEGORY = _case(_CAPPED, "2:low 5:moderate 8:high", "very_high")


def _bin(value: str, step: int) -> str:
    return f"CAST(CASE WHEN {value} IS NULL THEN -999 ELSE trunc({value} / {step}) * {step} END AS INT)"


_BODIES = {
    "flagship": _CONDITION,
    "met_haversine": f"SELECT trip_no, {_rs('distance_meters average_speed_kmh')} FROM speedy",
    "met_haversine_zero": f"SELECT trip_no, {_r('coalesce(distance_meters, 0)', 'distance_meters')}, {_r('CASE WHEN distance_meters > 0 THEN average_speed_kmh ELSE 0 END', 'average_speed_kmh')} FROM speedy",
    "flt_speed_outlier": f"SELECT trip_no, {_r(_SPEED)} FROM speedy WHERE {_SPEED} > 0 AND {_SPEED} < 50",
    "flt_geo_bounds": f"SELECT trip_no, {_rs('start_station_latitude start_station_longitude end_station_latitude end_station_longitude')} FROM bike_trips WHERE start_station_latitude BETWEEN 42.0 AND 42.6 AND end_station_latitude BETWEEN 42.0 AND 42.6 AND start_station_longitude BETWEEN -71.3 AND -70.8 AND end_station_longitude BETWEEN -71.3 AND -70.8",
    "flt_date_range": "SELECT trip_no, starttime, stoptime FROM trips WHERE starttime >= TIMESTAMP '2024-01-05' AND stoptime <= TIMESTAMP '2024-01-12 12:00:00'",
    "prj_trip_id": "SELECT trip_no, start_station_id || '_' || strftime(start_time_ts, '%Y%m%d%H%M%S') AS trip_id FROM bike_trips",
    "prj_calendar": "SELECT trip_no, start_time_ts, CAST(year(start_time_ts) AS INT) AS year, CAST(month(start_time_ts) AS INT) AS month, strftime(start_time_ts, '%Y-%m-%d') AS date, CAST(hour(start_time_ts) AS INT) AS hour FROM bike_trips",
    "enr_weather": f"SELECT obs_no, datetime_ts, {_rs('temp_c wind_speed_ms visibility_m')}, temp_bucket, wind_category, visibility_category, {_r('weather_condition_score')}, is_good_weather, is_bad_weather, weather_condition_score < 40 AS has_precipitation, CASE WHEN weather_condition_score >= 40 THEN 'none' WHEN weather_condition_score < 20 THEN 'heavy' WHEN weather_condition_score < 30 THEN 'moderate' ELSE 'light' END AS precip_category FROM sky",
    "cat_conditions": f"SELECT obs_no, CASE WHEN temp_c IS NULL THEN 'unknown' WHEN temp_c BETWEEN 15 AND 25 AND visibility_m > 10000 THEN 'good' WHEN temp_c BETWEEN 10 AND 30 AND visibility_m > 5000 THEN 'fair' ELSE 'poor' END AS condition_vis, CASE WHEN temp_c BETWEEN 10 AND 25 AND precip_daily_mm = 0 THEN 'good' WHEN temp_c < 5 OR temp_c > 30 OR precip_daily_mm > 5 THEN 'poor' ELSE 'fair' END AS condition_precip, {_SHORT_TEMP} AS temp_short, {_LONG_TEMP} AS temp_long, {_LEVEL} AS precip_short, {_LONG_LEVEL} AS precip_long FROM sky",
    "jn_interval_inner": "SELECT trip_no, obs_no FROM pairs",
    "jn_nearest": f"SELECT trip_no, start_time_ts, obs_no, weather_ts, {_r('gap / 1000000', 'time_diff')} FROM near",
    "jn_nearest_rn": "SELECT trip_no, obs_no FROM near",
    "jn_tolerance_left": "SELECT b.trip_no, w.obs_no FROM bike_trips b LEFT JOIN weather_raw w ON w.datetime_ts BETWEEN b.start_time_ts - INTERVAL '5 minutes' AND b.start_time_ts + INTERVAL '5 minutes'",
    "jn_daily_precip": f"SELECT trip_no, d.precip_date, {_r('d.total', 'daily_precip_mm')}, coalesce(d.total > 0, false) AS has_precipitation FROM bike_trips b LEFT JOIN (SELECT strftime(datetime_ts, '%Y-%m-%d') AS precip_date, sum(coalesce(precip_daily_mm, 0)) AS total FROM weather_raw GROUP BY 1) d ON strftime(b.start_time_ts, '%Y-%m-%d') = d.precip_date",
    "agg_bike_window": f"SELECT window_start, window_start + {_MINUTES15} AS window_end, user_type, {_BIKE_WINDOW}, {_BIKE_DERIVED} FROM bikes15",
    "agg_bike_sliding": f"""SELECT window_start, window_start + {_MINUTES15} AS window_end, user_type, {_BIKE_WINDOW}, {_BIKE_DERIVED} FROM (SELECT time_bucket(INTERVAL '5 minutes', start_time_ts) - i * INTERVAL '5 minutes' AS window_start, user_type, count(*) AS rental_count, avg(duration_seconds) AS avg_duration_seconds,
        min(duration_seconds) AS min_duration_seconds, max(duration_seconds) AS max_duration_seconds, stddev(duration_seconds) AS stddev_duration, count(start_station_id) AS total_trips_started, avg(birth_year) AS avg_birth_year, count(*) FILTER (gender = 2) AS female_count, count(*) FILTER (gender = 1) AS male_count,
        count(*) FILTER (gender = 0) AS unknown_gender_count FROM bike_trips, (SELECT unnest([0, 1, 2]) AS i) GROUP BY ALL)""",
    "agg_taxi_window": f"SELECT window_start, window_start + {_MINUTES15} AS window_end, cab_type, ride_count, {_rs('total_revenue max_surge avg_price avg_distance avg_surge avg_temperature avg_feels_like_temp avg_humidity avg_wind_speed avg_precip_intensity')}, {_r('total_revenue / ride_count', 'revenue_per_ride')}, avg_surge > 1.5 AS high_surge_indicator FROM taxis15",
    "agg_weather_window": f"SELECT window_start, window_start + {_MINUTES15} AS window_end, observation_count, {_rs('avg_temperature_c min_temperature_c max_temperature_c avg_wind_speed_ms max_wind_speed_ms avg_visibility_m min_visibility_m avg_weather_score')}, good_weather_obs_count, bad_weather_obs_count, dominant_temp_bucket, dominant_wind_category, dominant_visibility_category, {_r('max_temperature_c - min_temperature_c', 'temperature_range_c')}, {_r('good_weather_obs_count / observation_count', 'good_weather_ratio')} FROM sky15",
    "agg_accident_window": f"SELECT window_start, window_start + {_MINUTES15} AS window_end, mode_type, accident_count, intersection_accidents, street_accidents, {_rs('avg_accident_lat avg_accident_long')}, {_r('intersection_accidents / accident_count', 'intersection_accident_ratio')} FROM accidents15",
    "agg_combined": f"SELECT {_C}, {_B}, {_r('avg_bike_duration_min')}, {_X}, {_rs('avg_taxi_price avg_taxi_surge avg_temperature_c avg_wind_speed_ms avg_weather_score good_weather_ratio')}, dominant_temp_bucket, dominant_wind_category, {_N}, {_r('bike_share_pct')} FROM combined",
    "agg_combined_weighted": f"SELECT window_start, {_r('w_bike', 'avg_bike_duration_min')}, {_r('w_price', 'avg_taxi_price')}, {_r('w_surge', 'avg_taxi_surge')} FROM combined",
    "agg_binned_temp": f"SELECT {_case(_T, '0:-5_to_0C 5:0_to_5C 10:5_to_10C 15:10_to_15C 20:15_to_20C 25:20_to_25C', '25_to_30C')} AS temp_bin, {_r(f'avg({_B})', 'avg_bike_rentals_in_temp_bin')}, {_r(f'avg({_X})', 'avg_taxi_rides_in_temp_bin')}, count(*) AS sample_count, {_r(f'avg({_N})', 'avg_total_usage_in_temp_bin')}, {_r(f'stddev({_B})', 'stddev_bike_rentals')}, 'by_temperature_bin' AS aggregation_type FROM combined WHERE {_T} IS NOT NULL GROUP BY 1",
    "agg_binned_wind": f"SELECT {_case(_W, '3:0_to_3ms 6:3_to_6ms 9:6_to_9ms 12:9_to_12ms', '12+ms')} AS wind_bin, {_r(f'avg({_B})', 'avg_bike_rentals_in_wind_bin')}, {_r(f'avg({_X})', 'avg_taxi_rides_in_wind_bin')}, count(*) AS sample_count, 'by_wind_bin' AS aggregation_type FROM combined WHERE {_W} IS NOT NULL GROUP BY 1",
    "agg_binned_score": f"SELECT {_case(_S, '30:poor_0-30 50:fair_30-50 70:good_50-70', 'excellent_70+')} AS weather_score_bin, {_r(f'avg({_B})', 'avg_bike_rentals_in_score_bin')}, {_r(f'avg({_X})', 'avg_taxi_rides_in_score_bin')}, count(*) AS sample_count, {_r(f'avg({_S})', 'avg_score_in_bin')}, 'by_weather_score_bin' AS aggregation_type FROM combined WHERE {_S} IS NOT NULL GROUP BY 1",
    "ana_weather_transport": f"SELECT {_C}, CAST({_flag(f'{_T} < 5')} AS INT) AS is_cold, CAST({_flag(f'{_T} > 25')} AS INT) AS is_hot, CAST({_MILD} AS INT) AS is_comfortable, CAST({_flag(f'{_W} > 10')} AS INT) AS is_windy, CAST({_flag(f'{_S} < 40')} AS INT) AS is_poor_weather, {_r(f'CASE WHEN {_N} > 0 THEN {_B} / {_N} * {_S} ELSE 0 END', 'bike_preference_score')}, {_r(f'CASE WHEN {_N} > 0 THEN {_X} / {_N} * (100 - {_S}) ELSE 0 END', 'taxi_preference_score')}, {_r(_EB, 'bike_weather_elasticity')}, {_r(_ET, 'taxi_weather_elasticity')}, {_r(f'100 * (1 + {_EB})', 'expected_bike_rentals')}, {_r(f'50 * (1 + {_ET})', 'expected_taxi_rides')}, {_r(f'{_B} - 100 * (1 + {_EB})', 'bike_demand_deviation')}, {_r(f'{_X} - 50 * (1 + {_ET})', 'taxi_demand_deviation')}, {_r(f'({_S} - 50) * 2', 'weather_transport_impact_score')} FROM combined",
    "ana_precip_impact": f"SELECT {_C}, CASE WHEN {_S} < 30 THEN 'likely_precipitating' WHEN {_S} < 50 THEN 'possibly_precipitating' ELSE 'dry' END AS precipitation_indicator, CAST({_WET} AS INT) AS precipitation_binary, {_r(f'{_B} / {_N} * 100', 'bike_mode_share_pct')}, {_r(f'{_X} / {_N} * 100', 'taxi_mode_share_pct')}, {_r(f'CASE WHEN {_WET} THEN (100 - {_S}) / 2 ELSE 0 END', 'precip_bike_impact_score')}, {_r(f'CASE WHEN {_WET} THEN (100 - {_S}) / 2 ELSE 0 END', 'precip_taxi_boost_score')}, {_WET} AND {_X} / {_N} * 100 > 60 AS weather_driven_mode_substitution FROM combined",
    "ana_temporal": f"SELECT {_C}, CAST({_HOUR} AS INT) AS hour_of_day, CAST({_DAY} AS INT) AS day_of_week, {_WEEKEND} AS is_weekend, {_RUSH} AS is_rush_hour, {_SEGMENT} AS temporal_segment, CASE {_SEGMENT} WHEN 'weekday_rush_hour' THEN 'low' WHEN 'weekday_off_peak' THEN 'medium' WHEN 'weekend_day' THEN 'high' ELSE 'very_high' END AS segment_weather_sensitivity, {_r(f'''CASE {_SEGMENT} WHEN 'weekday_rush_hour' THEN 0.25 WHEN 'weekday_off_peak' THEN 0.45 WHEN 'weekend_day' THEN 0.75 ELSE 0.6 END''', 'expected_temp_bike_correlation')}, {_case(_N, '50:very_low 150:low 300:moderate 500:high', 'very_high')} AS usage_intensity_category FROM combined",
    "ana_pearson_products": f"SELECT {_C}, {_r(f'{_B} * coalesce({_T}, 0)', 'bike_temp_product')}, {_r(f'{_B} * coalesce({_W}, 0)', 'bike_wind_product')}, {_r(f'{_B} * coalesce({_S}, 0)', 'bike_weather_score_product')}, {_r(f'{_X} * coalesce({_T}, 0)', 'taxi_temp_product')}, {_r(f'{_X} * coalesce({_W}, 0)', 'taxi_wind_product')}, CASE WHEN {_T} IS NULL THEN 'unknown' WHEN {_T} < 0 THEN 'strong_negative' WHEN {_T} BETWEEN 0 AND 10 THEN 'moderate_negative' WHEN {_T} BETWEEN 10 AND 20 THEN 'positive' WHEN {_T} > 30 THEN 'moderate_negative' ELSE 'positive' END AS bike_temp_correlation_strength, {_case(_W, '5:neutral 10:moderate_negative', 'strong_negative', 'unknown')} AS bike_wind_correlation_strength FROM combined",
    "ana_corr": "SELECT " + ", ".join(_r(f"corr({u}, {s})", f"r_{a}_{b}") for a, u in (("bike", _B), ("taxi", _X)) for b, s in (("temp", _T), ("wind", _W), ("score", _S))) + ", count(*) AS windows FROM combined",
    "ana_binned": f"SELECT {_C}, {_bin(_T, 5)} AS temp_bin_numeric, {_case(_T, _TEMP_RUNGS, 'above_30C', 'unknown')} AS temp_bin_label, {_bin(_W, 2)} AS wind_bin_numeric, {_case(_W, '2:calm_0-2ms 5:light_2-5ms 8:moderate_5-8ms 12:fresh_8-12ms', 'strong_12+ms', 'unknown')} AS wind_bin_label, {_case(_S, '20:very_poor_0-20 40:poor_20-40 60:moderate_40-60 80:good_60-80', 'excellent_80-100', 'unknown')} AS weather_score_bin, {_r(f'{_B} / nullif({_T}, 0)', 'bikes_per_degree')}, {_r(f'CASE WHEN {_S} > 0 THEN {_B} / {_S} END', 'bikes_per_weather_score_point')} FROM combined",
    "ana_multi": f"SELECT {_C}, {_r(_BN, 'bike_usage_normalized')}, {_r(f'{_X} / 50.0', 'taxi_usage_normalized')}, {_r(_WARM, 'temperature_normalized')}, {_r(_WN, 'wind_normalized')}, {_r(_SN, 'weather_score_normalized')}, {_r(f'{_T} * {_T}', 'temperature_squared')}, {_r(f'{_T} * {_W}', 'temp_wind_interaction')}, {_flag(f'{_T} BETWEEN 15 AND 25 AND {_W} < 8 AND {_S} > 70')} AS strong_positive_weather_for_bikes, {_flag(f'{_T} < 0 OR {_W} > 12 OR {_S} < 30')} AS strong_negative_weather_for_bikes, {_r(f'{_WARM} * 40 + (1 - {_WN}) * 30 + {_SN} * 30', 'predicted_bike_demand_index')}, {_r(f'{_BN} * 100', 'actual_bike_demand_index')}, {_r(f'{_BN} * 100 - ({_WARM} * 40 + (1 - {_WN}) * 30 + {_SN} * 30)', 'demand_prediction_error')} FROM combined",
    "ana_surge": "SELECT trip_no, is_raining, is_very_cold, is_very_hot, is_humid, is_surge, weather_driven_surge_score, surge_reason FROM surges",
    "ana_usage_summary": f"""SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, bike_count, {_r('avg_bike_duration')}, subscriber_count, customer_count, taxi_count, {_rs('avg_taxi_price total_taxi_revenue avg_surge')}, uber_count, lyft_count, bike_count + taxi_count AS total_transport_count, CAST({_HOUR} AS INT) AS hour_of_day, CAST({_DAY} AS INT) AS day_of_week,
        {_r('bike_count / (bike_count + taxi_count) * 100', 'bike_mode_share_pct')}, {_r('taxi_count / (bike_count + taxi_count) * 100', 'taxi_mode_share_pct')}, {_RUSH} AS is_peak_hour, {_WEEKEND} AS is_weekend FROM (SELECT window_start, coalesce(bc, 0) AS bike_count, avg_bike_duration, coalesce(sc, 0) AS subscriber_count, coalesce(cc, 0) AS customer_count, coalesce(tc, 0) AS taxi_count,
        avg_taxi_price, total_taxi_revenue, avg_surge, coalesce(uc, 0) AS uber_count, coalesce(lc, 0) AS lyft_count FROM (SELECT time_bucket(INTERVAL '1 hour', start_time_ts) AS window_start, count(*) AS bc, avg(duration_seconds) AS avg_bike_duration, count(*) FILTER (user_type = 'Subscriber') AS sc, count(*) FILTER (user_type = 'Customer') AS cc FROM bike_trips GROUP BY 1) b
        FULL JOIN (SELECT time_bucket(INTERVAL '1 hour', datetime_ts) AS window_start, count(*) AS tc, avg(price) AS avg_taxi_price, sum(price) AS total_taxi_revenue, avg(surge_multiplier) AS avg_surge, count(*) FILTER (cab_type = 'Uber') AS uc, count(*) FILTER (cab_type = 'Lyft') AS lc FROM taxi_rides GROUP BY 1) t USING (window_start))""",
    "ana_safety_risk": f"SELECT window_start, window_end, mode_type, accident_count, {_rs('avg_temp avg_wind avg_visibility avg_weather_score')}, bad_weather_obs, accident_count AS base_accident_risk, {_r('weather_risk_multiplier')}, {_r('accident_count * weather_risk_multiplier', 'safety_risk_index')}, {_r(_CAPPED, 'safety_risk_index_normalized')}, {_CATEGORY} AS risk_category, CASE mode_type WHEN 'bike' THEN 'cycling' WHEN 'ped' THEN 'pedestrian' WHEN 'mv' THEN 'vehicle' ELSE 'unknown' END AS high_risk_mode FROM risk",
    "ana_accident_weather": f"""SELECT window_start, window_start + {_MINUTES15} AS window_end, mode_type, accident_count, intersection_accidents, {_rs('avg_accident_lat avg_accident_long avg_temperature_c avg_wind_speed_ms avg_weather_score')}, {_B}, {_X}, {_N}, {_WET} AS has_precipitation, {_ICE} AS is_freezing, {_GALE} AS is_high_wind, {_r(_RATE, 'accident_rate_per_1000_trips')},
        {_POINTS} AS weather_accident_risk_score, {_case(_POINTS, '60:low 75:medium 90:high', 'critical')} AS weather_accident_risk_category, CASE WHEN mode_type = 'bike' AND ({_WET} OR {_GALE}) THEN 'high_vulnerability' WHEN mode_type = 'mv' AND {_ICE} THEN 'high_vulnerability' WHEN mode_type = 'ped' AND {_GALE} THEN 'medium_vulnerability' ELSE 'low_vulnerability' END AS mode_weather_vulnerability,
        CAST({_HOUR} AS INT) AS hour_of_day, {_RUSH} AS is_rush_hour, {_r(_TIMES, 'expected_accident_multiplier')}, 2.0::DOUBLE AS baseline_accident_rate, {_r(f'2.0 * {_TIMES} * ({_N} / 1000.0)', 'expected_accidents_in_weather')}, {_r(f'accident_count - 2.0 * {_TIMES} * ({_N} / 1000.0)', 'accident_deviation')}, {_flag(f'{_POINTS} >= 85')} OR {_flag(f'{_RATE} > 10')} AS should_send_safety_alert
        FROM accidents15 LEFT JOIN (SELECT * FROM combined) USING (window_start)""",
    "agg_overall_stats": f"SELECT {_stats('speed', _SPEED, 'mean median stddev variance min max skewness kurtosis p25 p75')}, {_stats('temp', 'temp_c', 'mean median stddev min max')}, {_stats('distance', 'distance_meters', 'mean median stddev')}, {_stats('duration', 'tripduration', 'mean median stddev')}, count(*) AS total_trips, {_SPREAD} FROM trips",
    "agg_stats_condition": _CONDITION,
    "agg_stats_temp": f"SELECT {_SHORT_TEMP} AS temp_bucket, {_stats('speed', _SPEED, 'mean median stddev min max')}, {_stats('distance', 'distance_meters', 'mean')}, {_stats('duration', 'tripduration', 'mean')}, {_r('avg(temp_c)', 'avg_temp_in_bucket')}, count(*) AS sample_size FROM trips GROUP BY 1",
    "agg_stats_precip": f"SELECT {_LEVEL} AS precip_level, {_stats('speed', _SPEED, 'mean median stddev')}, {_stats('distance', 'distance_meters', 'mean')}, {_stats('duration', 'tripduration', 'mean')}, {_stats('temp', 'temp_c', 'mean')}, {_r('avg(precip_daily_mm)', 'avg_precip_in_level')}, count(*) AS sample_size FROM trips GROUP BY 1",
    "sql_time_range": f"SELECT min(starttime) AS min_time, max(stoptime) AS max_time, count(*) AS total_trips FROM trips WHERE {_SPEED} > 0",
    "sql_trips_by_hour": f"SELECT CAST(hour(starttime) AS INT) AS hour_of_day, count(*) AS trip_count, ROUND(avg(tripduration) / 60, 1) AS avg_duration_min FROM trips WHERE {_SPEED} > 0 GROUP BY 1 ORDER BY 1",
    "sql_precip_impact": f"SELECT {_LEVEL} AS precip_level, count(*) AS trip_count, ROUND(avg({_SPEED}), 2) AS avg_speed, ROUND(avg(tripduration) / 60, 1) AS avg_duration_min FROM trips WHERE {_SPEED} > 0 AND {_SPEED} < 50 GROUP BY 1",
    "sql_temp_vs_speed": f"SELECT ROUND(temp_c, 0) AS temperature, ROUND(avg({_SPEED}), 2) AS avg_speed, count(*) AS trip_count, ROUND(avg(precip_daily_mm), 2) AS avg_precip FROM trips WHERE {_SPEED} > 0 AND {_SPEED} < 50 GROUP BY 1",
    "sql_speed_hist": f"SELECT CAST(floor({_SPEED} / 2) * 2 AS BIGINT) AS speed_bucket, count(*) AS trip_count FROM trips WHERE {_SPEED} > 0 AND {_SPEED} < 30 GROUP BY 1",
    "sql_distance_hist": "SELECT CAST(floor(distance_meters / 500) * 500 AS BIGINT) AS distance_bucket, count(*) AS trip_count, ROUND(avg(tripduration) / 60, 1) AS avg_duration_min FROM trips WHERE distance_meters > 0 AND distance_meters < 8000 GROUP BY 1",
    "sql_overall": f"SELECT ROUND(avg({_SPEED}), 2) AS mean_speed, ROUND(quantile_disc({_SPEED}, 0.5), 2) AS median_speed, ROUND(stddev({_SPEED}), 2) AS stddev_speed, ROUND(min({_SPEED}), 2) AS min_speed, ROUND(max({_SPEED}), 2) AS max_speed, ROUND(avg(temp_c), 2) AS mean_temp, ROUND(avg(distance_meters), 2) AS mean_distance, ROUND(avg(tripduration), 2) AS mean_duration, count(*) AS total_trips FROM trips",
    "sql_by_condition": f"SELECT weather_condition, ROUND(avg({_SPEED}), 2) AS mean_speed, ROUND(quantile_disc({_SPEED}, 0.5), 2) AS median_speed, ROUND(stddev({_SPEED}), 2) AS stddev_speed, ROUND(avg(distance_meters), 2) AS mean_distance, ROUND(avg(temp_c), 2) AS mean_temp, count(*) AS sample_size FROM trips GROUP BY 1",
    "sql_by_temperature": f"SELECT {_SHORT_TEMP} AS temp_bucket, ROUND(avg({_SPEED}), 2) AS mean_speed, ROUND(quantile_disc({_SPEED}, 0.5), 2) AS median_speed, ROUND(avg(distance_meters), 2) AS mean_distance, ROUND(avg(temp_c), 2) AS avg_temp, count(*) AS sample_size FROM trips GROUP BY 1",
    "sql_taxi_by_hour": "SELECT CAST(hour(datetime_ts) AS INT) AS hour_of_day, count(*) AS trip_count FROM taxi_rides GROUP BY 1 ORDER BY 1 LIMIT 24",
    "sql_doc_demand": f"SELECT window_start, {_r(_T)}, {_B}, {_r(_S)} FROM combined WHERE {_T} IS NOT NULL",
    "sql_doc_risk": f"SELECT window_start, mode_type, accident_count, {_r(_S)}, {_r(_CAPPED, 'safety_risk_index_normalized')}, {_CATEGORY} AS risk_category FROM risk WHERE {_CATEGORY} IN ('high', 'very_high')",
    "sql_doc_surge": f"SELECT surge_reason, count(*) AS ride_count, {_r('avg(surge_multiplier)', 'avg_surge')}, {_r('avg(temperature)', 'avg_temp')}, {_r('avg(precip_intensity)', 'avg_rain')} FROM surges WHERE is_surge = 1 GROUP BY 1",
    "agg_basic": f"SELECT count(*) AS rides, {_r('avg(distance)', 'avg_distance')}, {_r('avg(price)', 'avg_price')}, {_r('avg(surge_multiplier)', 'avg_surge')}, {_r('sum(price)', 'revenue')} FROM taxi_rides",
    "agg_by_hour": f"SELECT CAST(hour(datetime_ts) AS INT) AS hour, count(*) AS rides, {_r('avg(price)', 'avg_price')} FROM taxi_rides GROUP BY 1",
    "agg_by_day": "SELECT CAST(day(datetime_ts) AS INT) AS day, count(*) AS rides FROM taxi_rides GROUP BY 1",
    "agg_by_key": "SELECT start_station_id, count(*) AS trips FROM bike_trips GROUP BY 1",
    "agg_corr": f"SELECT {_r('corr(distance, price)', 'r')} FROM taxi_rides",
    "agg_cab_breakdown": "SELECT cab_type, count(*) AS rides FROM taxi_rides GROUP BY 1",
    "agg_weighted_mean": f"SELECT {_r('sum(b * n) / sum(n)', 'weighted_mean')} FROM (SELECT floor(distance_meters / 500) * 500 AS b, count(*) AS n FROM trips WHERE distance_meters > 0 AND distance_meters < 8000 GROUP BY 1)",
    "agg_live_bike": f"SELECT time_bucket(INTERVAL '1 hour', start_time_ts) AS window_start, time_bucket(INTERVAL '1 hour', start_time_ts) + INTERVAL '1 hour' AS window_end, count(*) AS trips, {_r('avg(duration_seconds) / 60', 'avg_minutes')}, count(DISTINCT start_station_id) AS stations FROM bike_trips GROUP BY 1",
    "agg_live_taxi": "SELECT time_bucket(INTERVAL '1 hour', datetime_ts) AS window_start, time_bucket(INTERVAL '1 hour', datetime_ts) + INTERVAL '1 hour' AS window_end, cab_type, count(*) AS rides FROM taxi_rides GROUP BY ALL",
    "agg_live_weather": f"SELECT time_bucket(INTERVAL '1 hour', datetime_ts) AS window_start, time_bucket(INTERVAL '1 hour', datetime_ts) + INTERVAL '1 hour' AS window_end, {_r('avg(temp_c)', 'avg_temp')}, {_r('arg_max(temp_c, (datetime_ts, obs_no)) FILTER (temp_c IS NOT NULL)', 'latest_temp')}, {_r('avg(precip_daily_mm)', 'avg_precip')} FROM sky GROUP BY 1",
    "win_ffill": f"SELECT obs_no, station, {_r('last_value(CASE WHEN precip_daily_mm > 0 THEN precip_daily_mm END IGNORE NULLS) OVER (PARTITION BY station ORDER BY datetime_ts, obs_no)', 'precip_filled')} FROM weather_raw",
    "srt_argmax": "SELECT (SELECT arg_max(h, (n, -h)) FROM (SELECT CAST(hour(datetime_ts) AS INT) AS h, count(*) AS n FROM taxi_rides GROUP BY 1)) AS busiest_hour, (SELECT max(n) FROM (SELECT count(*) AS n FROM taxi_rides GROUP BY hour(datetime_ts))) AS rides_in_hour, (SELECT arg_max(d, (n, -d)) FROM (SELECT CAST(day(datetime_ts) AS INT) AS d, count(*) AS n FROM taxi_rides GROUP BY 1)) AS busiest_day, (SELECT max(n) FROM (SELECT count(*) AS n FROM taxi_rides GROUP BY day(datetime_ts))) AS rides_in_day",
    "srt_top1": f"SELECT trip_no, {_r('price')} FROM taxi_rides ORDER BY taxi_rides.price DESC, trip_no LIMIT 1",
    "src_topic_sample": f"SELECT event_id, event_type, {_r('value')} FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20)",
    "src_parquet_range": "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04'",
    "src_replay_halfopen": "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-04'",
    "set_dedupe_offsets": "SELECT event_id % 4 AS partition, event_id // 8 AS \"offset\", min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "set_union_by_name": f"SELECT trip_no, {_r('price')}, user_type FROM (SELECT trip_no, price, NULL AS user_type FROM taxi_rides UNION ALL SELECT trip_no, NULL, user_type FROM bike_trips)",
    "agg_topic_stats": "SELECT count(*) AS topics, count(*) FILTER (event_type LIKE 's%') AS internal, CAST(sum(n) AS BIGINT) AS messages FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)",
}

ORACLE_SQL = {name: _with(body) for name, body in _BODIES.items()}
# Statistics that are merged from stored cells are held against the statements over all rows.
for _merged, _plain in (("overall_merged", "overall_stats"), ("condition_merged", "stats_condition"), ("temperature_merged", "stats_temp"), ("precipitation_merged", "stats_precip")):
    ORACLE_SQL[f"agg_{_merged}"] = ORACLE_SQL[f"agg_{_plain}"]
