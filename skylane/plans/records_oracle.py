"""DuckDB SQL of the record queries, written without the operators' code."""

from __future__ import annotations

from skylane.plans.oracle import CTES, _case, _r, _rs, _with
from skylane.sources.adapters import adapter_sql

CTES |= {name: adapter_sql(name) for name in ("bike_records", "taxi_records", "weather_records", "weather_stored", "accident_records")}

_CALENDAR = "CAST(year({t}) AS INT) AS year, CAST(month({t}) AS INT) AS month, strftime({t}, '%Y-%m-%d') AS date, CAST(hour({t}) AS INT) AS hour"


def _at(text: str) -> str:
    return f"TRY_CAST(replace({text}, 'T', ' ') AS TIMESTAMP)"


CTES["slim_trips"] = f"""SELECT {_at('starttime')} AS starttime, {_at('stoptime')} AS stoptime, tripduration, start_station_latitude, start_station_longitude, end_station_latitude, end_station_longitude FROM bike_records"""
CTES["slim_sky"] = f"SELECT {_at('observation_date')} AS weather_ts, dry_bulb_temperature_celsius AS temp_c, precip_daily_mm FROM weather_records"
CTES["slim_named"] = "SELECT *, row_number() OVER () AS trip FROM slim_trips"
CTES["slim_pairs"] = """SELECT b.*, w.*, row_number() OVER (PARTITION BY trip ORDER BY abs(epoch_us(starttime) - epoch_us(weather_ts)), weather_ts, temp_c NULLS FIRST, precip_daily_mm NULLS FIRST) AS rn
    FROM slim_named b JOIN slim_sky w ON weather_ts BETWEEN starttime - INTERVAL '1 hour' AND starttime + INTERVAL '1 hour'"""
CTES["slim_metered"] = """SELECT *, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS distance_meters FROM (SELECT *,
    power(sin((radians(end_station_latitude) - radians(start_station_latitude)) / 2), 2) + cos(radians(start_station_latitude)) * cos(radians(end_station_latitude))
    * power(sin((radians(end_station_longitude) - radians(start_station_longitude)) / 2), 2) AS h FROM slim_pairs WHERE rn = 1)"""
CTES["slim_speedy"] = "SELECT *, CASE WHEN tripduration > 0 THEN distance_meters / tripduration * 3.6 ELSE 0 END AS average_speed_kmh FROM slim_metered"
_LEVEL = "CASE WHEN precip_daily_mm = 0 THEN 'None' WHEN precip_daily_mm < 1 THEN 'Light' WHEN precip_daily_mm < 5 THEN 'Moderate' ELSE 'Heavy' END"
_COORDINATES = _rs("start_station_latitude start_station_longitude end_station_latitude end_station_longitude")

_BODIES = {
    "prj_bike": f"SELECT trip_no, CAST(trunc(tripduration) AS INT) AS duration_seconds, usertype AS user_type, a AS start_time_ts, b AS stop_time_ts, {_CALENDAR.format(t='a')} FROM (SELECT *, {_at('starttime')} AS a, {_at('stoptime')} AS b FROM bike_records)",
    "prj_taxi": f"SELECT id AS trip_id, source AS pickup_location, destination AS dropoff_location, a AS datetime_ts, {_CALENDAR.format(t='a')} FROM (SELECT *, {_at('datetime')} AS a FROM taxi_records)",
    "prj_weather": f"""SELECT obs_no, a AS datetime_ts, {_r('dry_bulb_temperature_celsius', 'temp_c')}, {_r("CASE WHEN contains(wind_observation, ',') THEN TRY_CAST(string_split(wind_observation, ',')[4] AS DOUBLE) / 10 ELSE TRY_CAST(wind_observation AS DOUBLE) END", 'wind_speed_ms')},
        {_r("TRY_CAST(string_split(visibility_observation, ',')[1] AS DOUBLE)", 'visibility_m')}, CAST(month(a) AS INT) AS month, strftime(a, '%Y-%m-%d') AS date, CAST(hour(a) AS INT) AS hour FROM (SELECT *, {_at('observation_date')} AS a FROM weather_records)""",
    "prj_accident": f"SELECT accident_no, mode_type, TRY_CAST(x_cord AS DOUBLE) AS x_cord, TRY_CAST(y_cord AS DOUBLE) AS y_cord, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(long AS DOUBLE) AS long, a AS dispatch_timestamp, CAST(year(a) AS INT) AS year, CAST(hour(a) AS INT) AS hour FROM (SELECT *, {_at('dispatch_ts')} AS a FROM accident_records)",
    "prj_bike_min": f"SELECT starttime, stoptime, {_r('tripduration')}, {_COORDINATES} FROM slim_trips",
    "prj_weather_min": f"SELECT weather_ts, {_r('temp_c')}, {_r('precip_daily_mm')} FROM slim_sky",
    "prj_rec_bike": "SELECT trip_no, coalesce(usertype, 'Unknown') AS usertype, coalesce(TRY_CAST(birth_year AS INT), 0) AS birth_year, coalesce(TRY_CAST(gender AS INT), 0) AS gender FROM bike_records",
    "prj_rec_taxi": f"SELECT id, coalesce(source, 'Unknown') AS source, cab_type, {_r('coalesce(TRY_CAST(price AS DOUBLE), 0)', 'price')}, {_r('(temperature - 32) * 5 / 9', 'temperature')} FROM taxi_records",
    "prj_rec_weather": f"""SELECT obs_no, {_r("CASE WHEN TMP = '+9999,9' THEN 0 ELSE coalesce(TRY_CAST(string_split(TMP, ',')[1] AS INT) / 10.0, 0) END", 'dry_bulb_temperature_celsius')}, {_r("coalesce(TRY_CAST(string_split(DEW, ',')[1] AS INT) / 10.0, 0)", 'dew_point_temperature_celsius')},
        coalesce(WND, '') AS wind_observation, coalesce(CIG, '') AS sky_condition_observation, coalesce(VIS, '') AS visibility_observation, {_r('coalesce(TRY_CAST(PRECIP_DAILY_MM AS DOUBLE), 0) / 10', 'precip_daily_mm')} FROM weather_stored""",
    "prj_daily_precip": """SELECT STATION AS station, DATE AS at, max(f) AS filled FROM (SELECT STATION, DATE, last_value(CASE WHEN AA1 LIKE '24,%' THEN TRY_CAST(string_split(AA1, ',')[2] AS INT) END IGNORE NULLS) OVER (PARTITION BY STATION ORDER BY DATE) AS f FROM weather_stored) GROUP BY 1, 2""",
    "prj_null_coalesce": f"""SELECT CAST(trip_no AS VARCHAR) AS bikeid, {_r('CASE WHEN trip_no % 2 = 0 AND trip_no % 3 > 0 THEN trunc(tripduration) ELSE 0 END', 'tripduration')}, start_station_id AS station, CASE WHEN trip_no % 2 = 1 THEN 42.5::DOUBLE END AS lat, usertype FROM bike_records""",
    "prj_schema_filter": "SELECT dispatch_ts, mode_type, x_cord, y_cord, lat, long FROM accident_records",
    "prj_pad_missing": f"SELECT NULL::VARCHAR AS starttime, NULL::VARCHAR AS stoptime, CAST(obs_no AS VARCHAR) AS weather_ts, NULL::DOUBLE AS temp_c, {_r('TRY_CAST(PRECIP_DAILY_MM AS DOUBLE)', 'precip_daily_mm')}, NULL::DOUBLE AS tripduration, NULL::DOUBLE AS distance_meters, NULL::DOUBLE AS average_speed_kmh FROM weather_stored",
    "prj_rename_norm": "SELECT id AS ride_id, cab_type FROM taxi_records",
    "prj_ts_normalise": f"SELECT trip_no, CASE WHEN trip_no % 3 = 0 THEN {_at('starttime')} WHEN trip_no % 3 = 1 THEN {_at('starttime')} + INTERVAL '250 milliseconds' END AS at FROM bike_records",
    "prj_legacy_nested": "SELECT strftime(start_time_ts, '%Y-%m-%d-%H') AS key, CAST(trip_no AS VARCHAR) AS n, strftime(start_time_ts, '%Y-%m-%dT%H:%M:%S') AS at, 'bikes' AS source FROM bike_trips",
    "flt_nan": f"SELECT event_type, {_r('avg(value) FILTER (user_id % 7 <> 0)', 'avg_value')}, count(value) FILTER (user_id % 7 <> 0) AS n_values, count(*) AS n_rows FROM events GROUP BY 1",
    "src_recent_grid": "SELECT event_id AS \"offset\", user_id, event_type FROM events ORDER BY event_id DESC LIMIT 15",
    "src_recent_grid_keys": "SELECT event_id AS \"offset\", event_id % 5 AS k, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, CASE WHEN event_id % 2 = 0 THEN user_id END AS number FROM events ORDER BY event_id DESC LIMIT 30",
    "src_framed_ids": """SELECT CAST(CASE trip_no % 3 WHEN 0 THEN 258 WHEN 1 THEN 259 ELSE 7 END AS INT) AS schema_id, trip_no, CASE WHEN trip_no % 3 < 2 THEN CAST(gender AS VARCHAR) END AS gender,
        CASE WHEN trip_no % 3 = 1 THEN duration_seconds END AS duration_seconds, CASE WHEN trip_no % 3 = 2 THEN 'unknown schema' END AS problem FROM bike_trips""",
    "src_table_preview": f"SELECT trip_no, cab_type, {_r('price')} FROM taxi_rides ORDER BY taxi_rides.trip_no LIMIT 25",
    "snk_kafka_json": "SELECT CAST(trip_no AS VARCHAR) AS key, '{\"trip_no\":' || trip_no || ',\"user_type\":\"' || user_type || '\",\"duration_seconds\":' || duration_seconds || '}' AS value FROM bike_trips",
    "snk_framed": "SELECT CAST(258 AS INT) AS schema_id, '0000000102' AS frame, '{\"trip_no\":' || trip_no || ',\"user_type\":\"' || user_type || '\"}' AS body FROM bike_trips",
    "src_framed": "SELECT trip_no, user_type FROM bike_trips",
    "agg_live_count": "SELECT window_start, n FROM (SELECT date_trunc('hour', t) AS window_start, count(*) AS n FROM (SELECT event_id // 2 AS o, max(ts) AS t FROM events GROUP BY 1) GROUP BY 1) ORDER BY window_start DESC LIMIT 24",
    "st_session": """SELECT min(start_time_ts) AS window_start, max(start_time_ts) + INTERVAL '1 hour' AS window_end, start_station_id, count(*) AS n FROM (
        SELECT *, sum(begins) OVER (PARTITION BY start_station_id ORDER BY start_time_ts, trip_no) AS s FROM (
          SELECT *, CAST(coalesce(start_time_ts - lag(start_time_ts) OVER (PARTITION BY start_station_id ORDER BY start_time_ts, trip_no) > INTERVAL '1 hour', true) AS INT) AS begins FROM bike_trips))
        GROUP BY start_station_id, s""",
    "src_catalog_table": "SELECT 'skylane_catalogued' AS name, true AS temporary",
    "sql_free_form": f"SELECT cab_type, count(*) AS rides, {_r('max(price)', 'top_price')} FROM taxi_rides GROUP BY 1",
    "job_distance": f"SELECT starttime, weather_ts, {_rs('temp_c precip_daily_mm tripduration distance_meters average_speed_kmh')} FROM slim_speedy",
    "job_statistics": f"SELECT {_LEVEL} AS precip_level, {_r('avg(average_speed_kmh)', 'mean_speed')}, {_r('avg(distance_meters)', 'mean_distance')}, count(*) AS sample_size FROM slim_speedy GROUP BY 1",
}

ORACLE_SQL = {name: _with(body) for name, body in _BODIES.items()}
