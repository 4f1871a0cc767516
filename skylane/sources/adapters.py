"""Trips, rides, weather and accidents read from the generic ``events`` table.

The expressions are plain SQL that Spark and DuckDB read alike; the query oracles use the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"

#: Time to the second as text.
SECONDS = "substr(CAST(ts AS STRING), 1, 19)"

#: Table: event types, then name and expression of each column.
ADAPTERS: dict[str, tuple[str, dict[str, str]]] = {
    "bike_trips": (
        "event_type IN ('view', 'click')",
        {
            "trip_no": "event_id",
            "start_time_ts": "ts",
            "duration_seconds": "CAST(FLOOR(60 + value * 20) AS INT)",
            "start_station_id": "CAST(user_id % 20 AS STRING)",
            "end_station_id": f"CAST((user_id + {K}) % 20 AS STRING)",
            "start_station_latitude": "CAST(42.30 + 0.004 * (user_id % 20) AS DOUBLE)",
            "start_station_longitude": "CAST(-71.12 + 0.005 * (user_id % 20) AS DOUBLE)",
            "end_station_latitude": f"CAST(42.30 + 0.004 * ((user_id + {K}) % 20) AS DOUBLE)",
            "end_station_longitude": f"CAST(-71.12 + 0.005 * ((user_id + {K}) % 20) AS DOUBLE)",
            "user_type": "CASE WHEN event_type = 'view' THEN 'Subscriber' ELSE 'Customer' END",
            "birth_year": "CAST(1950 + user_id % 50 AS INT)",
            "gender": "CAST(user_id % 3 AS INT)",
        },
    ),
    "taxi_rides": (
        "event_type = 'purchase'",
        {
            "trip_no": "event_id",
            "datetime_ts": "ts",
            "cab_type": "CASE WHEN user_id % 2 = 0 THEN 'Uber' ELSE 'Lyft' END",
            "price": "value",
            "distance": f"CAST({K} * 0.1 AS DOUBLE)",
            "surge_multiplier": f"CAST(1.0 + ({K} % 5) * 0.25 AS DOUBLE)",
            "temperature": f"CAST({K} % 50 - 12 AS DOUBLE)",
            "apparent_temperature": f"CAST({K} % 50 - 14 AS DOUBLE)",
            "humidity": f"CAST({K} * 0.01 AS DOUBLE)",
            "wind_speed": f"CAST({K} % 17 AS DOUBLE)",
            "precip_intensity": f"CAST(CASE WHEN {K} % 4 = 0 THEN {K} * 0.005 ELSE 0.0 END AS DOUBLE)",
        },
    ),
    "weather_raw": (
        "event_type = 'signup'",
        {
            "obs_no": "event_id",
            "datetime_ts": "ts",
            "station": "CAST(user_id % 3 AS STRING)",
            "temperature": f"CASE WHEN user_id % 10 = 0 THEN '' ELSE concat(CASE WHEN {K} < 30 THEN '-' ELSE '+' END, lpad(CAST(abs({K} * 5 - 150) AS STRING), 4, '0'), ',1') END",
            "wind": f"CASE WHEN user_id % 11 = 0 THEN '' ELSE concat('160,1,N,', lpad(CAST(({K} * 7) % 200 AS STRING), 4, '0'), ',1') END",
            "visibility": f"CASE WHEN user_id % 13 = 0 THEN '999' ELSE concat(lpad(CAST({K} * 250 AS STRING), 6, '0'), ',1,9,9') END",
            "precip_daily_mm": f"CAST(CASE WHEN {K} % 3 = 0 THEN 0.0 ELSE ({K} % 20) * 0.5 END AS DOUBLE)",
        },
    ),
    "accidents": (
        "event_type = 'error'",
        {
            "accident_no": "event_id",
            "dispatch_timestamp": "ts",
            "mode_type": "CASE WHEN user_id % 3 = 0 THEN 'mv' WHEN user_id % 3 = 1 THEN 'bike' ELSE 'ped' END",
            "location_type": f"CASE WHEN {K} % 3 = 0 THEN 'Intersection' WHEN {K} % 3 = 1 THEN 'Street' ELSE 'Other' END",
            "lat": "CAST(42.30 + 0.002 * (user_id % 50) AS DOUBLE)",
            "long": "CAST(-71.10 + 0.002 * (user_id % 50) AS DOUBLE)",
        },
    ),
    # Raw records of the stream contracts and of stored files, as text where the contract has text.
    "bike_records": (
        "event_type IN ('view', 'click')",
        {
            "trip_no": "event_id",
            "tripduration": "CAST(60 + value * 20 AS DOUBLE)",
            "starttime": f"CASE WHEN user_id % 2 = 0 THEN {SECONDS} ELSE replace({SECONDS}, ' ', 'T') END",
            "stoptime": f"CASE WHEN user_id % 7 = 0 THEN 'none' ELSE {SECONDS} END",
            "start_station_id": "CAST(user_id % 20 AS STRING)",
            "start_station_latitude": "CAST(42.30 + 0.004 * (user_id % 20) AS DOUBLE)",
            "start_station_longitude": "CAST(-71.12 + 0.005 * (user_id % 20) AS DOUBLE)",
            "end_station_latitude": f"CAST(42.30 + 0.004 * ((user_id + {K}) % 20) AS DOUBLE)",
            "end_station_longitude": f"CAST(-71.12 + 0.005 * ((user_id + {K}) % 20) AS DOUBLE)",
            "usertype": "CASE WHEN user_id % 5 = 0 THEN NULL WHEN event_type = 'view' THEN 'Subscriber' ELSE 'Customer' END",
            "birth_year": "CASE WHEN user_id % 6 = 0 THEN '' ELSE CAST(1950 + user_id % 50 AS STRING) END",
            "gender": "CAST(user_id % 3 AS STRING)",
        },
    ),
    "taxi_records": (
        "event_type = 'purchase'",
        {
            "id": "CAST(event_id AS STRING)",
            "hour": "CAST(99 AS INT)",
            "day": "CAST(99 AS INT)",
            "month": "CAST(99 AS INT)",
            "datetime": SECONDS,
            "source": "CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'North' END",
            "destination": "'South'",
            "cab_type": "CASE WHEN user_id % 2 = 0 THEN 'Uber' ELSE 'Lyft' END",
            "price": f"CASE WHEN user_id % 9 = 0 THEN 'NA' ELSE CAST({K} AS STRING) END",
            "temperature": f"CAST({K} % 50 - 12 AS DOUBLE)",
        },
    ),
    "weather_records": (
        "event_type = 'signup'",
        {
            "obs_no": "event_id",
            "station_id": "user_id % 3",
            "observation_date": f"replace({SECONDS}, ' ', 'T')",
            "dry_bulb_temperature_celsius": f"CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST({K} * 0.5 - 15 AS DOUBLE) END",
            "wind_observation": f"CASE WHEN user_id % 11 = 0 THEN '' ELSE concat('160,1,N,', lpad(CAST(({K} * 7) % 200 AS STRING), 4, '0'), ',1') END",
            "visibility_observation": f"CASE WHEN user_id % 13 = 0 THEN '999' ELSE concat(lpad(CAST({K} * 250 AS STRING), 6, '0'), ',1,9,9') END",
            "precip_daily_mm": f"CAST(CASE WHEN {K} % 3 = 0 THEN 0.0 ELSE ({K} % 20) * 0.5 END AS DOUBLE)",
        },
    ),
    "weather_stored": (
        "event_type = 'signup'",
        {
            "obs_no": "event_id",
            "TMP": f"CASE WHEN user_id % 10 = 0 THEN '+9999,9' ELSE concat('+', lpad(CAST({K} * 5 AS STRING), 4, '0'), ',1') END",
            "DEW": f"CASE WHEN user_id % 4 = 0 THEN 'none' ELSE concat('-', lpad(CAST({K} AS STRING), 4, '0'), ',1') END",
            "WND": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE '160,1' END",
            "CIG": "CASE WHEN user_id % 6 = 0 THEN NULL ELSE '22000,5' END",
            "VIS": "CASE WHEN user_id % 7 = 0 THEN NULL ELSE '016000,1' END",
            "AA1": f"CASE WHEN user_id % 4 = 0 THEN concat('24,', lpad(CAST({K} AS STRING), 4, '0'), ',9') WHEN user_id % 4 = 1 THEN '06,0001' ELSE NULL END",
            "STATION": "CAST(user_id % 3 AS STRING)",
            "DATE": "ts",
            "PRECIP_DAILY_MM": f"CASE WHEN user_id % 8 = 0 THEN 'x' ELSE CAST({K} AS STRING) END",
        },
    ),
    "accident_records": (
        "event_type = 'error'",
        {
            "accident_no": "event_id",
            "dispatch_ts": f"CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE {SECONDS} END",
            "mode_type": "CASE WHEN user_id % 3 = 0 THEN 'mv' ELSE 'bike' END",
            "x_cord": f"CASE WHEN user_id % 5 = 0 THEN 'x' ELSE CAST({K} AS STRING) END",
            "y_cord": "NULL",
            "lat": "CAST(40 + user_id % 5 AS STRING)",
            "long": "CAST(-70 - user_id % 5 AS STRING)",
        },
    ),
}


def adapt(events: DataFrame, table: str, zoned: bool = False) -> DataFrame:
    """One of the adapter tables over ``events``. ``zoned`` casts the time to TIMESTAMP, which watermarks need."""
    where, columns = ADAPTERS[table]
    events = events.withColumn("ts", events["ts"].cast("timestamp")) if zoned else events
    return events.where(where).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def adapter_sql(table: str) -> str:
    where, columns = ADAPTERS[table]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM events WHERE {where}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return adapt(spark.read.parquet(f"{sf_dir}/events.parquet"), table)
