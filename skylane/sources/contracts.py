"""Stream contracts: the fields of each topic, as Spark schemas and as Avro records."""

from __future__ import annotations

import json

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType()}

#: Topic: fields with their types. The records on the wire have this order.
FIELDS: dict[str, list[tuple[str, str]]] = {
    "bike-data": [
        ("tripduration", "double"),
        ("starttime", "string"),
        ("stoptime", "string"),
        ("start_station_id", "string"),
        ("start_station_name", "string"),
        ("start_station_latitude", "double"),
        ("start_station_longitude", "double"),
        ("end_station_id", "string"),
        ("end_station_name", "string"),
        ("end_station_latitude", "double"),
        ("end_station_longitude", "double"),
        ("usertype", "string"),
        ("birth_year", "int"),
        ("gender", "int"),
    ],
    "taxi-data": [
        ("id", "string"),
        ("timestamp", "string"),
        ("hour", "int"),
        ("day", "int"),
        ("month", "int"),
        ("datetime", "string"),
        ("timezone", "string"),
        ("source", "string"),
        ("destination", "string"),
        ("cab_type", "string"),
        ("product_id", "string"),
        ("price", "double"),
        ("distance", "double"),
        ("surge_multiplier", "double"),
        ("temperature", "double"),
        ("apparent_temperature", "double"),
        ("humidity", "double"),
        ("wind_speed", "double"),
        ("precip_intensity", "double"),
    ],
    "weather-data": [
        ("station_id", "long"),
        ("observation_date", "string"),
        ("source_code", "int"),
        ("latitude", "double"),
        ("longitude", "double"),
        ("elevation_meters", "double"),
        ("station_name", "string"),
        ("report_type", "string"),
        ("call_sign", "string"),
        ("quality_control", "string"),
        ("wind_observation", "string"),
        ("sky_condition_observation", "string"),
        ("visibility_observation", "string"),
        ("dry_bulb_temperature_celsius", "double"),
        ("dew_point_temperature_celsius", "double"),
        ("sea_level_pressure", "string"),
        ("precip_daily_mm", "double"),
    ],
    "accident-data": [
        ("dispatch_ts", "string"),
        ("mode_type", "string"),
        ("location_type", "string"),
        ("street", "string"),
        ("xstreet1", "string"),
        ("xstreet2", "string"),
        ("x_cord", "double"),
        ("y_cord", "double"),
        ("lat", "double"),
        ("long", "double"),
    ],
    "bike-weather-aggregate": [
        ("starttime", "string"),
        ("stoptime", "string"),
        ("weather_ts", "string"),
        ("temp_c", "double"),
        ("precip_daily_mm", "double"),
        ("tripduration", "double"),
        ("start_station_latitude", "double"),
        ("start_station_longitude", "double"),
        ("end_station_latitude", "double"),
        ("end_station_longitude", "double"),
    ],
    "bike-weather-distance": [
        ("starttime", "string"),
        ("stoptime", "string"),
        ("weather_ts", "string"),
        ("temp_c", "double"),
        ("precip_daily_mm", "double"),
        ("tripduration", "double"),
        ("distance_meters", "double"),
        ("average_speed_kmh", "double"),
    ],
    "weather-transport-statistics-overall": [
        ("mean_speed", "double"),
        ("median_speed", "double"),
        ("stddev_speed", "double"),
        ("variance_speed", "double"),
        ("min_speed", "double"),
        ("max_speed", "double"),
        ("range_speed", "double"),
        ("skewness_speed", "double"),
        ("kurtosis_speed", "double"),
        ("p25_speed", "double"),
        ("p75_speed", "double"),
        ("iqr_speed", "double"),
        ("cv_speed", "double"),
        ("mean_temp", "double"),
        ("median_temp", "double"),
        ("stddev_temp", "double"),
        ("min_temp", "double"),
        ("max_temp", "double"),
        ("mean_distance", "double"),
        ("median_distance", "double"),
        ("stddev_distance", "double"),
        ("mean_duration", "double"),
        ("median_duration", "double"),
        ("stddev_duration", "double"),
        ("total_trips", "long"),
    ],
    "weather-transport-statistics-by-condition": [
        ("weather_condition", "string"),
        ("mean_speed", "double"),
        ("median_speed", "double"),
        ("stddev_speed", "double"),
        ("min_speed", "double"),
        ("max_speed", "double"),
        ("range_speed", "double"),
        ("p25_speed", "double"),
        ("p75_speed", "double"),
        ("iqr_speed", "double"),
        ("cv_speed", "double"),
        ("mean_temp", "double"),
        ("stddev_temp", "double"),
        ("min_temp", "double"),
        ("max_temp", "double"),
        ("mean_distance", "double"),
        ("stddev_distance", "double"),
        ("mean_duration", "double"),
        ("stddev_duration", "double"),
        ("mean_precip", "double"),
        ("max_precip", "double"),
        ("sample_size", "long"),
    ],
    "weather-transport-statistics-by-temperature": [
        ("temp_bucket", "string"),
        ("mean_speed", "double"),
        ("median_speed", "double"),
        ("stddev_speed", "double"),
        ("min_speed", "double"),
        ("max_speed", "double"),
        ("mean_distance", "double"),
        ("mean_duration", "double"),
        ("avg_temp_in_bucket", "double"),
        ("sample_size", "long"),
    ],
    "weather-transport-statistics-by-precipitation": [
        ("precip_level", "string"),
        ("mean_speed", "double"),
        ("median_speed", "double"),
        ("stddev_speed", "double"),
        ("mean_distance", "double"),
        ("mean_duration", "double"),
        ("avg_precip_in_level", "double"),
        ("mean_temp", "double"),
        ("sample_size", "long"),
    ],
}
TOPICS = tuple(FIELDS)


def schema(topic: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in FIELDS[topic]])


def avro_schema(topic: str) -> str:
    fields = [{"name": n, "type": k} for n, k in FIELDS[topic]]
    return json.dumps({"type": "record", "name": topic.replace("-", "_"), "fields": fields})
