"""Queries of the record projections, wire format and stream helpers on batch frames: operator by operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.functions import geo
from skylane.operators import panels, projections, windows
from skylane.plans.queries import QUERIES, Tables, _query
from skylane.sources import contracts, files
from skylane.streaming import jobs, sinks, wire

__all__ = ["QUERIES"]


def _plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the stored tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@_query
def prj_bike(t: Tables):
    out = projections.parse_bikes(t("bike_records"), watermark=None)
    return _plain_times(out.select("trip_no", "duration_seconds", "user_type", "start_time_ts", "stop_time_ts", "year", "month", "date", "hour"))


@_query
def prj_taxi(t: Tables):
    out = projections.parse_taxis(t("taxi_records"), watermark=None)
    return _plain_times(out.select("trip_id", "pickup_location", "dropoff_location", "datetime_ts", "year", "month", "date", "hour"))


@_query
def prj_weather(t: Tables):
    raw = t("weather_records").withColumn("dry_bulb_temperature_celsius", F.col("dry_bulb_temperature_celsius").cast("string"))
    out = projections.parse_weather(raw, watermark=None)
    return _plain_times(out.select("obs_no", "datetime_ts", "temp_c", "wind_speed_ms", "visibility_m", "month", "date", "hour"))


@_query
def prj_accident(t: Tables):
    out = projections.parse_accidents(t("accident_records"), watermark=None)
    return _plain_times(out.select("accident_no", "mode_type", "x_cord", "y_cord", "lat", "long", "dispatch_timestamp", "year", "hour"))


@_query
def prj_bike_min(t: Tables):
    return _plain_times(projections.slim_bikes(t("bike_records"), watermark=None))


@_query
def prj_weather_min(t: Tables):
    return _plain_times(projections.slim_weather(t("weather_records"), watermark=None))


@_query
def prj_rec_bike(t: Tables):
    return projections.record_bikes(t("bike_records")).select("trip_no", "usertype", "birth_year", "gender")


@_query
def prj_rec_taxi(t: Tables):
    return projections.record_taxis(t("taxi_records")).select("id", "source", "cab_type", "price", "temperature")


@_query
def prj_rec_weather(t: Tables):
    out = projections.record_weather(t("weather_stored"))
    return out.select("obs_no", "dry_bulb_temperature_celsius", "dew_point_temperature_celsius", "wind_observation", "sky_condition_observation", "visibility_observation", "precip_daily_mm")


@_query
def prj_daily_precip(t: Tables):
    return projections.daily_precipitation(t("weather_stored").select("obs_no", "STATION", "DATE", "AA1")).groupBy("STATION", "DATE").agg(F.max("PRECIP_DAILY_MM").alias("filled")).withColumnsRenamed({"STATION": "station", "DATE": "at"})


@_query
def prj_null_coalesce(t: Tables):
    old = t("bike_records").where("trip_no % 2 = 0").select(
        F.col("trip_no").cast("string").alias("bikeid"), F.when(F.col("trip_no") % 3 > 0, F.col("tripduration").cast("int")).cast("string").alias("tripduration"), "starttime",
        F.expr("replace(starttime, 'T', ' ')").alias("stoptime"), F.col("start_station_id").alias("start station id"), "usertype",
    )
    new = t("bike_records").where("trip_no % 2 = 1").select(
        F.col("trip_no").cast("string").alias("ride_id"), F.col("starttime").alias("started_at"), F.col("starttime").alias("ended_at"), "start_station_id", F.lit("42.5").alias("start_lat"),
        F.col("usertype").alias("member_casual"),
    )
    out = projections.coalesced_trips(files.union_by_name([old, new]))
    return out.select("bikeid", "tripduration", F.col("start station id").alias("station"), F.col("start station latitude").alias("lat"), "usertype")


@_query
def prj_schema_filter(t: Tables):
    known = [name for name, _ in contracts.FIELDS["accident-data"]]
    return projections.only_known(t("accident_records"), known)


@_query
def prj_pad_missing(t: Tables):
    rows = t("weather_stored").select(F.col("obs_no").cast("string").alias("weather_ts"), F.col("PRECIP_DAILY_MM").try_cast("double").alias("precip_daily_mm"))
    return projections.conform(rows, contracts.schema("bike-weather-distance"))


@_query
def prj_rename_norm(t: Tables):
    return projections.normalised_names(t("taxi_records").select(F.col("id").alias("ride id"), F.col("cab_type").alias("cab.type"), F.col("price").alias("ride_id")))


@_query
def prj_ts_normalise(t: Tables):
    text = F.expr("CASE WHEN trip_no % 3 = 0 THEN starttime WHEN trip_no % 3 = 1 THEN concat(starttime, '.250000') ELSE 'x' END")
    return _plain_times(t("bike_records").select("trip_no", projections.timestamp_of(text).alias("at")))


@_query
def prj_legacy_nested(t: Tables):
    rows = t("bike_trips").select(F.col("trip_no").alias("n"), "user_type", "start_time_ts")
    return projections.envelopes(rows.select("n", "user_type", F.col("start_time_ts")), "start_time_ts", "bikes").select("key", F.get_json_object("value", "$.data.n").alias("n"), F.get_json_object("value", "$.timestamp").alias("at"), F.get_json_object("value", "$.source").alias("source"))


@_query
def flt_nan(t: Tables):
    rows = t("events").select("event_type", F.expr("CASE WHEN user_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END").alias("value"))
    return projections.without_nan(rows).groupBy("event_type").agg(F.avg("value").alias("avg_value"), F.count("value").alias("n_values"), F.count("*").alias("n_rows"))


@_query
def src_recent_grid(t: Tables):
    messages = t("events").select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.to_json(F.struct("user_id", "event_type")).alias("value"))
    return files.recent_grid(messages, 15, "user_id long, event_type string").select("offset", "user_id", "event_type")


@_query
def src_recent_grid_keys(t: Tables):
    """Messages whose keys differ, without a schema."""
    number, kind = F.when(F.col("event_id") % 2 == 0, F.col("user_id")), F.when(F.col("event_id") % 3 > 0, F.col("event_type"))
    messages = t("events").select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.to_json(F.struct(number.alias("number"), kind.alias("kind"), (F.col("event_id") % 5).alias("k"))).alias("value"))
    return files.recent_grid(messages, 30).drop("partition")


@_query
def src_framed_ids(t: Tables):
    """Frames of two known schemas with a field of two types, and of an unknown one."""
    trips = t("bike_trips").withColumn("gender_text", F.col("gender").cast("string"))
    frames = [
        wire.encode(trips.where("trip_no % 3 = 0").select("trip_no", "gender"), 258), wire.encode(trips.where("trip_no % 3 = 1").select("trip_no", F.col("gender_text").alias("gender"), "duration_seconds"), 259),
        wire.encode(trips.where("trip_no % 3 = 2").select("trip_no"), 7),
    ]
    decoded = wire.decode_by_id(reduce(DataFrame.union, frames), {258: wire.Writer("trip_no long, gender int"), 259: wire.Writer("trip_no long, gender string, duration_seconds int")})
    good, rejected = wire.records_and_rejects(decoded)
    side = rejected.select("schema_id", F.get_json_object(F.substring("value", 6, 1000).cast("string"), "$.trip_no").cast("long").alias("trip_no"), "problem")
    return good.unionByName(side, allowMissingColumns=True)


@_query
def src_table_preview(t: Tables):
    t("taxi_rides").createOrReplaceTempView("skylane_previewed")
    return files.preview(t.spark, "skylane_previewed", ["trip_no"], 25).select("trip_no", "cab_type", "price")


@_query
def snk_kafka_json(t: Tables):
    return sinks.to_json_messages(t("bike_trips").select("trip_no", "user_type", "duration_seconds"), "trip_no")


@_query
def snk_framed(t: Tables):
    framed = wire.encode(t("bike_trips").select("trip_no", "user_type"), 258)
    return framed.select(wire.schema_id_of(F.col("value")).alias("schema_id"), F.hex(F.substring("value", 1, 5)).alias("frame"), F.substring("value", 6, 1000).cast("string").alias("body"))


@_query
def src_framed(t: Tables):
    framed = wire.encode(t("bike_trips").select("trip_no", "user_type"), 258)
    broken = framed.select(F.expr("CASE WHEN hash(value) % 2 = 0 THEN concat(X'01', substr(value, 2)) ELSE substr(value, 1, 3) END").alias("value"))
    return jobs.decoded(framed.union(broken), "trip_no long, user_type string")


@_query
def agg_live_count(t: Tables):
    messages = t("events").select(F.lit(0).alias("partition"), F.floor(F.col("event_id") / 2).alias("offset"), F.col("ts").cast("timestamp").alias("ts"))
    hourly = messages.withColumn("ts", F.date_trunc("hour", "ts"))
    live = sinks.live_buckets(hourly.groupBy("partition", "offset").agg(F.max("ts").alias("ts")), "ts", "1 hour", [F.count("*").alias("n")], keep=24)
    return _plain_times(live.select(F.col("window.start").alias("window_start"), "n"))


@_query
def st_session(t: Tables):
    return windows.flat(windows.session_counts(t("bike_trips"), ["start_station_id"], "start_time_ts", "1 hour"))


@_query
def src_catalog_table(t: Tables):
    t("taxi_rides").createOrReplaceTempView("skylane_catalogued")
    return files.tables(t.spark).where("name = 'skylane_catalogued'")


@_query
def sql_free_form(t: Tables):
    t("taxi_rides").createOrReplaceTempView("skylane_taxi_rides")
    return panels.sql(t.spark, "-- rides of a cab\nSELECT cab_type, count(*) AS rides, max(price) AS top_price FROM skylane_taxi_rides GROUP BY cab_type;")


@_query
def job_distance(t: Tables):
    """The deployed chain from contract records: nearest weather of each trip, then distance and speed."""
    near = jobs.nearest_weather(projections.slim_bikes(t("bike_records"), watermark=None), projections.slim_weather(t("weather_records"), watermark=None))
    return _plain_times(geo.add_distance_and_speed(near).select("starttime", "weather_ts", "temp_c", "precip_daily_mm", "tripduration", "distance_meters", "average_speed_kmh"))


@_query
def job_statistics(t: Tables):
    near = jobs.nearest_weather(projections.slim_bikes(t("bike_records"), watermark=None), projections.slim_weather(t("weather_records"), watermark=None))
    return jobs.statistics(jobs.distances(near))["by_precipitation"].select("precip_level", "mean_speed", "mean_distance", "sample_size")
