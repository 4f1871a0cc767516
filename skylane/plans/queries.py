"""Registered queries over the benchmark tables. Floats are rounded, so engines agree on every digit that is compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylane.functions import geo, weather
from skylane.operators import analytics, joins, panels, projections, rollups, stats, windows
from skylane.sources import files
from skylane.sources.adapters import ADAPTERS, read
from skylane.sources.stored import stored
from skylane.streaming import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Tables:
    """``t(name)`` reads a table, adapted ones from ``events``; ``path(name)`` is where a stored one lies."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name) if name in ADAPTERS else self.spark.read.parquet(self.path(name))


def _query(f):
    QUERIES[f.__name__.lstrip("_")] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _sky(t) -> DataFrame:
    return weather.enrich_weather(t("weather_raw"))


def _combined(t, **kw) -> DataFrame:
    return windows.combined_windows(t("bike_trips"), t("taxi_rides"), _sky(t), tie="obs_no", **kw)


def _trips(t) -> DataFrame:
    """Trips with the nearest weather within an hour, distance, speed and condition: the table behind statistics and panels."""
    bikes = t("bike_trips").select(
        "trip_no", F.col("start_time_ts").alias("starttime"), (F.col("start_time_ts") + F.make_dt_interval(secs=F.col("duration_seconds"))).alias("stoptime"),
        F.col("duration_seconds").cast("double").alias("tripduration"), *geo._ENDS,
    )
    sky = t("weather_raw").select("obs_no", F.col("datetime_ts").alias("weather_ts"), weather.parse_temperature(F.col("temperature")).alias("temp_c"), "precip_daily_mm")
    near = joins.nearest_in_time(bikes, sky, "starttime", "weather_ts", "obs_no", 3600)
    measured = geo.add_distance_and_speed(near)
    return measured.withColumn("weather_condition", weather.condition_by_precipitation(F.col("temp_c"), F.col("precip_daily_mm")))


def _statistics(t) -> tuple[DataFrame, DataFrame]:
    """Cells, and the counts of values that make percentiles exact."""
    return tuple(stored(t("events"), f.__name__, lambda: f(_trips(t))) for f in (rollups.statistics_cells, rollups.statistics_values))


def _panel_cells(t) -> DataFrame:
    return stored(t("events"), "panel_cells", lambda: rollups.panel_cells(_trips(t)))


@_query
def flagship(t):
    return stats.by_condition(_trips(t))


# -- filters, projections, metrics -----------------------------------------------------------------------------------
@_query
def met_haversine(t):
    return geo.add_distance_and_speed(t("bike_trips"), "duration_seconds").select("trip_no", "distance_meters", "average_speed_kmh")


@_query
def met_haversine_zero(t):
    return geo.add_distance_and_speed(t("bike_trips"), "duration_seconds", zero_missing=True).select("trip_no", "distance_meters", "average_speed_kmh")


@_query
def flt_speed_outlier(t):
    return geo.plausible_speed(geo.add_distance_and_speed(t("bike_trips"), "duration_seconds")).select("trip_no", "average_speed_kmh")


@_query
def flt_geo_bounds(t):
    return geo.plausible_coordinates(t("bike_trips")).select("trip_no", *geo._ENDS)


@_query
def flt_date_range(t):
    return panels.in_range(_trips(t), "2024-01-05", "2024-01-12 12:00:00").select("trip_no", "starttime", "stoptime")


@_query
def prj_trip_id(t):
    return t("bike_trips").select("trip_no", projections.trip_id("start_station_id", "start_time_ts").alias("trip_id"))


@_query
def prj_calendar(t):
    return projections.with_calendar(t("bike_trips").select("trip_no", "start_time_ts"), "start_time_ts")


@_query
def enr_weather(t):
    return weather.add_precipitation_flags(_sky(t)).drop("temperature", "wind", "visibility", "precip_daily_mm", "station")


@_query
def cat_conditions(t):
    s = _sky(t)
    temp, precip = F.col("temp_c"), F.col("precip_daily_mm")
    return s.select(
        "obs_no", weather.condition_by_visibility(temp, F.col("visibility_m")).alias("condition_vis"), weather.condition_by_precipitation(temp, precip).alias("condition_precip"),
        weather.temperature_range(temp).alias("temp_short"), weather.temperature_range(temp, True).alias("temp_long"),
        weather.precipitation_level(precip).alias("precip_short"), weather.precipitation_level(precip, True).alias("precip_long"),
    )


# -- joins -----------------------------------------------------------------------------------------------------------
def _starts(t):
    return t("bike_trips").select("trip_no", "start_time_ts")


def _observed(t):
    return t("weather_raw").select("obs_no", F.col("datetime_ts").alias("weather_ts"))


@_query
def jn_interval_inner(t):
    return joins.within_interval(_starts(t), _observed(t), "start_time_ts", "weather_ts", 3600).select("trip_no", "obs_no")


@_query
def jn_nearest(t):
    return joins.nearest_in_time(_starts(t), _observed(t), "start_time_ts", "weather_ts", "obs_no", 3600)


@_query
def jn_nearest_rn(t):
    # The two neighbours in time are all that can be first.
    both = joins.neighbours_in_time(_starts(t), _observed(t), "start_time_ts", "weather_ts", "obs_no", 3600)
    pairs = both.select("__l.trip_no", "__t", F.explode(F.array("__before", "__after")).alias("o")).where("o is not null")
    rn = F.row_number().over(Window.partitionBy("trip_no").orderBy(F.abs(F.col("__t") - F.col("o.t")), "o.t"))
    return pairs.withColumn("rn", rn).where("rn = 1").select("trip_no", "o.r.obs_no")


@_query
def jn_tolerance_left(t):
    return joins.within_interval(_starts(t), _observed(t), "start_time_ts", "weather_ts", 300, how="left").select("trip_no", "obs_no")


@_query
def jn_daily_precip(t):
    return joins.with_daily_precipitation(_starts(t), t("weather_raw"), "start_time_ts", "datetime_ts").select("trip_no", "precip_date", "daily_precip_mm", "has_precipitation")


# -- windows ---------------------------------------------------------------------------------------------------------
@_query
def agg_bike_window(t):
    return windows.flat(windows.bike_windows(t("bike_trips")))


@_query
def agg_bike_sliding(t):
    return windows.flat(windows.bike_windows(t("bike_trips"), "15 minutes", "5 minutes"))


@_query
def agg_taxi_window(t):
    return windows.flat(windows.taxi_windows(t("taxi_rides")))


@_query
def agg_weather_window(t):
    return windows.flat(windows.weather_windows(_sky(t), tie="obs_no"))


@_query
def agg_accident_window(t):
    return windows.flat(windows.accident_windows(t("accidents")))


@_query
def agg_combined(t):
    return windows.flat(_combined(t))


@_query
def agg_combined_weighted(t):
    return windows.flat(_combined(t, weighted=True)).select("window_start", "avg_bike_duration_min", "avg_taxi_price", "avg_taxi_surge")


@_query
def agg_binned_temp(t):
    return windows.usage_by_bin(_combined(t), "temp")


@_query
def agg_binned_wind(t):
    return windows.usage_by_bin(_combined(t), "wind")


@_query
def agg_binned_score(t):
    return windows.usage_by_bin(_combined(t), "score")


# -- analytics -------------------------------------------------------------------------------------------------------
_KEPT = ["window_start", "window_end"]


def _added(f, t):
    base = windows.flat(_combined(t))
    out = f(base)
    return out.select(*_KEPT, *[c for c in out.columns if c not in base.columns])


@_query
def ana_weather_transport(t):
    return _added(analytics.weather_transport, t)


@_query
def ana_precip_impact(t):
    return _added(analytics.precipitation_impact, t)


@_query
def ana_temporal(t):
    return _added(analytics.temporal_segments, t)


@_query
def ana_pearson_products(t):
    return _added(analytics.correlation_products, t)


@_query
def ana_corr(t):
    return analytics.correlations(_combined(t))


@_query
def ana_binned(t):
    return _added(analytics.weather_bins, t)


@_query
def ana_multi(t):
    return _added(analytics.multi_variable, t)


@_query
def ana_surge(t):
    out = analytics.surge_reasons(t("taxi_rides"))
    return out.select("trip_no", "is_raining", "is_very_cold", "is_very_hot", "is_humid", "is_surge", "weather_driven_surge_score", "surge_reason")


@_query
def ana_usage_summary(t):
    return analytics.usage_summary(t("bike_trips"), t("taxi_rides"))


@_query
def ana_safety_risk(t):
    return analytics.safety_risk(t("accidents"), _sky(t))


@_query
def ana_accident_weather(t):
    return analytics.accident_weather(_combined(t), t("accidents"))


# -- statistics and panels -------------------------------------------------------------------------------------------
@_query
def agg_overall_stats(t):
    return stats.overall(_trips(t))


@_query
def agg_stats_condition(t):
    return stats.by_condition(_trips(t))


@_query
def agg_stats_temp(t):
    return stats.by_temperature(_trips(t))


@_query
def agg_stats_precip(t):
    return stats.by_precipitation(_trips(t))


@_query
def agg_overall_merged(t):
    return rollups.overall(*_statistics(t))


@_query
def agg_condition_merged(t):
    return rollups.by_condition(*_statistics(t))


@_query
def agg_temperature_merged(t):
    return rollups.by_temperature(*_statistics(t))


@_query
def agg_precipitation_merged(t):
    return rollups.by_precipitation(*_statistics(t))


@_query
def sql_time_range(t):
    return rollups.time_range(_panel_cells(t))


@_query
def sql_trips_by_hour(t):
    return rollups.trips_by_hour(_panel_cells(t))


@_query
def sql_precip_impact(t):
    return rollups.precipitation_panel(_panel_cells(t))


@_query
def sql_temp_vs_speed(t):
    return rollups.temperature_and_speed(_panel_cells(t))


@_query
def sql_speed_hist(t):
    return rollups.speed_histogram(_panel_cells(t))


@_query
def sql_distance_hist(t):
    return rollups.distance_histogram(_panel_cells(t))


@_query
def sql_overall(t):
    return panels.overall_panel(rollups.overall(*_statistics(t)))


@_query
def sql_by_condition(t):
    return panels.condition_panel(rollups.by_condition(*_statistics(t)))


@_query
def sql_by_temperature(t):
    return panels.temperature_panel(rollups.by_temperature(*_statistics(t)))


@_query
def sql_taxi_by_hour(t):
    return panels.taxi_trips_by_hour(t("taxi_rides"))


@_query
def sql_doc_demand(t):
    out = windows.flat(_combined(t)).where("avg_temperature_c is not null")
    return out.select("window_start", "avg_temperature_c", "total_bike_rentals", "avg_weather_score").orderBy("window_start")


@_query
def sql_doc_risk(t):
    out = analytics.safety_risk(t("accidents"), _sky(t)).where(F.col("risk_category").isin("high", "very_high"))
    return out.select("window_start", "mode_type", "accident_count", "avg_weather_score", "safety_risk_index_normalized", "risk_category").orderBy(F.desc("safety_risk_index_normalized"))


@_query
def sql_doc_surge(t):
    out = analytics.surge_reasons(t("taxi_rides")).where("is_surge = 1").groupBy("surge_reason")
    return out.agg(F.count("*").alias("ride_count"), F.avg("surge_multiplier").alias("avg_surge"), F.avg("temperature").alias("avg_temp"), F.avg("precip_intensity").alias("avg_rain"))


# -- general aggregates ----------------------------------------------------------------------------------------------
@_query
def agg_basic(t):
    return t("taxi_rides").agg(
        F.count("*").alias("rides"), F.avg("distance").alias("avg_distance"), F.avg("price").alias("avg_price"), F.avg("surge_multiplier").alias("avg_surge"), F.sum("price").alias("revenue")
    )


@_query
def agg_by_hour(t):
    return t("taxi_rides").groupBy(F.hour("datetime_ts").alias("hour")).agg(F.count("*").alias("rides"), F.avg("price").alias("avg_price"))


@_query
def agg_by_day(t):
    return t("taxi_rides").groupBy(F.dayofmonth("datetime_ts").alias("day")).agg(F.count("*").alias("rides"))


@_query
def agg_by_key(t):
    return t("bike_trips").groupBy("start_station_id").agg(F.count("*").alias("trips"))


@_query
def agg_corr(t):
    return t("taxi_rides").agg(F.corr("distance", "price").alias("r"))


@_query
def agg_cab_breakdown(t):
    return t("taxi_rides").groupBy("cab_type").agg(F.count("*").alias("rides")).orderBy(F.desc("rides"), "cab_type")


@_query
def agg_weighted_mean(t):
    return panels.weighted_mean(rollups.distance_histogram(_panel_cells(t)), "distance_bucket", "trip_count")


@_query
def agg_live_bike(t):
    grouped = t("bike_trips").groupBy(F.window("start_time_ts", "1 hour").alias("window"))
    return windows.flat(grouped.agg(F.count("*").alias("trips"), (F.avg("duration_seconds") / 60).alias("avg_minutes"), F.countDistinct("start_station_id").alias("stations")))


@_query
def agg_live_taxi(t):
    return windows.flat(t("taxi_rides").groupBy(F.window("datetime_ts", "1 hour").alias("window"), "cab_type").agg(F.count("*").alias("rides")))


@_query
def agg_live_weather(t):
    s = _sky(t)
    order = F.when(F.col("temp_c").isNotNull(), F.struct("datetime_ts", "obs_no"))
    grouped = s.groupBy(F.window("datetime_ts", "1 hour").alias("window"))
    return windows.flat(grouped.agg(F.avg("temp_c").alias("avg_temp"), F.max_by("temp_c", order).alias("latest_temp"), F.avg("precip_daily_mm").alias("avg_precip")))


@_query
def win_ffill(t):
    rows = t("weather_raw").select("obs_no", "station", "datetime_ts", F.when(F.col("precip_daily_mm") > 0, F.col("precip_daily_mm")).alias("precip"))
    return windows.forward_fill(rows, ["station"], "datetime_ts", "precip", "precip_filled", "obs_no").select("obs_no", "station", "precip_filled")


@_query
def srt_argmax(t):
    hours = t("taxi_rides").groupBy(F.hour("datetime_ts").alias("hour")).count()
    days = t("taxi_rides").groupBy(F.dayofmonth("datetime_ts").alias("day")).count()
    best = lambda df, c: df.agg(F.max_by(c, F.struct("count", -F.col(c))).alias(f"busiest_{c}"), F.max("count").alias(f"rides_in_{c}"))
    return best(hours, "hour").crossJoin(best(days, "day"))  # one row each


@_query
def srt_top1(t):
    return t("taxi_rides").orderBy(F.desc("price"), "trip_no").limit(1).select("trip_no", "price")


def _messages(t):
    """Events as messages of a topic with one partition."""
    return t("events").withColumns({"partition": F.lit(0), "offset": F.col("event_id")})


@_query
def src_topic_sample(t):
    return files.topic_sample(_messages(t), 20).select("event_id", "event_type", "value")


@_query
def src_parquet_range(t):
    return files.read_range(t.spark, t.path("events"), "ts", "2024-01-03", "2024-01-04", ordered=True).select("event_id", "ts")


@_query
def src_replay_halfopen(t):
    return files.read_range(t.spark, t.path("events"), "ts", "2024-01-03", "2024-01-04", half_open=True).select("event_id", "ts")


@_query
def set_dedupe_offsets(t):
    e = t("events").select((F.col("event_id") % 4).alias("partition"), F.floor(F.col("event_id") / 8).alias("offset"), "event_id")
    return sinks.latest_of(e, ["partition", "offset"], "event_id", earliest=True)


@_query
def set_union_by_name(t):
    return files.union_by_name([t("taxi_rides").select("trip_no", "price"), t("bike_trips").select("trip_no", "user_type")])


@_query
def agg_topic_stats(t):
    by_type = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return by_type.agg(F.count("*").alias("topics"), F.count_if(F.col("event_type").startswith("s")).alias("internal"), F.sum("n").alias("messages"))
