"""The stream jobs as compositions of operators: nearest weather, distance, statistics, and the analytics fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.functions import geo, weather
from skylane.operators import analytics, joins, stats, windows
from skylane.streaming import wire


def session_settings(shuffle_partitions: int = 8) -> dict[str, str]:
    """Settings for stream jobs: UTC, state in RocksDB, and as many shuffle partitions as the state should have shards."""
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }


def read_topic(spark: SparkSession, topic: str, servers: str | None = None, path: str | None = None, earliest: bool = True, fail_on_loss: bool = False) -> DataFrame:
    """A topic as a stream of framed ``value``: from a broker, or from Parquet files written by the framed sink."""
    if servers:
        source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        return source.option("startingOffsets", "earliest" if earliest else "latest").option("failOnDataLoss", str(fail_on_loss).lower()).load()
    return spark.readStream.schema("value binary").parquet(f"{path}/{topic}")


def decoded(frames: DataFrame, schema, avro: str | None = None) -> DataFrame:
    """Records of a framed stream; broken frames are left out. ``avro`` is the Avro schema text of Avro bodies."""
    return wire.decode(frames, schema, avro).where("data is not null").select("data.*")


def nearest_weather(bikes: DataFrame, sky: DataFrame, seconds: int = 3600) -> DataFrame:
    """Trips (``starttime``) with the nearest weather (``weather_ts``); streams have watermarks on both.

    ``obs_no`` settles ties where it is there. State is spread over slices of time.
    """
    return joins.nearest_in_time(bikes, sky, "starttime", "weather_ts", "obs_no" if "obs_no" in sky.columns else None, seconds)


def distances(trips: DataFrame) -> DataFrame:
    return geo.add_distance_and_speed(trips)


def statistics(trips: DataFrame) -> dict[str, DataFrame]:
    """The four statistics, for complete mode on streams."""
    marked = trips.withColumn("weather_condition", weather.condition_by_precipitation(F.col("temp_c"), F.col("precip_daily_mm")))
    return {"overall": stats.overall(marked), "by_condition": stats.by_condition(marked), "by_temperature": stats.by_temperature(marked), "by_precipitation": stats.by_precipitation(marked)}


def analytics_of(combined: DataFrame) -> dict[str, DataFrame]:
    """The row-wise analytics over a stored combined window table, computed once and read by all of them."""
    flat = windows.flat(combined) if "window" in combined.columns else combined
    rules = {
        "weather_transport_correlation": analytics.weather_transport, "pearson_correlations": analytics.correlation_products, "binned_weather": analytics.weather_bins,
        "precipitation_impact": analytics.precipitation_impact, "temporal_segments": analytics.temporal_segments, "multi_variable": analytics.multi_variable,
    }
    return {name: f(flat) for name, f in rules.items()}
