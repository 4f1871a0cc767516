"""Parsing and projection of raw records into the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions.weather import add_precipitation_flags, enrich_weather, fahrenheit_to_celsius
from skylane.operators.windows import forward_fill

#: Formats of timestamps in the feeds (fixed values).
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSS")


def timestamp_of(text: Column, epoch: bool = False) -> Column:
    """A timestamp from any of the known formats, with ``epoch`` also from seconds since 1970; null if none fits."""
    tried = [F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]
    if epoch:
        tried.append(F.timestamp_seconds(text.cast("string").try_cast("double")))
    return F.coalesce(*tried)


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    """Add ``year, month, date, hour`` of a timestamp, the columns that partition stored tables."""
    t = F.col(ts)
    return df.withColumns({"year": F.year(t), "month": F.month(t), "date": F.date_format(t, "yyyy-MM-dd"), "hour": F.hour(t)})


def trip_id(station: str, ts: str) -> Column:
    return F.concat_ws("_", F.col(station), F.date_format(F.col(ts), "yyyyMMddHHmmss"))


def _watermarked(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return df.withWatermark(ts, delay) if delay else df


def parse_bikes(raw: DataFrame, watermark: str | None = "10 minutes") -> DataFrame:
    """Bike contract: renamed, with integer duration, timestamps and calendar columns. The watermark is set here and only here."""
    renamed = raw.withColumnsRenamed({"usertype": "user_type"}).withColumn("duration_seconds", F.col("tripduration").cast("int")).drop("tripduration")
    timed = renamed.withColumns({"start_time_ts": timestamp_of(F.col("starttime")), "stop_time_ts": timestamp_of(F.col("stoptime"))})
    return _watermarked(with_calendar(timed, "start_time_ts"), "start_time_ts", watermark)


def parse_taxis(raw: DataFrame, watermark: str | None = "10 minutes") -> DataFrame:
    """Taxi contract: renamed; hour and month are those of the timestamp."""
    renamed = raw.withColumnsRenamed({"id": "trip_id", "source": "pickup_location", "destination": "dropoff_location"}).drop("hour", "month", "day")
    return _watermarked(with_calendar(renamed.withColumn("datetime_ts", timestamp_of(F.col("datetime"))), "datetime_ts"), "datetime_ts", watermark)


def parse_weather(raw: DataFrame, watermark: str | None = "10 minutes", strict_missing: bool = False) -> DataFrame:
    """Weather contract: renamed, enriched and flagged."""
    renamed = raw.withColumnsRenamed(
        {
            "wind_observation": "wind", "sky_condition_observation": "sky_condition", "visibility_observation": "visibility",
            "dry_bulb_temperature_celsius": "temperature", "dew_point_temperature_celsius": "dew_point",
        }
    )
    timed = with_calendar(renamed.withColumn("datetime_ts", timestamp_of(F.col("observation_date"))), "datetime_ts")
    return _watermarked(add_precipitation_flags(enrich_weather(timed, strict_missing)), "datetime_ts", watermark)


def parse_accidents(raw: DataFrame, watermark: str | None = "10 minutes") -> DataFrame:
    """Accident contract: numeric coordinates and a dispatch timestamp."""
    numbers = {c: F.col(c).try_cast("double") for c in ("x_cord", "y_cord", "lat", "long")}
    timed = raw.withColumns({**numbers, "dispatch_timestamp": timestamp_of(F.col("dispatch_ts"))})
    return _watermarked(with_calendar(timed, "dispatch_timestamp"), "dispatch_timestamp", watermark)


def slim_bikes(raw: DataFrame, watermark: str | None = "10 minutes") -> DataFrame:
    """What the nearest-weather job needs of a trip."""
    keep = ["tripduration", "start_station_latitude", "start_station_longitude", "end_station_latitude", "end_station_longitude"]
    out = raw.select(timestamp_of(F.col("starttime")).alias("starttime"), timestamp_of(F.col("stoptime")).alias("stoptime"), *keep)
    return _watermarked(out, "starttime", watermark)


def slim_weather(raw: DataFrame, watermark: str | None = "10 minutes") -> DataFrame:
    """What the nearest-weather job needs of an observation."""
    out = raw.select(timestamp_of(F.col("observation_date")).alias("weather_ts"), F.col("dry_bulb_temperature_celsius").alias("temp_c"), "precip_daily_mm")
    return _watermarked(out, "weather_ts", watermark)


def normalised_names(df: DataFrame) -> DataFrame:
    """Spaces and dots in names become underscores; of names that are then equal the first column stays."""
    seen: dict[str, str] = {}
    for c in df.columns:
        seen.setdefault(c.replace(" ", "_").replace(".", "_"), c)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in seen.items()])


def conform(df: DataFrame, schema) -> DataFrame:
    """Exactly the columns of a contract, in order and type; absent ones are typed nulls."""
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def only_known(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that a contract knows, others dropped."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(names)])


def coalesced_trips(raw: DataFrame) -> DataFrame:
    """Old and new trip files as one layout: missing columns come from their newer names, duration from the two times."""
    has = set(raw.columns)
    old_or_new = {
        "starttime": ("starttime", "started_at"), "stoptime": ("stoptime", "ended_at"), "start station id": ("start station id", "start_station_id"),
        "start station name": ("start station name", "start_station_name"), "start station latitude": ("start station latitude", "start_lat"),
        "start station longitude": ("start station longitude", "start_lng"), "end station id": ("end station id", "end_station_id"),
        "end station name": ("end station name", "end_station_name"), "end station latitude": ("end station latitude", "end_lat"),
        "end station longitude": ("end station longitude", "end_lng"), "bikeid": ("bikeid", "ride_id"), "usertype": ("usertype", "member_casual"),
        "birth year": ("birth year",), "gender": ("gender",),
    }

    def pick(name: str) -> Column:
        found = [F.col(f"`{c}`").cast("string") for c in old_or_new[name] if c in has]
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        return value.try_cast("double") if name.endswith(("latitude", "longitude")) else value

    start, stop = timestamp_of(pick("starttime")), timestamp_of(pick("stoptime"))
    given = F.col("tripduration").cast("string").try_cast("double") if "tripduration" in has else F.lit(None).cast("double")
    duration = F.coalesce(given, (F.unix_timestamp(stop) - F.unix_timestamp(start)).cast("double"))
    return raw.select(duration.alias("tripduration"), *[pick(c).alias(c) for c in old_or_new])


def _number(c: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(default))


def record_bikes(rows: DataFrame) -> DataFrame:
    """Stored trips as stream records: names with underscores, unknowns filled in."""
    rows = normalised_names(rows)
    return rows.withColumns(
        {
            "usertype": F.coalesce("usertype", F.lit("Unknown")),
            "birth_year": F.coalesce(F.col("birth_year").cast("string").try_cast("int"), F.lit(0)),
            "gender": F.coalesce(F.col("gender").cast("string").try_cast("int"), F.lit(0)),
        }
    )


#: Taxi fields in degrees Fahrenheit (fixed values).
FAHRENHEIT_FIELDS = (
    "temperature", "apparentTemperature", "temperatureHigh", "temperatureLow", "apparentTemperatureHigh", "apparentTemperatureLow", "dewPoint",
    "temperatureMin", "temperatureMax", "apparentTemperatureMin", "apparentTemperatureMax",
)


def record_taxis(rows: DataFrame) -> DataFrame:
    """Stored rides as stream records: Celsius, numbers 0.0 and strings 'Unknown' where missing or 'NA'."""
    out = {}
    for c, kind in rows.dtypes:
        if c in FAHRENHEIT_FIELDS:
            out[c] = F.coalesce(fahrenheit_to_celsius(F.col(c).cast("string").try_cast("double")), F.lit(0.0))
        elif c in ("price", "distance", "surge_multiplier", "humidity", "windSpeed", "precipIntensity"):
            out[c] = _number(c)
        elif kind == "string":
            out[c] = F.coalesce(c, F.lit("Unknown"))
        elif kind in ("int", "bigint"):
            out[c] = F.coalesce(c, F.lit(0).cast(kind))
    return rows.withColumns(out)


def celsius_of_code(text: Column) -> Column:
    """'+0056,1' to 5.6; the code for missing and unreadable text give 0.0."""
    tenths = F.get(F.split(text, ","), F.lit(0)).try_cast("int")
    return F.when(tenths.isNull() | (F.abs(tenths) == 9999), 0.0).otherwise(tenths / 10.0)


def record_weather(rows: DataFrame) -> DataFrame:
    """Stored observations as stream records: temperatures in Celsius, daily precipitation from tenths to millimetres, missing text empty."""
    out = {
        "dry_bulb_temperature_celsius": celsius_of_code(F.col("TMP")), "dew_point_temperature_celsius": celsius_of_code(F.col("DEW")),
        "precip_daily_mm": _number("PRECIP_DAILY_MM") / 10.0,
    }
    texts = {"WND": "wind_observation", "CIG": "sky_condition_observation", "VIS": "visibility_observation"}
    return rows.withColumns({**out, **{new: F.coalesce(old, F.lit("")) for old, new in texts.items()}})


def daily_precipitation(rows: DataFrame) -> DataFrame:
    """Fill each station's daily precipitation forward: the amount of the last '24,…' code up to the row's time."""
    code = F.col("AA1")
    amount = F.when(code.startswith("24,"), F.get(F.split(code, ","), F.lit(1)).try_cast("int"))
    return forward_fill(rows.withColumn("__amount", amount), ["STATION"], "DATE", "__amount", "PRECIP_DAILY_MM").drop("__amount")


def without_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN as null in the given (or all) float and double columns, so that no average is spoilt by one."""
    kinds = dict(df.dtypes)
    names = [c for c in (columns or df.columns) if kinds[c] in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in names})


def envelopes(df: DataFrame, ts: str, source: str) -> DataFrame:
    """Records as JSON envelopes ``{data, timestamp, source}`` with an hourly partition key."""
    body = F.struct(F.struct(*[c for c in df.columns]).alias("data"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(source).alias("source"))
    return df.select(F.date_format(ts, "yyyy-MM-dd-HH").alias("key"), F.to_json(body).alias("value"))
