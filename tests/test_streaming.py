"""Streams give the batch results for closed windows, and frames keep their promises."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skylane.functions import weather
from skylane.operators import analytics, joins, stream_joins, windows
from skylane.sources import contracts, synthetic
from skylane.sources.adapters import adapt
from skylane.streaming import jobs, sinks, wire

EVENTS = "/root/testdata/sf0.001/events.parquet"


def _stream(spark, df, tmp_path, ts, name, watermark="10 minutes"):
    """The rows of a batch frame as a stream, with one far row at the end so that all real windows close."""
    path = str(tmp_path / name)
    last = df.orderBy(F.desc(ts)).limit(1).withColumn(ts, F.lit("2030-01-01").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{path}/a")
    last.coalesce(1).write.parquet(f"{path}/b")
    out = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    return out.withWatermark(ts, watermark)


def _ended(q):
    """The query after its end, which comes within two minutes."""
    try:
        assert q.awaitTermination(120), f"{q.name} still runs"
    finally:
        q.stop()
    return q


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    return _ended(q)


def _rows(df, columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect())


@pytest.fixture
def tables(spark):
    events = spark.read.parquet(EVENTS)
    return {t: adapt(events, t, zoned=True) for t in ("bike_trips", "taxi_rides", "weather_raw", "accidents")}


def test_bike_windows_on_a_stream(spark, tables, tmp_path):
    columns = ["window_start", "user_type", "rental_count", "avg_duration_minutes"]
    _run(windows.flat(windows.bike_windows(_stream(spark, tables["bike_trips"], tmp_path, "start_time_ts", "b"))), tmp_path, "bikes")
    assert _rows(spark.table("bikes"), columns) == _rows(windows.flat(windows.bike_windows(tables["bike_trips"])), columns)


def test_combined_windows_on_streams(spark, tables, tmp_path):
    s = {t: _stream(spark, tables[t], tmp_path, ts, t) for t, ts in (("bike_trips", "start_time_ts"), ("taxi_rides", "datetime_ts"), ("weather_raw", "datetime_ts"))}
    combined = windows.combined_windows(s["bike_trips"], s["taxi_rides"], weather.enrich_weather(s["weather_raw"]), tie="obs_no")
    _run(windows.flat(combined), tmp_path, "combined")
    columns = ["window_start", "total_bike_rentals", "total_taxi_rides", "avg_temperature_c", "bike_share_pct"]
    batch = windows.combined_windows(tables["bike_trips"], tables["taxi_rides"], weather.enrich_weather(tables["weather_raw"]), tie="obs_no")
    got, want = _rows(spark.table("combined").where("window_start < '2029-01-01'"), columns), _rows(windows.flat(batch), columns)
    assert got == want


def test_nearest_weather_on_streams(spark, tables, tmp_path):
    bikes = tables["bike_trips"].select("trip_no", F.col("start_time_ts").alias("starttime"))
    sky = tables["weather_raw"].select("obs_no", F.col("datetime_ts").alias("weather_ts"))
    out = jobs.nearest_weather(_stream(spark, bikes, tmp_path, "starttime", "nb"), _stream(spark, sky, tmp_path, "weather_ts", "nw"))
    q = _run(out, tmp_path, "nearest")
    batch = joins.nearest_in_time(bikes, sky, "starttime", "weather_ts", "obs_no", 3600)
    columns = ["trip_no", "obs_no", "starttime"]
    got = _rows(spark.table("nearest").where("starttime < '2029-01-01'"), columns)
    want = _rows(batch, columns)
    assert got == want


def _state_rows(q):
    """Most rows that any operator of the query held in state after a batch."""
    return max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"])


def test_nearest_weather_keeps_state_linear_in_both_inputs(spark, tmp_path):
    """A crowded quarter of an hour: 400 trips by 400 observations would be 160,000 pairs."""
    t, second = dt.datetime(2024, 1, 1, 10), dt.timedelta(seconds=1)
    bikes = spark.createDataFrame([(k, t + k * second) for k in range(400)] + [(k, None) for k in range(3)], "trip_no long, starttime timestamp")
    sky = spark.createDataFrame([(k, t + k * 2 * second) for k in range(400)], "obs_no long, weather_ts timestamp")
    q = _run(jobs.nearest_weather(_stream(spark, bikes, tmp_path, "starttime", "cb"), _stream(spark, sky, tmp_path, "weather_ts", "cw")), tmp_path, "crowd")
    got = spark.table("crowd").where("starttime < '2029-01-01'").collect()
    assert sorted((r.trip_no, r.obs_no, r.time_diff) for r in got) == [(k, k // 2, k % 2) for k in range(400)]
    assert _state_rows(q) <= 400 + 1 + (400 + 1) * (2 * stream_joins.SLICES + 1) + 200  # rows, copies of observations, timers


@pytest.mark.parametrize("how", ["inner", "left"])
def test_outer_joins_by_time_on_streams(spark, tables, tmp_path, how):
    bikes = tables["bike_trips"].select("trip_no", "start_time_ts", F.struct("user_type", F.lit(None).cast("double").alias("x")).alias("more"))
    twice = bikes.union(bikes.where("trip_no % 50 = 0"))  # repeated rows stay
    sky = tables["weather_raw"].select("obs_no", F.col("datetime_ts").alias("weather_ts"))
    sky = sky.union(sky.where("obs_no % 9 = 0"))
    left, right = _stream(spark, twice, tmp_path, "start_time_ts", "ob"), _stream(spark, sky, tmp_path, "weather_ts", "ow")
    _run(joins.within_interval(left, right, "start_time_ts", "weather_ts", 300, how), tmp_path, f"within_{how}")
    columns = ["trip_no", "obs_no", "start_time_ts", "weather_ts", "more"]
    want = _rows(joins.within_interval(twice, sky, "start_time_ts", "weather_ts", 300, how), columns)
    assert _rows(spark.table(f"within_{how}").where("start_time_ts < '2029-01-01'"), columns) == want
    left, right = _stream(spark, twice, tmp_path, "start_time_ts", "nb"), _stream(spark, sky, tmp_path, "weather_ts", "nw")
    _run(joins.nearest_in_time(left, right, "start_time_ts", "weather_ts", "obs_no", 300, how), tmp_path, f"nearest_{how}")
    want = _rows(joins.nearest_in_time(twice, sky, "start_time_ts", "weather_ts", "obs_no", 300, how), [*columns, "time_diff"])
    assert _rows(spark.table(f"nearest_{how}").where("start_time_ts < '2029-01-01'"), [*columns, "time_diff"]) == want


def test_safety_joins_on_streams(spark, tables, tmp_path):
    """Left joins of accident windows with weather windows: a row for each closed accident window, weather or not."""
    accidents, sky = tables["accidents"], tables["weather_raw"].where("hour(datetime_ts) % 3 <> 0")
    batch = analytics.safety_risk(accidents, weather.enrich_weather(sky))
    s = _stream(spark, accidents, tmp_path, "dispatch_timestamp", "sa"), _stream(spark, sky, tmp_path, "datetime_ts", "sw")
    _run(analytics.safety_risk(s[0], weather.enrich_weather(s[1])), tmp_path, "safety")
    columns = ["window_start", "mode_type", "accident_count", "avg_weather_score", "risk_category"]
    assert _rows(spark.table("safety").where("window_start < '2029-01-01'"), columns) == _rows(batch, columns)


def test_late_rows_do_not_change_closed_windows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + d,) for d in (dt.timedelta(0), dt.timedelta(hours=5), dt.timedelta(hours=6), dt.timedelta(minutes=1), dt.timedelta(hours=9))]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "ts timestamp").coalesce(1).write.parquet(str(tmp_path / "late" / f"{k}"))
    stream = spark.readStream.schema("ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    counted = windows.flat(stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "15 minutes").alias("window")).count())
    _run(counted, tmp_path, "late_counts")
    assert [r["count"] for r in spark.table("late_counts").orderBy("window_start").collect()] == [1, 1, 1]


def test_statistics_snapshots(spark, tmp_path):
    trips = synthetic.bikes(spark, 200).select(F.col("trip_no"), (F.rand(1) * 30).alias("average_speed_kmh"), (F.rand(2) * 40).alias("temp_c"), F.lit(5.0).alias("distance_meters"), F.lit(60.0).alias("tripduration"), (F.rand(3) * 6).alias("precip_daily_mm"))
    trips.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(trips.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = sinks.to_snapshots(jobs.statistics(stream)["by_condition"], str(tmp_path / "out"), str(tmp_path / "cp"), "stats", trigger=None)
    _ended(q)
    got = sinks.latest_snapshot(spark.read.parquet(str(tmp_path / "out")))
    assert _rows(got, ["weather_condition", "sample_size"]) == _rows(jobs.statistics(spark.read.parquet(str(tmp_path / "in" / "a")))["by_condition"], ["weather_condition", "sample_size"])


def test_partitioned_and_framed_sinks(spark, tmp_path):
    df = synthetic.taxis(spark, 40).select("trip_no", "price", "datetime_ts")
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src"))
    from skylane.operators.projections import with_calendar

    _ended(sinks.to_partitioned_parquet(with_calendar(stream, "datetime_ts"), str(tmp_path), "taxi", "taxi_raw", trigger=None))
    assert spark.read.parquet(str(tmp_path / "taxi")).where("month = 1").count() == 40
    _ended(sinks.to_framed(stream.select("trip_no", "price"), "topic", 9, str(tmp_path / "cpf"), "framed", path=str(tmp_path), trigger=None))
    back = jobs.decoded(jobs.read_topic(spark, "topic", path=str(tmp_path)), "trip_no long, price double")
    _run(back, tmp_path, "framed_back")
    assert _rows(spark.table("framed_back"), ["trip_no", "price"]) == _rows(df, ["trip_no", "price"])


def test_analytics_table_and_complete_framed_sinks(spark, tmp_path):
    df = synthetic.taxis(spark, 1200).select("trip_no", "cab_type", "price")
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src"))
    assert _ended(sinks.to_analytics_parquet(stream, str(tmp_path), "rides", trigger=None)).name == "analytics_rides"
    assert spark.read.parquet(str(tmp_path / "rides")).count() == 1200
    _ended(sinks.to_table(stream, "ride_table", str(tmp_path / "cpt"), "table", trigger=None))
    files_of = spark.table("ride_table").inputFiles()
    assert spark.table("ride_table").count() == 1200 and len(files_of) == 3  # 500 rows a file
    spark.sql("DROP TABLE ride_table")
    counted = stream.groupBy("cab_type").agg(F.count("*").alias("n"))
    for mode in ("complete", "update"):
        _ended(sinks.to_framed(counted, f"counts_{mode}", 7, str(tmp_path / f"cp_{mode}"), mode, path=str(tmp_path), mode=mode, trigger=None))
        back = jobs.decoded(sinks.latest_snapshot(spark.read.parquet(str(tmp_path / f"counts_{mode}"))), "cab_type string, n long")
        assert _rows(back, ["cab_type", "n"]) == _rows(df.groupBy("cab_type").agg(F.count("*").alias("n")), ["cab_type", "n"])


def test_offsets_count_once_on_a_stream(spark, tmp_path):
    rows = [(k // 2, dt.datetime(2024, 1, 1, 0, 0, k // 2)) for k in range(20)]
    spark.createDataFrame(rows, "offset long, ts timestamp").withColumn("partition", F.lit(0)).coalesce(1).write.parquet(str(tmp_path / "o"))
    stream = spark.readStream.schema("offset long, ts timestamp, partition int").parquet(str(tmp_path / "o"))
    _run(sinks.dedupe_offsets(stream, "ts"), tmp_path, "offsets_once")
    assert sorted(r.offset for r in spark.table("offsets_once").collect()) == list(range(10))


def test_sessions_and_settings(spark):
    assert jobs.session_settings(3)["spark.sql.shuffle.partitions"] == "3"
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t + dt.timedelta(minutes=m)) for m in (0, 5, 9, 40, 44)], "k string, ts timestamp")
    got = windows.flat(windows.session_counts(df, ["k"], "ts", "10 minutes")).orderBy("window_start").collect()
    assert [(r.n, r.window_end - r.window_start) for r in got] == [(3, dt.timedelta(minutes=19)), (2, dt.timedelta(minutes=14))]


def test_frames(spark):
    value = wire.encode(spark.createDataFrame([(1, None, "é")], "a int, b double, c string"), 258)
    raw = bytes(value.first().value)
    assert raw[:5] == b"\x00\x00\x00\x01\x02"
    assert value.select(wire.schema_id_of(F.col("value"))).first()[0] == 258
    broken = spark.createDataFrame([(bytearray(raw),), (bytearray(b"\x01" + raw[1:]),), (bytearray(b"\x00\x01"),), (None,)], "value binary")
    got = [r.data for r in wire.decode(broken, "a int, b double, c string").collect()]
    assert got[0].asDict() == {"a": 1, "b": None, "c": "é"} and got[1:] == [None, None, None]
    assert wire.has_avro(spark) in (True, False)


def test_avro_contract_texts():
    record = json.loads(contracts.avro_schema("bike-data"))
    assert [f["name"] for f in record["fields"]][:2] == ["tripduration", "starttime"] and record["fields"][-1]["type"] == "int"


def test_live_buckets_count_offsets_once(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(0, k // 2, t + dt.timedelta(seconds=k // 2)) for k in range(40)]
    df = spark.createDataFrame(rows, "partition int, offset long, ts timestamp")
    out = sinks.live_buckets(df, "ts", "5 seconds", [F.count("*").alias("n")], keep=3).collect()
    assert [r.n for r in out] == [5, 5, 5] and out[0].window.start == t + dt.timedelta(seconds=5)


def test_a_failing_query_stops_its_group():
    class Query:
        def __init__(self, fail):
            self.fail, self.stopped = fail, False

        def awaitTermination(self, *_):  # noqa: N802  Spark's name
            if self.fail:
                raise RuntimeError("failed")
            return False  # the first one runs on

        def stop(self):
            self.stopped = True

    one, two = Query(False), Query(True)
    with pytest.raises(RuntimeError):
        sinks.run_group({"one": lambda: one, "two": lambda: two, "off": lambda: pytest.fail("disabled")}, {"off": False})
    assert one.stopped and two.stopped
