from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skylane.operators import joins, panels, projections, windows
from skylane.sources import contracts, files, synthetic

T0 = dt.datetime(2024, 1, 1)


def _times(rng, n, span=20_000):
    return [(k, T0 + dt.timedelta(seconds=rng.randrange(span))) for k in range(n)]


@pytest.fixture
def sides(spark):
    rng = random.Random(3)
    left, right = _times(rng, 60), _times(rng, 40)
    left += [(60, T0), (61, None)]
    right += [(40, T0 + dt.timedelta(seconds=600)), (41, T0 + dt.timedelta(seconds=601)), (42, None), (43, T0 + dt.timedelta(seconds=600))]
    return left, right, spark.createDataFrame(left, "a long, ta timestamp"), spark.createDataFrame(right, "b long, tb timestamp")


def _gap(x, y):
    return abs((x - y).total_seconds())


def test_interval_join_equals_nested_loops(sides):
    left, right, dl, dr = sides
    want = sorted((a, b) for a, x in left for b, y in right if x and y and _gap(x, y) <= 600)
    assert sorted((r.a, r.b) for r in joins.within_interval(dl, dr, "ta", "tb", 600).collect()) == want
    kept = joins.within_interval(dl, dr, "ta", "tb", 600, how="left").collect()
    matched = {a for a, _ in want}
    assert sorted((r.a, r.b) for r in kept if r.b is not None) == want
    assert sorted(r.a for r in kept if r.b is None) == sorted(a for a, _ in left if a not in matched)


def test_nearest_equals_nested_loops(sides):
    left, right, dl, dr = sides
    want = {}
    for a, x in left:
        near = [(_gap(x, y), y, b) for b, y in right if x and y and _gap(x, y) <= 600]
        want[a] = min(near)[2] if near else None
    got = {r.a: r.b for r in joins.nearest_in_time(dl, dr, "ta", "tb", "b", 600, how="left").collect()}
    assert got == want
    inner = {r.a: r.b for r in joins.nearest_in_time(dl, dr, "ta", "tb", "b", 600).collect()}
    assert inner == {a: b for a, b in want.items() if b is not None}


def test_interval_join_has_an_equality_key(sides):
    _, _, dl, dr = sides
    plan = joins.within_interval(dl, dr, "ta", "tb", 600)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_moves_rows_and_no_pairs(spark, how):
    """Rows of one moment all meet; what is shuffled is the rows, whatever the number of pairs. Equal left rows stay apart."""
    at = F.lit(T0).cast("timestamp")
    left = spark.range(300).select((F.col("id") % 100).alias("a"), F.when(F.col("id") < 290, at).alias("ta"))
    right = spark.range(200).select(F.col("id").alias("b"), (at + F.make_dt_interval(secs=F.col("id") * 6)).alias("tb"))
    df = joins.within_interval(left, right, "ta", "tb", 600, how)
    rows = [(r.a, r.b) for r in df.collect()]
    want = [(a % 100, b) for a in range(290) for b in range(101)] + [(a % 100, None) for a in range(290, 300) if how == "left"]
    assert sorted(rows, key=str) == sorted(want, key=str)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above, probe = plan[: plan.index("Join ")], plan[plan.index("Join ") :].split("+- ", 1)[0]
    assert "Window" not in plan and "Aggregate" not in above and plan.count("Generate ") == 1 and "Generate " not in probe


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_in_parts_equals_nested_loops(sides, monkeypatch, how):
    monkeypatch.setattr(joins, "CROWD", 3, raising=False)
    left, right, dl, dr = sides
    want = [(a, b) for a, x in left for b, y in right if x and y and _gap(x, y) <= 600]
    want += [(a, None) for a, _ in left if how == "left" and a not in {p for p, _ in want}]
    got = joins.within_interval(dl, dr, "ta", "tb", 600, how)
    assert got.columns == ["a", "ta", "b", "tb"] and sorted(((r.a, r.b) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_deals_a_crowded_moment_to_several_tasks(spark, monkeypatch, how):
    """All rows stand within one bucket: no task joins all of them, and none holds more than parts of them."""
    monkeypatch.setattr(joins, "CROWD", 50, raising=False)
    at = F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 60)
    left, right = spark.range(400).select(F.col("id").alias("a"), at.alias("ta")), spark.range(300).select(F.col("id").alias("b"), at.alias("tb"))
    df = joins.within_interval(left, right, "ta", "tb", 600, how)
    tasks = df.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("a", "b").alias("pairs")).collect()
    assert sum(r.n for r in tasks) == sum(r.pairs for r in tasks) == 400 * 300 and max(r.n for r in tasks) < 400 * 300 / 2


def test_interval_join_gives_pairs_of_a_crowd_in_an_order_that_files_pack(spark, monkeypatch, tmp_path):
    """All pairs grow with the square, so what a pair takes on disk counts: left rows come again in short runs of the same order."""
    monkeypatch.setattr(joins, "CROWD", 3000)
    at = F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 60)
    left, right = spark.range(1000).select(F.col("id").alias("a"), at.alias("ta")), spark.range(6000).select(F.col("id").alias("b"), at.alias("tb"))
    joins.within_interval(left, right, "ta", "tb", 600).select("a", "b").write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.count() == pairs.distinct().count() == 1000 * 6000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 1000 * 6000


def test_range_read_pushes_its_filter(spark, tmp_path):
    df = synthetic.taxis(spark, 500)
    files.write_sorted(df, str(tmp_path / "t"), "datetime_ts")
    out = files.read_range(spark, str(tmp_path / "t"), "datetime_ts", "2024-01-02", "2024-01-03", ordered=True)
    assert "PushedFilters: [IsNotNull(datetime_ts), GreaterThanOrEqual" in out._jdf.queryExecution().toString()
    ts = [r.datetime_ts for r in out.collect()]
    assert ts and ts == sorted(ts)
    a = files.read_range(spark, str(tmp_path / "t"), "datetime_ts", ts[0], ts[5], half_open=True).count()
    b = files.read_range(spark, str(tmp_path / "t"), "datetime_ts", ts[5], ts[9], half_open=True).count()
    assert a + b == files.read_range(spark, str(tmp_path / "t"), "datetime_ts", ts[0], ts[9], half_open=True).count()


def test_synthetic_rows_repeat_for_a_seed(spark):
    assert synthetic.bikes(spark, 50, seed=4).collect() == synthetic.bikes(spark, 50, seed=4).collect()
    assert synthetic.weather(spark, 10).count() == 10


def test_csv_union_and_coalesced_layout(spark, tmp_path):
    (tmp_path / "old.csv").write_text("tripduration,starttime,stoptime,start station id,usertype,birth year,gender\n100,2018-01-01 08:00:00,2018-01-01 08:01:40,7,Subscriber,1980,1\n\\N,2018-01-01 09:00:00,2018-01-01 09:00:30,8,\\N,\\N,0\n")
    (tmp_path / "new.csv").write_text("ride_id,started_at,ended_at,start_station_id,start_lat,member_casual\nx1,2023-01-01 08:00:00,2023-01-01 08:02:00,A7,42.5,member\n")
    raw = files.read_csv_union(spark, [str(tmp_path / "old.csv"), str(tmp_path / "new.csv")])
    rows = {r["start station id"]: r for r in projections.coalesced_trips(raw).collect()}
    assert rows["7"].tripduration == 100.0 and rows["8"].tripduration == 30.0 and rows["A7"].tripduration == 120.0
    assert rows["A7"]["start station latitude"] == 42.5 and rows["A7"].usertype == "member" and rows["A7"].bikeid == "x1"
    record = projections.record_bikes(projections.coalesced_trips(raw)).where("start_station_id = '8'").first()
    assert (record.usertype, record.birth_year, record.gender) == ("Unknown", 0, 0)


def test_timestamps_of_both_formats(spark):
    df = spark.createDataFrame([("2018-01-01 08:00:00",), ("2018-01-01T08:00:00",), ("2018-01-01 08:00:00.5000",), ("x",), (None,), ("1514793600",)], "t string")
    got = [r[0] for r in df.select(projections.timestamp_of(F.col("t"), epoch=True)).collect()]
    at = dt.datetime(2018, 1, 1, 8)
    assert got == [at, at, at + dt.timedelta(milliseconds=500), None, None, at]


def test_weather_and_taxi_records(spark):
    w = spark.createDataFrame([("+0056,1", "+9999,9", None, None, "016000,1", "24", 15)], "TMP string, DEW string, WND string, CIG string, VIS string, X string, PRECIP_DAILY_MM int")
    r = projections.record_weather(w).first()
    assert (r.dry_bulb_temperature_celsius, r.dew_point_temperature_celsius, r.wind_observation, r.precip_daily_mm) == (5.6, 0.0, "", 1.5)
    t = spark.createDataFrame([("NA", 212.0, None, None)], "price string, temperature double, cab_type string, hour int")
    r = projections.record_taxis(t).first()
    assert (r.price, r.temperature, r.cab_type, r.hour) == (0.0, 100.0, "Unknown", 0)


def test_daily_precipitation_is_carried_forward(spark):
    rows = [("s", "1", "24,0012,1"), ("s", "2", "06,0001"), ("s", "3", None), ("s", "4", "24,0030,9"), ("u", "1", None)]
    df = projections.daily_precipitation(spark.createDataFrame(rows, "STATION string, DATE string, AA1 string"))
    assert [r.PRECIP_DAILY_MM for r in df.orderBy("STATION", "DATE").collect()] == [12, 12, 12, 30, None]


def test_conform_pads_with_typed_nulls(spark):
    out = projections.conform(spark.createDataFrame([("5", 1)], "temp_c string, extra int"), contracts.schema("bike-weather-distance"))
    assert out.schema.fieldNames() == contracts.schema("bike-weather-distance").fieldNames() and out.first().temp_c == 5.0 and out.first().starttime is None
    assert out.schema["average_speed_kmh"].dataType.simpleString() == "double"


def test_normalised_names_keep_the_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a b", "a.b", "c"])
    out = projections.normalised_names(df)
    assert out.columns == ["a_b", "c"] and out.first().a_b == 1


def test_parsers_set_calendar_and_rename(spark):
    raw = spark.createDataFrame([(61.7, "2018-03-04T05:06:07", "2018-03-04 05:07:08", "7", "Subscriber")], "tripduration double, starttime string, stoptime string, start_station_id string, usertype string")
    r = projections.parse_bikes(raw).first()
    assert (r.duration_seconds, r.user_type, r.year, r.month, r.date, r.hour) == (61, "Subscriber", 2018, 3, "2018-03-04", 5)
    acc = spark.createDataFrame([("2018-03-04 05:06:07", "mv", "1.5", "x", "42", "-71")], "dispatch_ts string, mode_type string, x_cord string, y_cord string, lat string, long string")
    r = projections.parse_accidents(acc).first()
    assert (r.x_cord, r.y_cord, r.lat, r.hour) == (1.5, None, 42.0, 5)


def test_contracts_have_all_fields():
    assert len(contracts.TOPICS) == 10 and len(contracts.schema("weather-transport-statistics-overall")) == 25
    assert contracts.FIELDS["bike-data"][0] == ("tripduration", "double") and contracts.schema("weather-data")["station_id"].dataType.simpleString() == "bigint"


def test_sql_accepts_reading_statements_only(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert panels.answer(spark, "SELECT count(*) AS n FROM three;") == {"status": "success", "columns": ["n"], "data": [[3]], "row_count": 1, "truncated": False}
    cut = panels.answer(spark, "SELECT * FROM three", most_rows=2)
    assert cut["row_count"] == 2 and cut["truncated"]
    for bad in ("DROP VIEW three", "create table x(a int)", "insert into three values (1)"):
        with pytest.raises(ValueError, match="reading"):
            panels.sql(spark, bad)
    assert panels.sql(spark, "-- note\nSHOW TABLES ;").count() >= 1


def test_topic_sample_and_grid(spark):
    df = spark.createDataFrame([(0, k, f'{{"k": {k}}}') for k in range(9)], "partition int, offset long, value string")
    assert [r.offset for r in files.topic_sample(df, 3).collect()] == [6, 7, 8]
    assert [(r.offset, r.k) for r in files.recent_grid(df, 2, "k int").collect()] == [(8, 8), (7, 7)]


def test_databases_and_external_tables_come_and_go(spark, tmp_path):
    panels.define(spark, "CREATE DATABASE IF NOT EXISTS smoke;")
    spark.range(4).write.parquet(str(tmp_path / "t"))
    panels.define(spark, f"CREATE TABLE smoke.t (id BIGINT) USING parquet LOCATION '{tmp_path / 't'}'")
    assert panels.sql(spark, "SELECT count(*) AS n FROM smoke.t").first().n == 4
    described = {r.col_name.strip(): r.data_type for r in panels.sql(spark, "DESCRIBE FORMATTED smoke.t").collect()}
    assert described["id"] == "bigint" and described["Type"] == "EXTERNAL"
    panels.define(spark, "DROP TABLE smoke.t")
    panels.define(spark, "DROP DATABASE smoke")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    with pytest.raises(ValueError, match="CREATE and DROP"):
        panels.define(spark, "INSERT INTO t VALUES (1)")


def test_nearest_makes_no_pairs(sides):
    _, _, dl, dr = sides
    out = joins.nearest_in_time(dl.union(dl), dr, "ta", "tb", "b", 600)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "NestedLoop" not in plan
    assert out.count() == 2 * joins.nearest_in_time(dl, dr, "ta", "tb", "b", 600).count()
    assert joins.neighbours_in_time(dl, dr, "ta", "tb", "b", 600).count() == dl.count()


def test_forward_fill_over_days_and_null_keys(spark):
    day = lambda k: T0 + dt.timedelta(hours=9 * k)
    rows = [("a", 0, day(0), 1.0), ("a", 1, day(1), None), ("a", 2, day(4), None), ("a", 3, day(9), None), ("a", 4, day(9), 7.0), (None, 5, day(2), 3.0), (None, 6, day(5), None), ("b", 7, day(1), None)]
    df = spark.createDataFrame(rows, "k string, n long, ts timestamp, v double")
    out = windows.forward_fill(df, ["k"], "ts", "v", "filled", "n")
    assert {r.n: r.filled for r in out.collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 7.0, 5: 3.0, 6: 3.0, 7: None}
