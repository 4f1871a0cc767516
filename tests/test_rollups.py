"""Statistics and panels from stored cells against the same over all trips."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skylane.operators import panels, percentiles, rollups, stats
from skylane.plans.queries import QUERIES
from skylane.sources.stored import delete, stored
from skylane.streaming.ledger import Ledger

SF = "/root/testdata/sf0.001"
PAIRS = [(rollups.overall, stats.overall), (rollups.by_condition, stats.by_condition), (rollups.by_temperature, stats.by_temperature), (rollups.by_precipitation, stats.by_precipitation)]


def _trips(spark, n, days=3):
    t = spark.range(n).select(
        F.col("id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id") % days, F.col("id") % 24)).alias("starttime"),
        (1e6 + F.abs(F.randn(1)) * 9).alias("average_speed_kmh"), F.when(F.col("id") % 7 > 0, F.rand(2) * 50 - 10).alias("temp_c"), (F.rand(3) * 9000).alias("distance_meters"),
        (F.rand(4) * 4000).alias("tripduration"), F.when(F.rand(5) < 0.5, 0.0).otherwise(F.rand(6) * 9).alias("precip_daily_mm"),
    )
    t = t.withColumn("stoptime", F.col("starttime") + F.make_dt_interval(secs=F.col("tripduration")))
    return t.withColumn("weather_condition", F.when(F.col("id") % 3 == 0, "good").otherwise("poor"))


def _same(got, want, skip=()):
    got, want = got.collect(), {tuple(v for v in r if isinstance(v, str)): r for r in want.collect()}
    assert len(got) == len(want)
    for r in got:
        w = want[tuple(v for v in r if isinstance(v, str))]
        assert set(r.asDict()) == set(w.asDict())
        for c in set(r.asDict()) - set(skip):
            assert r[c] == w[c] or r[c] == pytest.approx(w[c], rel=1e-6), (c, r[c], w[c])


def _sketched(df):
    return [c for c in df.columns if c.startswith(("median", "p25", "p75", "iqr"))]


@pytest.mark.parametrize("merged, plain", PAIRS)
def test_merged_statistics_equal_those_over_all_rows(spark, tmp_path, merged, plain):
    """Each day added as a batch of its own, one day in two batches; few values, so sketches are exact. Speeds lie far from 0."""
    trips = _trips(spark, 3000)
    trips.write.parquet(str(tmp_path / "t"))
    trips, ledger = spark.read.parquet(str(tmp_path / "t")), Ledger(spark, str(tmp_path / "cells"))
    parts = [trips.where("dayofmonth(starttime) = 1"), trips.where("dayofmonth(starttime) = 2 and id % 2 = 0"), trips.where("dayofmonth(starttime) = 2 and id % 2 = 1"), trips.where("dayofmonth(starttime) = 3")]
    for k, part in enumerate(parts):
        before = {r.folder for r in ledger.records()}
        assert rollups.add_trips(ledger, part, k) and not rollups.add_trips(ledger, part, k)
        assert before < {r.folder for r in ledger.records()}  # old cells stay as they are
    want = plain(trips)
    _same(merged(ledger.read()), want)
    ledger.merge()
    _same(merged(ledger.read()), want)


def test_percentiles_stay_within_the_sketch_error(spark):
    trips = _trips(spark, 200_000, days=40)
    got = rollups.overall(rollups.statistics_cells(trips)).first()
    for name, column in (("median_speed", "average_speed_kmh"), ("p25_speed", "average_speed_kmh"), ("p75_speed", "average_speed_kmh"), ("median_distance", "distance_meters"), ("median_temp", "temp_c")):
        share = trips.where(F.col(column).isNotNull()).agg(F.avg((F.col(column) <= got[name]).cast("int"))).first()[0]
        assert abs(share - {"m": 0.5, "p25": 0.25, "p75": 0.75}[name[:3] if name[0] == "p" else "m"]) < 2 / 1500


@pytest.mark.parametrize("merged, plain", PAIRS)
def test_few_values_no_spread_and_nulls(spark, merged, plain):
    trips = _trips(spark, 4)
    odd = trips.withColumns({"average_speed_kmh": F.lit(5.0), "temp_c": F.lit(None).cast("double"), "distance_meters": F.when(F.col("id") == 1, 3.0)})
    for df in (trips.limit(1), odd, trips.where("false")):
        _same(merged(rollups.statistics_cells(df)), plain(df))


PANELS = ["time_range", "trips_by_hour", "precipitation_panel", "temperature_and_speed", "speed_histogram", "distance_histogram"]


@pytest.mark.parametrize("name", PANELS)
def test_panels_from_cells_equal_panels_over_trips(spark, name):
    trips = _trips(spark, 2000).withColumn("average_speed_kmh", F.when(F.col("id") % 11 == 0, 0.0).when(F.col("id") % 13 > 0, F.abs(F.randn(9)) * 25))
    rows = lambda df: [tuple(round(v, 2) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in df.collect()]
    cells = rollups.panel_cells(trips.where("id < 900")).unionByName(rollups.panel_cells(trips.where("id >= 900")))
    assert rows(getattr(rollups, name)(cells)) == rows(getattr(panels, name)(trips))
    assert rows(getattr(rollups, name)(cells.where("false"))) == rows(getattr(panels, name)(trips.where("false")))


def test_panels_read_cells_and_join_nothing(spark):
    for name in ("sql_trips_by_hour", "sql_speed_hist", "sql_precip_impact", "sql_temp_vs_speed", "sql_distance_hist", "sql_time_range"):
        panel = QUERIES[name](spark, SF)
        assert "Join" not in panel._jdf.queryExecution().executedPlan().toString()
        assert panel.inputFiles() and all("/panel_cells-" in f for f in panel.inputFiles())


def test_stored_tables_follow_their_source(spark, tmp_path):
    path, built = str(tmp_path / "s"), []

    def table():
        def build():
            built.append(1)
            return spark.read.parquet(path).agg(F.sum("id").alias("s"))

        return stored(spark.read.parquet(path), "sums", build)

    spark.range(4).coalesce(1).write.parquet(path)
    assert table().first().s == 6 and table().first().s == 6 and len(built) == 1
    spark.range(9, 10).coalesce(1).write.mode("append").parquet(path)
    assert table().first().s == 15 and len(built) == 2
    files = table().inputFiles()
    delete(spark, f"{files[0].rsplit('/', 1)[0]}/_SUCCESS")  # as a failure leaves it
    assert table().first().s == 15 and len(built) == 3


def _least_at(values, q):
    """The smallest value with a share of q at or below it."""
    values = sorted(v for v in values if v is not None)
    return values[max(1, math.ceil(q * len(values))) - 1] if values else None


def test_percentiles_of_many_values_are_exact(spark, tmp_path):
    trips = _trips(spark, 60_000, days=40).withColumn("weather_condition", F.when(F.col("id") % 3 == 0, "fair").otherwise(F.when(F.col("id") % 2 == 0, "good").otherwise("poor")))
    trips = trips.withColumn("average_speed_kmh", F.when(F.col("id") % 5 == 0, 7.0).otherwise(F.col("average_speed_kmh")))
    trips.write.parquet(str(tmp_path / "t"))
    trips = spark.read.parquet(str(tmp_path / "t"))
    rows = trips.collect()
    values = rollups.statistics_values(trips.where("id < 900")).unionByName(rollups.statistics_values(trips.where("id >= 900")))
    cells = rollups.statistics_cells(trips)
    asked = {"median_speed": ("average_speed_kmh", 0.5), "p25_speed": ("average_speed_kmh", 0.25), "p75_speed": ("average_speed_kmh", 0.75)}
    for by, plain, merged in ((None, stats.overall, rollups.overall), ("weather_condition", stats.by_condition, rollups.by_condition)):
        more = {} if by else {"median_temp": ("temp_c", 0.5), "median_distance": ("distance_meters", 0.5), "median_duration": ("tripduration", 0.5)}
        for got in (plain(trips).collect(), merged(cells, values).collect()):
            assert len(got) == (3 if by else 1)
            for r in got:
                group = [x for x in rows if by is None or x[by] == r[by]]
                for alias, (column, q) in {**asked, **more}.items():
                    assert r[alias] == _least_at([x[column] for x in group], q), (by, alias)


@pytest.mark.parametrize("merged, plain", PAIRS)
def test_exact_percentiles_of_few_values_no_spread_and_nulls(spark, merged, plain):
    trips = _trips(spark, 4)
    odd = trips.withColumns({"average_speed_kmh": F.lit(5.0), "temp_c": F.lit(None).cast("double"), "distance_meters": F.when(F.col("id") == 1, 3.0)})
    for df in (trips.limit(1), odd, trips.where("false")):
        _same(merged(rollups.statistics_cells(df), rollups.statistics_values(df)), plain(df))


def test_percentiles_are_exact_whatever_boundaries_each_estimate_gives(spark, monkeypatch):
    """Sketches of the same values may differ from one evaluation to the next; here each gives boundaries of its own."""

    @F.udf("array<double>")
    def some(values):
        return sorted(random.sample(values, percentiles.PARTS - 1))

    monkeypatch.setattr(percentiles.F, "percentile_approx", lambda c, *_: some(F.collect_list(c)))
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.hash("id") % 900).cast("double").alias("x"))
    held = rows.collect()
    qs = {f"p{q}": q / 100 for q in range(0, 101, 5)}
    got = percentiles.exact_percentiles(percentiles.value_counts(rows, ["k"], {"x": "x"}), ["k"], {a: ("x", q) for a, q in qs.items()}).collect()
    assert len(got) == 3
    for r in got:
        assert r.asDict() == {"k": r.k, **{a: _least_at([h.x for h in held if h.k == r.k], q) for a, q in qs.items()}}
