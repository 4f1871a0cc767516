"""The stream of all sources into stored tables and analytics equals the batch results."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skylane.functions import weather
from skylane.operators.windows import combined_windows
from skylane.sources.adapters import adapt
from skylane.streaming import fanout

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def tables(spark):
    events = spark.read.parquet(EVENTS).where("ts < '2024-01-12'")
    out = {n: adapt(events, t, zoned=True) for n, t in (("bike_trips", "bike_trips"), ("taxi_trips", "taxi_rides"), ("weather_data", "weather_raw"), ("accidents", "accidents"))}
    return {**out, "weather_data": weather.enrich_weather(out["weather_data"])}


def _rows(df):
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((str(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect()))


def test_all_outputs_equal_batch_results_and_one_that_fails_catches_up(spark, tables, tmp_path, monkeypatch):
    """Two batches share all their hours, as rows are dealt by parity. One analysis fails in the first batch; one is switched off."""
    streams, total = {}, 0
    for name, df in tables.items():
        number = df.columns[0]  # trip_no, obs_no, accident_no
        for k in range(2):
            df.where(F.col(number) % 2 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{name}/{k}")
        total += df.count()
        streams[name] = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{name}")
    plain, calls = fanout.ANALYSES["precipitation_impact"], []

    def failing(t):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("once")
        return plain.build(t)

    monkeypatch.setitem(fanout.ANALYSES, "precipitation_impact", fanout.Analysis(failing))
    root = str(tmp_path / "out")
    q = fanout.start_fanout(streams, root, str(tmp_path / "cp"), enabled={"multi_variable_summary": False}, tie="obs_no", trigger=None)
    try:
        assert q.awaitTermination(600)
    finally:
        q.stop()
    assert len(calls) == 2 and [p["batchId"] for p in q.recentProgress if p["numInputRows"]] == [0, 1]
    assert sum(p["numInputRows"] for p in q.recentProgress) == total  # each source is read once
    for name, df in tables.items():
        assert _rows(fanout.result(spark, root, name)) == _rows(df)
    whole = {**tables, "combined": combined_windows(tables["bike_trips"], tables["taxi_trips"], tables["weather_data"], tie="obs_no").persist()}
    for name, analysis in fanout.ANALYSES.items():
        got = fanout.result(spark, root, name)
        if name == "multi_variable_summary":
            assert got is None
        else:
            assert _rows(got) == _rows(analysis.build(whole)), name
    whole["combined"].unpersist()


def test_all_sources_are_needed(spark):
    with pytest.raises(ValueError):
        fanout.start_fanout({"accidents": spark.range(1)}, "out", "cp")
