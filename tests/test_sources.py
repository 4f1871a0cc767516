"""Topics with several schemas, grids of unknown keys, and many CSV files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skylane.sources import files
from skylane.streaming import wire

WRITERS = {1: wire.Writer("a int, b string"), 2: wire.Writer("a long, c double"), 3: wire.Writer("b int, d struct<x: int>")}


def test_unified_fields(spark):
    assert wire.unified(WRITERS).simpleString() == "struct<a:bigint,b:string,c:double,d:struct<x:int>>"
    assert wire.unified({}).simpleString() == "struct<>"


def test_frames_of_several_writers_and_rejects(spark):
    frame = lambda k, body: bytearray(wire.header(k) + body)
    values = [
        frame(1, b'{"a": 1, "b": "x"}'), frame(2, b'{"a": 5000000000, "c": 0.5}'), frame(3, b'{"b": 7, "d": {"x": 1}}'), frame(1, b"{}"),
        frame(4, b'{"a": 1}'), frame(1, b"no json"), bytearray(b"\x01" + bytes(frame(1, b"{}"))[1:]), bytearray(b"\x00\x00"), None, frame(2, b'{"a": "text"}'),
    ]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, value binary")
    decoded = wire.decode_by_id(df, WRITERS)
    rows = {r.k: r for r in decoded.collect()}
    good = {k: tuple(r.data) for k, r in rows.items() if r.problem is None}
    assert good == {0: (1, "x", None, None), 1: (5_000_000_000, None, 0.5, None), 2: (None, "7", None, (1,)), 3: (None, None, None, None)}
    assert {k: r.problem for k, r in rows.items() if r.problem} == {4: wire.UNKNOWN_SCHEMA, 5: wire.BAD_BODY, 6: wire.BAD_FRAME, 7: wire.BAD_FRAME, 8: wire.BAD_FRAME, 9: wire.BAD_BODY}
    assert rows[4].schema_id == 4 and rows[7].schema_id is None and all(r.data is None for r in rows.values() if r.problem)
    records, rejects = wire.records_and_rejects(decoded)
    assert records.columns == ["schema_id", "a", "b", "c", "d"] and records.count() + rejects.count() == len(values)


def test_a_single_schema_compares_its_id(spark):
    df = wire.encode(spark.createDataFrame([(1,)], "a int"), 8).union(wire.encode(spark.createDataFrame([(2,)], "a int"), 9))
    assert [r.data and r.data.a for r in wire.decode(df, "a int", schema_id=9).collect()] == [None, 2]


def test_grid_of_unknown_keys(spark):
    texts = ['{"a": 1, "it\'s": "x"}', '{"a": 2.5, "offset": 3}', '{"b": {"c": [1, 2]}}', "[1]", "no json", None, '{"m": 1}', '{"m": "text", "z": null}', '{"old": 1}']
    df = spark.createDataFrame([(0, len(texts) - k, t) for k, t in enumerate(texts)], "partition int, offset long, value string")
    grid = files.recent_grid(df, len(texts) - 1)  # the oldest message is left out, and its key with it
    assert grid.columns == ["partition", "offset", "a", "b", "it's", "m", "offset_", "z"]
    rows = {r.offset: r for r in grid.collect()}
    assert list(rows) == list(range(len(texts), 1, -1))
    assert float(rows[9].a) == 1 and rows[9]["it's"] == "x" and float(rows[8].a) == 2.5 and rows[8].offset_ == 3 and rows[7].b.c == [1, 2]
    assert (rows[3].m, rows[2].m, rows[2].z) == ("1", "text", None) and all(v is None for k in (4, 5, 6) for v in rows[k][2:])
    assert files.recent_grid(df.where("false"), 5).collect() == []


def test_many_csv_files_of_few_layouts(spark, tmp_path):
    """500 files of three layouts: three scans, and a column's type is the narrowest that its values in all files fit."""
    for k in range(500):
        layout = [f"id,name,at\n{k},n{k},2024-01-0{k % 9 + 1}\n", f"id,weight\n{k},{k}.5\n{k},\\N\n", f'"id","note, long",when\n{k},"a, {k}",2024-01-01 10:00:00\n'][k % 3]
        (tmp_path / f"f{k}.csv").write_text(layout)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text("id,name,at\n")  # a first line alone
    df = files.read_csv_union(spark, [str(tmp_path)])
    assert df.dtypes == [("id", "int"), ("note, long", "string"), ("when", "timestamp"), ("name", "string"), ("at", "date"), ("weight", "double")]
    assert df.count() == 500 + 167 and df.agg(F.countDistinct("id")).first()[0] == 500
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 3
    assert df.where("id = 2").first()["note, long"] == 'a, 2' and df.where("id = 0").first()["at"] == dt.date(2024, 1, 1)
    assert {t for _, t in files.read_csv_union(spark, [str(tmp_path)], infer=False).dtypes} == {"string"}
    (tmp_path / "late.csv").write_text("id,weight\nx,1\n")
    assert dict(files.read_csv_union(spark, [str(tmp_path)]).dtypes)["id"] == "string"
    with pytest.raises(ValueError):
        files.read_csv_union(spark, [str(tmp_path / "empty.csv")])
