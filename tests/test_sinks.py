"""Sinks that hold each row once, whatever fails between their writes and commits."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skylane.streaming import sinks
from skylane.streaming.ledger import Ledger


def _source(spark, path, parts):
    """A stream of one file a batch; part ``k`` holds ids ``10 k`` to ``10 k + 9``."""
    for k in range(parts):
        spark.range(10 * k, 10 * k + 10).select("id", (F.col("id") % 4).alias("key")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{k:03d}")
    return spark.readStream.schema("id long, key long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))


def _ended(q):
    try:
        assert q.awaitTermination(180), f"{q.name} still runs"
    finally:
        q.stop()


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_table_holds_each_row_once_after_failures(spark, tmp_path):
    """The first run dies after the second batch is in the table and before the query has committed it."""
    spark.sql("DROP TABLE IF EXISTS once_only")
    stream, fail = _source(spark, tmp_path / "in", 3), {"at": 1}

    def failing(batch, number):
        plain(batch, number)
        if number == fail["at"]:
            raise RuntimeError("lost")

    class Writer:  # hands the sink's own function to the real writer, with a failure behind it
        def __init__(self, writer):
            self.writer = writer

        def __getattr__(self, name):
            return getattr(self.writer, name)

        def foreachBatch(self, f):  # noqa: N802
            nonlocal plain
            plain = f
            return self.writer.foreachBatch(failing)

    class Frame:
        writeStream = property(lambda self: Writer(stream.writeStream))  # noqa: N815

    plain = None
    with pytest.raises(Exception, match="lost"):
        _ended(sinks.to_table(Frame(), "once_only", str(tmp_path / "cp"), "once", trigger=None, rows_per_file=4))
    assert _ids(spark.table("once_only")) == list(range(20))  # the batch is there, the query does not know
    fail["at"] = None
    _ended(sinks.to_table(stream, "once_only", str(tmp_path / "cp"), "once", trigger=None, rows_per_file=4))
    assert _ids(spark.table("once_only")) == list(range(30))
    assert len(spark.table("once_only").inputFiles()) == 9  # 4 + 4 + 2 rows a batch
    assert spark.table("once_only").where("_query is not null").select("_query").distinct().count() == 1
    # Another query with a checkpoint of its own counts its batches from 0 again and replaces nothing.
    _ended(sinks.to_table(stream, "once_only", str(tmp_path / "cp2"), "twice", trigger=None))
    assert _ids(spark.table("once_only")) == sorted([*range(30)] * 2)
    spark.sql("DROP TABLE once_only")


@pytest.mark.parametrize("lost_after", ["data", "record"])
def test_a_ledger_holds_each_row_once_after_failures(spark, tmp_path, monkeypatch, lost_after):
    stream, path, record = _source(spark, tmp_path / "in", 3), str(tmp_path / "out"), Ledger._record

    def failing(self, r):
        if lost_after == "record":
            record(self, r)
        if r.last == 1:
            raise RuntimeError("lost")
        if lost_after == "data":
            record(self, r)

    monkeypatch.setattr(Ledger, "_record", failing)
    with pytest.raises(Exception, match="lost"):
        _ended(sinks.to_ledger(stream, path, str(tmp_path / "cp"), "ledger", trigger=None))
    seen = 20 if lost_after == "record" else 10
    assert _ids(Ledger(spark, path).read()) == list(range(seen))
    monkeypatch.setattr(Ledger, "_record", record)
    _ended(sinks.to_ledger(stream, path, str(tmp_path / "cp"), "ledger", trigger=None))
    rows = Ledger(spark, path).read()
    assert _ids(rows) == list(range(30)) and {r._batch for r in rows.select("_batch").distinct().collect()} == {0, 1, 2}
    assert Ledger(spark, path).drop_replaced() == 0  # too young
    assert Ledger(spark, path).drop_replaced(older_than=0) == (1 if lost_after == "data" else 0)
    assert _ids(Ledger(spark, path).read()) == list(range(30))


def test_changes_merge_to_the_complete_result(spark, tmp_path):
    """Update mode over five batches, merged after the third, equals the aggregate over all rows."""
    path, want = str(tmp_path / "out"), lambda n: {k: sum(1 for i in range(n) if i % 4 == k) for k in range(4)}
    count = lambda s: s.groupBy("key").agg(F.count("*").alias("n"))
    for parts in (3, 5):
        stream = _source(spark, tmp_path / "in", parts) if parts == 3 else stream
        for k in range(3, parts):
            spark.range(10 * k, 10 * k + 10).select("id", (F.col("id") % 4).alias("key")).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
        _ended(sinks.to_ledger(count(stream), path, str(tmp_path / "cp"), "changes", trigger=None, mode="update"))
        ledger = Ledger(spark, path)
        assert {r.key: r.n for r in ledger.latest(["key"]).collect()} == want(10 * parts)
        held = ledger.read()  # a reader that started before the merge
        ledger.merge(["key"])
        assert len(ledger.records()) == 1 and ledger.read().count() == 4
        assert {r.key: r.n for r in ledger.latest(["key"]).collect()} == want(10 * parts)
        assert held.count() > 4
    assert ledger.drop_replaced(older_than=0) > 0 and {r.key: r.n for r in ledger.latest(["key"]).collect()} == want(50)


def test_ledger_of_batches_by_hand(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    assert ledger.read() is None and ledger.latest(["id"]) is None and ledger.records() == []
    ledger.merge()
    assert ledger.add(spark.range(3).toDF("id"), 0) and not ledger.add(spark.range(9).toDF("id"), 0)
    assert ledger.add(spark.range(2).select("id", F.lit("x").alias("more")), 1)  # a column that came later
    assert ledger.add(spark.range(0).toDF("id"), 2)  # an empty batch has its record too
    got = sorted((r.id, r.more or "", r._batch) for r in ledger.read().collect())
    assert got == [(0, "", 0), (0, "x", 1), (1, "", 0), (1, "x", 1), (2, "", 0)]
    ledger.merge()
    assert sorted((r.id, r.more or "", r._batch) for r in ledger.read().collect()) == got
    assert not ledger.add(spark.range(9).toDF("id"), 1)  # hidden by the merged record, still known
    assert sorted((r.id, r.more or "") for r in ledger.latest(["id"]).collect()) == [(0, "x"), (1, "x"), (2, "")]


@pytest.mark.parametrize("by", [(), ("kind",)])
def test_live_buckets_on_a_stream_equal_the_batch_form_after_each_batch(spark, tmp_path, by):
    """Repeated offsets, buckets without messages, and far more buckets over time than are kept."""
    start, keep = dt.datetime(2024, 1, 1), 3
    seconds = [[0, 1, 6, 6, 11], [6, 12, 16, 17], [21, 22, 90], [91, 96], [200, 201]]  # 6 s again: its offset is known
    for k, batch in enumerate(seconds):
        rows = [(0, s, start + dt.timedelta(seconds=s), "ab"[s % 2]) for s in batch]
        spark.createDataFrame(rows, "partition int, offset long, ts timestamp, kind string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("partition int, offset long, ts timestamp, kind string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    aggregates, path = [F.count("*").alias("n"), F.max("offset").alias("last")], str(tmp_path / "out")
    q = sinks.to_live_buckets(stream, "ts", "5 seconds", aggregates, path, str(tmp_path / "cp"), "live", keep, by, trigger=None)
    _ended(q)
    inputs = [p["batchId"] for p in q.recentProgress if p["numInputRows"]]
    assert len(inputs) == len(seconds)
    plain = lambda df: sorted((r.window.start, *(r[c] for c in by), r.n, r.last) for r in df.collect())
    for k, n in enumerate(inputs):
        so_far = spark.read.parquet(*[f"{tmp_path}/in/{i}" for i in range(k + 1)])
        assert plain(spark.read.parquet(f"{path}/snapshot={n}")) == plain(sinks.live_buckets(so_far, "ts", "5 seconds", aggregates, keep, by))
    assert plain(sinks.latest_snapshot(spark.read.parquet(path))) == plain(spark.read.parquet(f"{path}/snapshot={inputs[-1]}"))
    held = [max(op["numRowsTotal"] for op in p["stateOperators"] if op["operatorName"] == "stateStoreSave") for p in q.recentProgress if p["stateOperators"]]
    # State's own count may hold an updated row twice. Nine buckets had messages; six at most lie within three of the newest or came since the last eviction.
    assert max(held) <= 2 * 6 * (1 + len(by)) and held[-1] <= 4 * (1 + len(by))
