"""Stream sinks: partitioned and analytics Parquet, snapshots of complete results, framed records, live buckets."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skylane.sources.stored import delete
from skylane.streaming import wire
from skylane.streaming.ledger import Ledger

_log = logging.getLogger(__name__)

#: Trigger intervals of the jobs (fixed values).
JOIN_TRIGGER, ANALYTICS_TRIGGER, STATISTICS_TRIGGER = "1 second", "10 seconds", "30 seconds"


def _start(writer, trigger: str | None) -> StreamingQuery:
    """Start with a processing-time trigger, or once over all that is there (``None``)."""
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()


def to_partitioned_parquet(df: DataFrame, root: str, folder: str, name: str, trigger: str | None = ANALYTICS_TRIGGER, by=("year", "month", "date", "hour")) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").partitionBy(*by).queryName(name)
    return _start(writer.option("path", f"{root}/{folder}").option("checkpointLocation", f"{root}/_checkpoints/{folder}"), trigger)


def to_analytics_parquet(df: DataFrame, root: str, folder: str, name: str | None = None, trigger: str | None = ANALYTICS_TRIGGER) -> StreamingQuery:
    """Unpartitioned Parquet, append only. The query is named ``analytics_<folder>`` unless a name is given."""
    writer = df.writeStream.format("parquet").outputMode("append").queryName(name or f"analytics_{folder}")
    return _start(writer.option("path", f"{root}/{folder}").option("checkpointLocation", f"{root}/_checkpoints/{folder}"), trigger)


def to_framed(df: DataFrame, topic: str, schema_id: int, checkpoint: str, name: str, servers: str | None = None, path: str | None = None, mode: str = "append", trigger: str | None = JOIN_TRIGGER, avro: str | None = None) -> StreamingQuery:
    """Framed records to a Kafka topic, or to Parquet files with a ``value`` column where no broker is given.

    ``avro`` is the record's Avro schema text (see :mod:`skylane.streaming.wire`). Files can only be added to, so in modes
    other than append each batch's complete result goes to a folder of its own, ``snapshot=<batch>``.
    """
    framed = wire.encode(df, schema_id, avro)
    if not servers and mode != "append":
        return to_snapshots(framed, f"{path}/{topic}", checkpoint, name, trigger, mode)
    writer = framed.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint)
    if servers:
        writer = writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    else:
        writer = writer.format("parquet").option("path", f"{path}/{topic}")
    return _start(writer, trigger)


def to_json_messages(df: DataFrame, key: str) -> DataFrame:
    """``key`` and all columns as a JSON ``value``."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def to_table(df: DataFrame, table: str, checkpoint: str, name: str, trigger: str | None = "120 seconds", rows_per_file: int = 500) -> StreamingQuery:
    """Add each batch to a catalogue table once; a file is closed after ``rows_per_file`` rows or with the batch.

    The table is partitioned by ``_query`` (the query's id, which stays with its checkpoint) and ``_batch``. The catalogue
    learns of a partition when all its files are there, so a known partition is the record that the batch was written: run
    again, it is left as it is. A partition that a failure left unknown is replaced. Batches without rows have none.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession  # the query's own copy of the session
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        spark.conf.set("spark.sql.files.maxRecordsPerFile", rows_per_file)
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        marked = batch.withColumns({"_query": F.lit(query), "_batch": F.lit(number).cast("long")})
        if not spark.catalog.tableExists(table):
            marked.limit(0).write.format("parquet").partitionBy("_query", "_batch").saveAsTable(table)
        elif not spark.sql(f"SHOW PARTITIONS {table} PARTITION (_query = '{query}', _batch = {number})").isEmpty():
            return
        rows = marked.select(*[F.col(f"`{c}`") for c in spark.table(table).columns])  # inserted by position
        rows.write.mode("overwrite").insertInto(table)

    return _start(df.writeStream.foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint), trigger)


def to_ledger(df: DataFrame, path: str, checkpoint: str, name: str, trigger: str | None = "120 seconds", mode: str = "append", rows_per_file: int = 500) -> StreamingQuery:
    """Each batch once, in a folder with records (see :mod:`skylane.streaming.ledger`).

    In update mode the rows are changes: :meth:`Ledger.latest` of the grouping columns is the result, and merging by these
    columns keeps the folder from growing.
    """

    def write(batch: DataFrame, number: int) -> None:
        Ledger(batch.sparkSession, path, rows_per_file).add(batch, number)

    return _start(df.writeStream.outputMode(mode).foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint), trigger)


def to_snapshots(df: DataFrame, path: str, checkpoint: str, name: str, trigger: str | None = STATISTICS_TRIGGER, mode: str = "complete") -> StreamingQuery:
    """Each trigger's complete (or, in update mode, changed) result under its batch number; a batch that is run again replaces its snapshot."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    return _start(df.writeStream.outputMode(mode).foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint), trigger)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of the newest snapshot only."""
    newest = snapshots.agg(F.max("snapshot").alias("snapshot"))
    return snapshots.join(F.broadcast(newest), "snapshot").drop("snapshot")  # one row


def _newest(rows: DataFrame, keep: int) -> DataFrame:
    """Rows of the newest ``keep`` windows."""
    windows = rows.select("window").distinct().orderBy(F.desc("window.start")).limit(keep)
    return rows.join(F.broadcast(windows), "window")  # ``keep`` rows


def live_buckets(messages: DataFrame, ts: str, bucket: str, aggregates: list, keep: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates by bucket (and ``by``) over messages counted once for each (partition, offset); the newest ``keep`` buckets (batch frames)."""
    grouped = messages.dropDuplicates(["partition", "offset"]).groupBy(F.window(ts, bucket).alias("window"), *by).agg(*aggregates)
    return _newest(grouped, keep).orderBy("window.start", *by)


def to_live_buckets(
    messages: DataFrame, ts: str, bucket: str, aggregates: list, path: str, checkpoint: str, name: str, keep: int = 30, by: tuple[str, ...] = (),
    trigger: str | None = "5 seconds", snapshots: int = 10,
) -> StreamingQuery:
    """:func:`live_buckets` over all messages so far, as a new snapshot after each batch (see :func:`latest_snapshot`).

    ``bucket`` is a number and a unit, as '5 seconds'. State holds the buckets and the offsets of the last ``keep`` buckets
    of time and no more: a message older than that before the newest one is late. Buckets that state has given up stay in the
    snapshots while they are among the newest ``keep``. A batch run again starts from the snapshot before it and replaces
    its own. The last ``snapshots`` are kept. A new checkpoint and path start again from nothing.
    """
    number, unit = bucket.split()
    once = messages.withWatermark(ts, f"{int(number) * keep} {unit}").dropDuplicatesWithinWatermark(["partition", "offset"])
    changes = once.groupBy(F.window(ts, bucket).alias("window"), *by).agg(*aggregates)

    def write(batch: DataFrame, n: int) -> None:
        spark, rows = batch.sparkSession, batch
        if n > 0:
            last = spark.read.schema(batch.schema).parquet(f"{path}/snapshot={n - 1}")
            rows = batch.unionByName(last.join(batch.select("window", *by), ["window", *by], "left_anti"))
        _newest(rows.persist(), keep).coalesce(1).write.mode("overwrite").parquet(f"{path}/snapshot={n}")
        rows.unpersist()
        delete(spark, f"{path}/snapshot={n - snapshots}")

    return _start(changes.writeStream.outputMode("update").foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint), trigger)


def dedupe_offsets(stream: DataFrame, ts: str, delay: str = "1 minute") -> DataFrame:
    """Each (partition, offset) at most once within the delay, on a stream."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["partition", "offset"])


def latest_of(df: DataFrame, keys: list[str], order: str, earliest: bool = False) -> DataFrame:
    """The row of each key with the largest (or smallest) ``order`` (batch frames); a hot key costs one row a task."""
    pick = F.min_by if earliest else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct("*"), order).alias("row")).select("row.*")


def run_group(starts: dict[str, Callable[[], StreamingQuery]], enabled: dict[str, bool] | None = None, timeout: float | None = None, poll: float = 1.0) -> dict[str, StreamingQuery]:
    """Start the enabled queries of a group and wait until all end (or ``timeout`` seconds); stop all when one fails or the wait is interrupted.

    All queries are looked at in turn, ``poll`` seconds each, so a failure is seen whichever query it strikes.
    """
    running: dict[str, StreamingQuery] = {}
    until = None if timeout is None else time.monotonic() + timeout
    try:
        for n, f in starts.items():
            if (enabled or {}).get(n, True):
                running[n] = f()
        left = dict(running)
        while left and (until is None or time.monotonic() < until):
            left = {n: q for n, q in left.items() if not q.awaitTermination(poll)}
            _log.info("%d of %d queries alive: %s", len(left), len(running), ", ".join(left))
    except BaseException:
        for q in running.values():
            q.stop()
        raise
    return running
