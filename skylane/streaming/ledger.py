"""Parquet folders that a stream writes batch by batch and readers see in whole batches, each of them once.

A batch's files go to a folder of their own; then a record that names batch and folder is added to ``_ledger``. Only
recorded folders are read. A batch that is run again after a failure finds its record and writes nothing, or finds none
and writes anew, and what the failed run left behind is never read. Merging old batches adds a wider record that hides
the narrower ones at once; the folders it replaces stay until :func:`Ledger.drop_replaced`, for readers that still hold them.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skylane.sources.stored import at

_RECORD = "query string, first long, last long, folder string, layout string"
#: Column that holds the number of the batch a row came with.
BATCH = "_batch"


@dataclass(frozen=True)
class Record:
    query: str
    first: int
    last: int
    folder: str
    layout: str


def query_of(spark: SparkSession) -> str:
    """Id of the streaming query that runs the batch; it stays with the checkpoint. Batches by hand have none."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


class Ledger:
    """The folder ``path`` with its records. ``rows_per_file`` closes a file after so many rows; a batch closes its last file."""

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 500):
        self.spark, self.path, self.rows_per_file = spark, path.rstrip("/"), rows_per_file

    def records(self) -> list[Record]:
        """Records that no wider one hides, by query and batch. Their number is that of batches since the last merge."""
        files, where = at(self.spark, f"{self.path}/_ledger")
        if not files.exists(where):
            return []
        found = {Record(*r) for r in self.spark.read.schema(_RECORD).json(f"{self.path}/_ledger").collect()}
        hidden = lambda r: any(o.query == r.query and o.first <= r.first and r.last <= o.last and (o.last - o.first, o.folder) > (r.last - r.first, r.folder) for o in found)
        return sorted((r for r in found if not hidden(r)), key=lambda r: (r.query, r.first))

    def _write(self, rows: DataFrame, query: str, first: int, last: int, rows_per_file: int) -> None:
        folder = f"data-{last}-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.path}/{folder}")
        self._record(Record(query, first, last, folder, rows.schema.json()))

    def _record(self, record: Record) -> None:
        row = [(record.query, record.first, record.last, record.folder, record.layout)]
        self.spark.createDataFrame(row, _RECORD).coalesce(1).write.mode("append").json(f"{self.path}/_ledger")

    def add(self, batch: DataFrame, number: int) -> bool:
        """Write batch ``number`` unless its record is there; whether it was written. For ``foreachBatch``."""
        query = query_of(batch.sparkSession)
        if any(r.query == query and r.first <= number <= r.last for r in self.records()):
            return False
        self._write(batch.withColumn(BATCH, F.lit(number).cast("long")), query, number, number, self.rows_per_file)
        return True

    def read(self, records: list[Record] | None = None) -> DataFrame | None:
        """Rows of all recorded batches (or of ``records``) with their ``_batch``; columns that a batch lacks are null. None before the first batch."""
        layouts: dict[str, list[str]] = {}
        for r in self.records() if records is None else records:
            layouts.setdefault(r.layout, []).append(f"{self.path}/{r.folder}")
        frames = [self.spark.read.schema(StructType.fromJson(json.loads(layout))).parquet(*folders) for layout, folders in sorted(layouts.items())]
        whole = None
        for frame in frames:
            whole = frame if whole is None else whole.unionByName(frame, allowMissingColumns=True)
        return whole

    def latest(self, keys: list[str]) -> DataFrame | None:
        """Of each key the row of its last batch: the result of a query in update mode. A key costs a row a task at most."""
        rows = self.read()
        return None if rows is None else _latest(rows, keys).drop(BATCH)

    def merge(self, keys: list[str] | None = None, rows_per_file: int = 1_000_000) -> None:
        """Put each query's batches together in one folder; with ``keys`` only the latest row of each key is kept.

        The query may run on: batches recorded meanwhile stay beside the merged ones.
        """
        done = self.records()
        for query in sorted({r.query for r in done}):
            mine = [r for r in done if r.query == query]
            if len(mine) < 2:
                continue
            rows = self.read(mine)
            self._write(rows if keys is None else _latest(rows, keys), query, mine[0].first, mine[-1].last, rows_per_file)

    def drop_replaced(self, older_than: float = 3600) -> int:
        """Delete data folders that no visible record names and that are ``older_than`` seconds, so neither readers nor a running batch need them; how many."""
        files, root = at(self.spark, self.path)
        named = {r.folder for r in self.records()}
        before = (time.time() - older_than) * 1000
        there = [(s.getPath(), s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(root)]
        old = [folder for folder, name, changed in there if name.startswith("data-") and name not in named and changed <= before]
        for folder in old:
            files.delete(folder, True)
        return len(old)


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    kept = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), BATCH).alias("r")).select(*[F.col(k) if k in keys else F.col(f"r.`{k}`").alias(k) for k in rows.columns])
