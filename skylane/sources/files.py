"""Batch reads and writes of stored datasets."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_range(spark: SparkSession, path: str, ts: str, start=None, end=None, ordered: bool = False, half_open: bool = False) -> DataFrame:
    """Rows of a Parquet dataset with ``ts`` from ``start`` to ``end``; the bounds reach the scan as pushed filters.

    Both ends are included, or with ``half_open`` only the end, so that consecutive ranges share no row.
    """
    df = spark.read.parquet(path)
    bound: Column
    if start is not None:
        bound = F.lit(start).cast(df.schema[ts].dataType)
        df = df.where(F.col(ts) > bound if half_open else F.col(ts) >= bound)
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    return df.orderBy(ts) if ordered else df


#: Types that text columns may turn out to have, narrow ones first.
_KINDS = ("int", "bigint", "double", "date", "timestamp", "boolean")


def csv_layouts(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files by their first lines, from one pass in which a task hands on a line for each file. Empty files have none.

    A file's first line is the first of its first block; names in it hold no line ends.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    by_header = first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect()  # the names of the files
    return {r.header: r.files for r in by_header}


def _kinds(rows: DataFrame) -> dict[str, str]:
    """The narrowest type that all values of each text column fit, from one aggregation; a column without values stays text."""
    fits = lambda c, kind: F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull())
    # A timestamp also fits a date by losing its time: a date has ten characters at most.
    longer = lambda c: F.count_if(F.length(f"`{c}`") > 10)
    tests = [(c, kind, fits(c, kind) + longer(c) if kind == "date" else fits(c, kind)) for c in rows.columns for kind in _KINDS]
    if not tests:
        return {}
    counts = rows.agg(*[t.alias(str(k)) for k, (_, _, t) in enumerate(tests)], *[F.count(f"`{c}`").alias(f"n{k}") for k, c in enumerate(rows.columns)]).first()
    some = {c: counts[f"n{k}"] > 0 for k, c in enumerate(rows.columns)}
    out: dict[str, str] = {}
    for k, (c, kind, _) in enumerate(tests):
        if some[c] and counts[str(k)] == 0:
            out.setdefault(c, kind)
    return out


def read_csv_union(spark: SparkSession, paths: list[str], null_value: str = "\\N", infer: bool = True) -> DataFrame:
    """CSV files of different layouts as one frame: columns meet by name, absent ones are null.

    Files with the same first line are read together, so the plan has a scan for each layout and not for each file; a
    column has the narrowest type that all its values in all files fit, worked out in one pass over them.
    """
    frames = []
    for header, members in csv_layouts(spark, paths).items():
        names = next(csv.reader([header]))
        schema = StructType([StructField(n, StringType()) for n in names])
        frames.append(spark.read.csv(members, header=True, schema=schema, nullValue=null_value))
    if not frames:
        raise ValueError("no file has a first line")
    rows = union_by_name(frames)
    kinds = _kinds(rows) if infer else {}
    return rows.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in rows.columns])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Frames of different layouts as one: columns meet by name, absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_sorted(df: DataFrame, path: str, by: str, rows_per_file: int | None = None) -> None:
    """Range-sorted zstd Parquet: files hold disjoint ranges of ``by``, so later range reads skip files and row groups."""
    writer = df.sort(by).write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", 100_000)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("year", "month", "date", "hour"), mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def topic_sample(messages: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` messages by offset, oldest first."""
    return messages.orderBy(F.desc("offset"), F.desc("partition")).limit(n).orderBy("offset", "partition")


def recent_grid(messages: DataFrame, n: int, schema: str | None = None) -> DataFrame:
    """The newest ``n`` JSON messages with their fields as columns, newest first.

    Without a ``schema`` the columns are all keys that the ``n`` messages have, in order, each with the type that all its
    values share (text if they share none). A message that is no object has null fields, and a key named as one of
    ``partition`` and ``offset`` gets a trailing ``_``.
    """
    newest = messages.orderBy(F.desc("offset"), F.desc("partition")).limit(n)
    text, order = F.col("value").cast("string"), [F.desc("offset"), F.desc("partition")]
    if schema is not None:
        return newest.withColumn("v", F.from_json(text, schema)).select("partition", "offset", "v.*").orderBy(*order)
    parsed = newest.withColumn("v", F.try_parse_json(text))
    parsed = parsed.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT<"), F.col("v")))
    found = parsed.agg(F.schema_of_variant_agg("v").alias("s")).first().s  # one line of text
    # What has no common type, or holds only nulls, is text.
    kind = re.sub(r"(^|: |ARRAY<)OBJECT<", r"\1STRUCT<", found or "")
    kind = re.sub(r"(: |ARRAY<)(VARIANT|VOID)(?=[,>])", r"\1STRING", kind) if kind.startswith("STRUCT<") else "STRUCT<>"
    fields = F.try_variant_get("v", "$", kind).alias("f")
    names = [f.name for f in parsed.select(fields).schema["f"].dataType]
    columns = [F.col(f"f.`{n}`").alias(n + "_" if n in ("partition", "offset") else n) for n in names]
    return parsed.select("partition", "offset", fields).select("partition", "offset", *columns).orderBy(*order)


def preview(spark: SparkSession, name: str, order: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows of a table of the catalogue, in an order that names them."""
    return spark.table(name).orderBy(*order).limit(n)


def tables(spark: SparkSession) -> DataFrame:
    """Names of the session's tables and views."""
    return spark.createDataFrame([(t.name, t.isTemporary) for t in spark.catalog.listTables()], "name string, temporary boolean")
