"""Written intermediate tables and connected components.

Lineage is cut by writing Parquet below the folder named in ``spark.checkpoint.dir``. All executors share that
folder, so a lost executor costs a re-read and never a recomputation of the whole job. All tables of an application
stand in one folder, which :func:`clear_staged` removes when its results have been written.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT = "spark.checkpoint.dir"
#: Temporary folders of local sessions without that setting, by application.
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only an unset setting of a local session gets a temporary folder."""
    where = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if not where:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {_CHECKPOINT} to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _local_dirs:  # the setting itself can't be changed once a session runs
            _local_dirs[application] = "file://" + tempfile.mkdtemp(prefix="skylane-")
        where = _local_dirs[application]
    return where.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/skylane-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """Address of a folder for one use below the shared one; it is made by whoever writes to it first."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows and bytes that go to Python at a time while a table is written; a session's own smaller values stay.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def give_back_memory() -> None:
    """Return free memory of this Python worker to the system: workers are used again, by stages that need other buffers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What operators keep in a Python worker from one task to the next, by the operator's name.
kept_in_worker: dict[str, dict] = {}


def let_go_what_others_keep(name: str | None = None) -> None:
    """Drop what operators other than ``name`` keep in this Python worker, which is used again by the stages after theirs."""
    others = [kept for of, kept in kept_in_worker.items() if of != name and kept]
    for kept in others:
        kept.clear()
    if others:
        give_back_memory()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what runs inside: both the executor and its Python workers hold a whole batch of texts."""
    before = {k: spark.conf.get(k) for k in _BATCHES}
    try:
        for k, most in _BATCHES.items():
            now = int(before[k].removesuffix("b"))
            spark.conf.set(k, str(min(now, most) if now > 0 else most))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def staged(df: DataFrame, name: str, compression: str = "lz4") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`staged` returned, once nothing reads it any more. Other frames are left alone."""
    spark = table.sparkSession
    inside = f"/skylane-{spark.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if inside in folder:
            _delete(spark, folder)


def clear_staged(spark: SparkSession) -> None:
    """Delete all staged tables of this application; frames that still read them can't be used any more."""
    _delete(spark, _root(spark))


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and no node with one is anybody's smaller neighbour."""
    ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up"))))
    by_node = pairs.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
    return by_node.where("ups > 1 or (ups = 1 and low = 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge: rows ``(node, root)``.

    Alternates large-star and small-star steps until every component is a star around its smallest node. Each step is a
    partial aggregation (so a hub costs one row per map task) and an equi join whose skewed side adaptive execution may
    split. Null ends and self loops are ignored; an empty edge table gives an empty result.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where("hi is not null and lo is not null and hi <> lo")
        .distinct()
    )
    pairs = staged(pairs, "edges")
    for _ in range(max_rounds):
        if _are_stars(pairs):
            break
        # Large star: neighbours above u are tied to the smallest node in u's closed neighbourhood.
        both = pairs.union(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        )
        # Small star: each node and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct(F.col("hi").alias("x"), F.col("m")), F.struct(F.col("lo").alias("x"), F.col("m")))).alias("e"))
            .select(F.col("e.x").alias("hi"), F.col("e.m").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        last, pairs = pairs, staged(small, "edges")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
