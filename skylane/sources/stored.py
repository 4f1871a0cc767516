"""Tables that are derived once from stored ones and read by many queries, in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT = "spark.checkpoint.dir"


def at(spark: SparkSession, path: str):
    """Hadoop's file system and path of an address."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = at(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    files, where = at(spark, path)
    files.delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a local session without that setting gets a temporary one."""
    where = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT} to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skylane-")
        spark.conf.set(_CHECKPOINT, where)
    return f"{where.rstrip('/')}/skylane-{spark.sparkContext.applicationId}"


def stored(source: DataFrame, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes of ``source``, written when it is first asked for and read from then on.

    Its folder is named by the source's files, their sizes and times, so a changed source makes a new one. A table that
    a failure left incomplete has no ``_SUCCESS`` and is written again.
    """
    spark = source.sparkSession
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("*")), F.lit(0)).alias("h")).first()
    path = f"{shared_folder(spark)}/{name}-{state['n']}-{state['h'] & (1 << 64) - 1:016x}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
