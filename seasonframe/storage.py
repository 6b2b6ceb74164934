"""Where intermediate results that are read more than once are kept."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder: spark.checkpoint.dir, or what setCheckpointDir was given.

    Where neither is set, a folder in the warehouse is used on a single machine; on a cluster,
    where every executor would write to a disk of its own, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        master = spark.sparkContext.master
        shared = "://" in warehouse and not warehouse.startswith("file:")
        if not shared and not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{warehouse.rstrip('/')}/_intermediate"
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write to a table in the shared checkpoint folder and continue from there.

    Ends the lineage and survives lost executors like a checkpoint, but stays columnar: later
    reads prune columns, push filters, and know the size when choosing a join.
    """
    spark = df.sparkSession
    target = f"{_own(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def cut_all(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Cut several independent tables; their jobs overlap on the cluster."""
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(len(tables)) as pool:
        done = pool.map(inheritable_thread_target(spark)(cut), tables.values())
        return dict(zip(tables, done))


def release(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; results that still read them must be done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
