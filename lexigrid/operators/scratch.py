"""Intermediate tables in the folder that driver and executors share, and dense numbers for sorted rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lexigrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    return path


def kept(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read again: later jobs don't recompute it, and it survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """`df` with `out`: dense numbers from 0 in the order of the column `by`, whose values are distinct.

    Rows are range-partitioned and sorted, numbered within their partitions as they are written, and get the sizes of
    the partitions before theirs added: one shuffle, and no task holds more than a partition.
    """
    rows = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id())
    rows = kept(rows, "numbered").withColumn("__part", F.shiftright("__at", 33)).withColumn("__nth", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("__part").agg((F.max("__nth") + 1).alias("__n"))  # a row for each partition
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__nth")).drop("__at", "__part", "__nth", "__before")
