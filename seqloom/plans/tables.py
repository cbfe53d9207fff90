"""Tables that cut lineage: written once to storage that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or (only where that
    is unset and Spark runs in one process, as in tests) a new temporary folder that then
    becomes the setting. On a cluster the setting is needed."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/seqloom-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage once, without the second computation that an eager checkpoint costs, and
    survives the loss of any executor because the files are in shared storage."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqloom_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_seqloom_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows dealt out by ranges of `order`, written, with `part`, the number of the range."""
    return materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def before_parts(parts: DataFrame, value: Column) -> DataFrame:
    """(part, before): the sum of `value` over all parts before. A row a part is all that the
    window meets in one task."""
    sums = parts.groupBy("part").agg(F.sum(value).alias("v"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("part", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("before")))


def numbered(df: DataFrame, *order: str, out: str = "idx") -> DataFrame:
    """Number rows from 0 in an order, for tables of any length: ranges are sorted each in a task of
    its own, and the numbers of rows before them are added."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = materialize(rows, "numbers").withColumn("part", F.shiftright("__id", 33))
    at = F.col("__id") - F.shiftleft("part", 33)
    return rows.join(before_parts(rows, F.lit(1)), "part").withColumn(out, (F.col("before") + at).cast("long")).drop("part", "__id", "before")
