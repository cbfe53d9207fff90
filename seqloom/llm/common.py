"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import materialize, release, scratch_path

__all__ = ["ascii_lower", "materialize", "number_before", "release", "scratch_path", "small_or_whole", "table"]

#: White space of the word contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that are broadcast hold at most this many bytes, as JSON.
MAX_BROADCAST = 16 << 20


def small_or_whole(df: DataFrame, tag: str) -> DataFrame:
    """The table, written, and marked for a broadcast only where its measured size allows. Beyond
    it a join shuffles both sides, and as this one is read from files, Spark can split the
    partitions of a hot key on the other."""
    df = materialize(df, tag)
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= MAX_BROADCAST else df


def number_before(totals: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Running sum of `value` before each `key`, for tables of one row a partition or shard."""
    from pyspark.sql import Window

    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
