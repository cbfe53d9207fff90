"""Generators as tables: a Python generator a partition, read when the table is.

A table of windows, of distributions or of anything else that is cheaper to make than to store
is a data source with a schema and partitions. Tasks run the generator of their own partition
and hand over batches; nothing is made in the driver, and a lost task makes its rows again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def table_of(spark: SparkSession, generate: Callable[[int], Iterator[tuple]], partitions: int, schema: str) -> DataFrame:
    """The rows that generate(k) yields for k from 0 to partitions - 1. It must give the same rows
    each time, as tasks may be repeated."""
    label = f"generator_{uuid.uuid4().hex}"

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(k) for k in range(partitions)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from generate(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(label).load()


def day_windows(first: int, last: int, width: int, stride: int = 1, days_a_partition: int = 32) -> tuple[Callable[[int], Iterator[tuple]], int, str]:
    """Arguments of table_of for sliding windows of `width` days, a row (window, day) for each day of
    each whole window between two days."""
    starts = range(first, last - width + 2, stride)

    def generate(k: int) -> Iterator[tuple]:
        for i in range(k * days_a_partition, min((k + 1) * days_a_partition, len(starts))):
            for d in range(width):
                yield i, starts[i] + d

    return generate, max(1, -(-len(starts) // days_a_partition)), "window bigint, day bigint"
