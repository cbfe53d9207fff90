"""Categorical columns of data frames as token lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def categorical_lists(df: DataFrame, by: str, columns: list[str], order: str, with_names: bool = False, unique: bool = False) -> DataFrame:
    """(by, tokens): the values of each column among the rows of a group, column after column,
    in row order, nulls left out; unique keeps first appearances of each column."""
    if missing := [c for c in (by, order, *columns) if c not in df.columns]:
        raise ValueError(f"unknown columns: {missing}")
    lists = []
    for c in columns:
        value = F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) if with_names else F.col(c).cast("string")
        rows = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))))
        values = F.transform(rows, lambda x: x["v"])
        lists.append(F.array_distinct(values) if unique else values)
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.concat(*lists).alias("tokens"))
