"""Sources: token sequences, timed sequences, multisets, trees, edge lists and matrices as
DataFrames.

The long form of a sequence collection is (doc_id, pos, token). Everything here is lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Tables of fewer bytes than this are dealt out anew by spread().
SMALL = 1 << 30


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A small table, dealt out to all cores by its keys: a file with one row group is one task
    however many cores there are, and what follows is grouped by these keys anyway. Larger
    tables have tasks enough and stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys) if size < SMALL else df


def tokens_of_text(docs: DataFrame, id: str = "doc_id", text: str = "text", separator: str = " ") -> DataFrame:
    """Split texts at a literal separator; a null text has no tokens."""
    plain = len(separator) == 1 and separator not in ".$|()[{^?*+\\"  # no pattern at all: the quick way to split
    return docs.select(F.col(id).alias("doc_id"), F.posexplode(F.split(text, separator if plain else f"\\Q{separator}\\E")).alias("pos", "token"))


def tokens_of_arrays(docs: DataFrame, id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    return docs.select(F.col(id).alias("doc_id"), F.posexplode(tokens).alias("pos", "token"))


def tokens_of_rows(rows: DataFrame, id: str, order: list[str], token: str, time: str | None = None) -> DataFrame:
    """One token a row: positions follow the order columns within an id."""
    from pyspark.sql import Window

    w = Window.partitionBy(id).orderBy(*order)
    cols = [F.col(id).alias("doc_id"), (F.row_number().over(w) - 1).alias("pos"), F.col(token).alias("token")]
    if time:
        cols.append(F.col(time).alias("t"))
    return rows.select(*cols)


def multisets_of_arrays(docs: DataFrame, id: str = "doc_id", sets: str = "sets") -> DataFrame:
    """(doc_id, set_pos, item_pos, token) of arrays of arrays; empty sets keep their position."""
    outer = docs.select(F.col(id).alias("doc_id"), F.posexplode(sets).alias("set_pos", "items"))
    return outer.select("doc_id", "set_pos", F.posexplode("items").alias("item_pos", "token"))


def edge_list(rows: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(row_label, col_label, value) with a numeric value; missing columns are an error."""
    missing = [c for c in (row, col, value) if c not in rows.columns]
    if missing:
        raise ValueError(f"an edge list needs a row, a column and a value; missing: {missing}")
    return rows.select(F.col(row).cast("string").alias("row_label"), F.col(col).cast("string").alias("col_label"), F.col(value).cast("double").alias("value"))


def matrix(rows: DataFrame, row: str = "row_id", col: str = "col_id", value: str = "value") -> DataFrame:
    """Coordinates (row_id, col_id, value) without zeros, duplicates summed."""
    out = rows.groupBy(F.col(row).alias("row_id"), F.col(col).alias("col_id")).agg(F.sum(F.col(value).cast("double")).alias("value"))
    return out.where(F.col("value") != 0)


def matrix_of_arrays(rows: DataFrame, row: str = "row_id", values: str = "values") -> DataFrame:
    """Coordinates of a dense matrix that is stored as an array a row."""
    return rows.select(F.col(row).alias("row_id"), F.posexplode(values).alias("col_id", "value")).where(F.col("value") != 0)


def sparse_vectors(coo: DataFrame, size: int) -> DataFrame:
    """(row_id, features): ml vectors of a matrix, rows without entries absent."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def vector(at, values):
        return SparseVector(size, at, values)

    packed = coo.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "value"))).alias("entries"))
    return packed.select("row_id", vector(F.transform("entries", lambda e: e["col_id"]), F.transform("entries", lambda e: e["value"])).alias("features"))


def write_matrix(coo: DataFrame, path: str, mode: str = "error") -> None:
    coo.write.mode(mode).parquet(path)
