"""A corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, token ids.

Each stage works on all rows that its predecessor kept. All but the last return the columns
of documents. Stages hold for null texts and ids, repeated rows and empty tables as their
operators state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import mixing, quality, simhash, tiling, tokenout
from seqloom.llm.common import materialize, release, small_or_whole, table
from seqloom.llm.queries import tokenizer_file

#: Documents whose calibrated chance of label 1 is below this are rejected.
REJECT_BELOW = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _words(text: Column) -> list[Column]:
    """128 bits of a text, so that equal texts and no others share them."""
    return [F.xxhash64(F.lit(seed), F.coalesce(text, F.lit(""))) for seed in (1, 2)]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects. A score depends on the text alone,
    so rows are told apart by their texts and not by their ids, which may repeat or be null.
    Without labels nothing is known and all documents stay."""
    own = dict(zip(("a", "b"), _words(F.col("text")), strict=True))
    scores = quality.score_documents(docs, table(spark, sf_dir, "labels"), predict_at=REJECT_BELOW, keep=own)
    rejected = scores.where(F.col("predicted") == 0).select("a", "b").distinct()
    return docs.withColumns(own).join(rejected, ["a", "b"], "left_anti").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: the one with the least id, rows without an id
    last. Rows are told apart by id and text, since ids may repeat. Rows without a word stay as
    they are: they are copies of nothing."""
    a, b = _words(F.col("text"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", a.alias("a"), b.alias("b"))
    worded = simhash.has_words(F.col("text"))
    rows = docs.where(worded).withColumn("row", row)
    found = simhash.near_duplicates(rows, simhash.STAGE, id="row")
    marks = found.groupBy("row").agg(F.count("*").alias("n"), F.max(F.col("row") != F.col("component_id")).alias("copy"))
    # most rows are neither copies nor repeated; their texts move only if this table is large
    marks = small_or_whole(marks.where(F.col("copy") | (F.col("n") > 1)), "marks")
    kept = rows.join(marks, "row", "left_anti").select(COLUMNS)
    once = rows.join(marks.where(~F.col("copy")), "row").dropDuplicates(["row"]).select(COLUMNS)
    return kept.unionByName(once).unionByName(docs.where(~worded).select(COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain at least half of a benchmark item in tiles of five words."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix; a document that is taken several times is as many rows."""
    return mixing.mix(docs).select(COLUMNS)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, read back through the index: doc_id, start, n_tokens, ids_crc32."""
    return tokenout.round_trip(docs, tokenizer_file(), end_id=2)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: The stages fit models and hash in ways that SQL cannot state; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
