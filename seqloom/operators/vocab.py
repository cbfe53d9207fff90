"""Vocabularies: counting, pruning, indexing and encoding tokens.

A vocabulary is a table (token, idx, n, df): idx numbers tokens in their own order from 0, n
counts occurrences and df documents. Counting groups by (token, document) first, so both
counts come from one partially combined aggregate and hot tokens are summed before they meet.
Lookups are plain joins: Spark broadcasts a vocabulary that is small enough by its own
threshold and shuffles it otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import matches_fully
from ..plans.tables import numbered


@dataclass(frozen=True)
class Prune:
    """Bounds are inclusive; frequencies are shares of all tokens or all documents. max_unique
    keeps tokens that are more frequent than the one after the last that would fit, so all
    that tie at the cut go."""

    min_occurrences: int | None = None
    max_occurrences: int | None = None
    min_frequency: float | None = None
    max_frequency: float | None = None
    min_document_occurrences: int | None = None
    max_document_occurrences: int | None = None
    min_document_frequency: float | None = None
    max_document_frequency: float | None = None
    max_unique: int | None = None
    excluded: tuple = ()
    excluded_pattern: str | None = None

    def bounds(self, total: Column, documents: Column) -> Column:
        n, df = F.col("n"), F.col("df")
        tests = [
            (self.min_occurrences, lambda v: n >= v), (self.max_occurrences, lambda v: n <= v),
            (self.min_frequency, lambda v: n / total >= v), (self.max_frequency, lambda v: n / total <= v),
            (self.min_document_occurrences, lambda v: df >= v), (self.max_document_occurrences, lambda v: df <= v),
            (self.min_document_frequency, lambda v: df / documents >= v), (self.max_document_frequency, lambda v: df / documents <= v),
        ]
        out = F.lit(True)
        for value, test in tests:
            if value is not None:
                out = out & test(F.lit(value))
        return out


NO_PRUNING = Prune()


def document_counts(tokens: DataFrame, key: str = "token") -> DataFrame:
    """(token, doc_id, k). Plans that use this table twice, for a vocabulary and for a matrix, share
    its shuffle."""
    return tokens.select(F.col(key).alias("token"), "doc_id").groupBy("token", "doc_id").agg(F.count("*").alias("k"))


def summed(per: DataFrame) -> DataFrame:
    """(token, n, df) of document counts."""
    return per.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("df"))


def counts(tokens: DataFrame, key: str = "token") -> DataFrame:
    """(token, n, df) of (doc_id, token) rows."""
    return summed(document_counts(tokens, key))


def indexed(df: DataFrame, by: str = "token", out: str = "idx") -> DataFrame:
    """Number rows from 0 in the order of `by`. For vocabularies (after pruning), not for facts."""
    return df.withColumn(out, (F.row_number().over(Window.orderBy(by)) - 1).cast("long"))


def prune(stats: DataFrame, rules: Prune, documents: int | None = None) -> DataFrame:
    """Rows of (token, n, df) that the rules keep. documents: their number, empty ones included."""
    out = stats
    if rules.min_frequency is not None or rules.max_frequency is not None:
        out = out.crossJoin(F.broadcast(stats.agg(F.sum("n").alias("__total"))))  # one row
    else:
        out = out.withColumn("__total", F.lit(1))
    out = out.where(rules.bounds(F.col("__total"), F.lit(documents or 1))).drop("__total")
    if rules.excluded:
        out = out.where(~F.col("token").isin(list(rules.excluded)))
    if rules.excluded_pattern:
        out = out.where(~matches_fully(F.col("token").cast("string"), rules.excluded_pattern))
    if rules.max_unique is not None:
        top = out.select("n").orderBy(F.desc("n")).limit(rules.max_unique + 1)
        cut = F.broadcast(top.agg(F.when(F.count("*") > rules.max_unique, F.min("n")).alias("__cut")))  # one row
        out = out.crossJoin(cut).where(F.coalesce(F.col("n") > F.col("__cut"), F.lit(True))).drop("__cut")
    return out


def vocabulary(tokens: DataFrame, rules: Prune = NO_PRUNING, documents: int | None = None, key: str = "token") -> DataFrame:
    """(token, n, df, idx). documents is needed for document frequencies: the number of rows of
    the table of documents, since empty ones have no token row."""
    stats = pruned(counts(tokens, key), rules, documents)
    # tokens are numbered in one task, after pruning; longer keys are as many as the corpus has of them
    return indexed(stats) if key == "token" else numbered(stats, "token")


def pruned(stats: DataFrame, rules: Prune, documents: int | None) -> DataFrame:
    if documents is None and (rules.min_document_frequency is not None or rules.max_document_frequency is not None):
        raise ValueError("document frequencies need the number of documents")
    return prune(stats, rules, documents)


def fixed_vocabulary(spark, tokens: list) -> DataFrame:
    """A vocabulary that the caller fixes, in the caller's order; no pruning applies to it."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], ["token", "idx"])


def require_tokens(vocab: DataFrame) -> DataFrame:
    if vocab.isEmpty():
        raise ValueError("the vocabulary is empty: the pruning rules leave no token")
    return vocab


def encode(tokens: DataFrame, vocab: DataFrame, mask: str | None = None, close: bool = True) -> DataFrame:
    """Replace tokens by idx. Without a mask unknown tokens go and positions close up; with one
    they get the index after the last, and positions stay. Operators that only need the order
    of positions do without closing, which saves a sort."""
    lookup = vocab.select("token", "idx")
    if mask is None:
        found = tokens.join(lookup, "token").drop("token")
        if not close:
            return found
        close = Window.partitionBy("doc_id").orderBy("pos")
        return found.withColumn("pos", (F.row_number().over(close) - 1).cast("int"))
    size = F.broadcast(lookup.where(F.col("token") != mask).agg(F.count("*").alias("__mask")))  # one row
    found = tokens.join(lookup.where(F.col("token") != mask), "token", "left").crossJoin(size)
    return found.withColumn("idx", F.coalesce("idx", "__mask")).drop("token", "__mask")


def add_mask(vocab: DataFrame, mask: str) -> DataFrame:
    """The vocabulary that masked encodings index: the mask itself comes last."""
    rest = vocab.where(F.col("token") != mask).select("token", "idx")
    return rest.unionByName(rest.agg(F.lit(mask).alias("token"), F.count("*").alias("idx")))


def merged_vocabulary(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two vocabularies with counts, numbered anew."""
    both = a.select("token", "n", "df").unionByName(b.select("token", "n", "df"))
    return indexed(both.groupBy("token").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))


@dataclass
class Vocabulary:
    """A fitted vocabulary; a plain table, so it is saved and joined like any other."""

    table: DataFrame
    mask: str | None = None
    rules: Prune = field(default_factory=Prune)

    def encode(self, tokens: DataFrame) -> DataFrame:
        return encode(tokens, self.table, self.mask)
