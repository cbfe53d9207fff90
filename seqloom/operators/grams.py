"""n-grams and skip-grams of token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.halo import Blocked, blocked
from ..plans.tables import numbered
from . import vocab as V
from .windows import Kernel, flat


def _held(rows: DataFrame, before: int, after: int, long: int | None) -> Blocked:
    """Documents in groups; those of more than `long` tokens are cut into blocks."""
    return Blocked(rows, "doc_id", "pos") if long is None else blocked(rows, "doc_id", "pos", before, after, long)


def ngrams(tokens: DataFrame, n: int, behaviour: str = "exact", token: str = "token", long: int | None = None) -> DataFrame:
    """(doc_id, pos, gram ARRAY): runs of n tokens, or with "subgrams" of 1 to n at each place. Documents
    of more than `long` tokens are cut into blocks, each a group of its own."""
    if behaviour not in ("exact", "subgrams"):
        raise ValueError("behaviour is exact or subgrams")
    if n == 1:
        return tokens.select("doc_id", "pos", F.array(token).alias("gram"))
    held = _held(tokens.select("doc_id", "pos", token), 0, n - 1, long)
    ahead = [F.col(token)] + [F.lead(token, k).over(held.window) for k in range(1, n)]
    sizes = [n] if behaviour == "exact" else range(1, n + 1)
    grams = F.array(*[F.when(ahead[k - 1].isNotNull(), F.array(*ahead[:k])) for k in sizes])
    rows = held.own(held.rows.select("doc_id", "pos", *held.extra, grams.alias("grams")))
    return rows.select("doc_id", "pos", F.explode("grams").alias("gram")).where(F.col("gram").isNotNull())


def ngram_counts(tokens: DataFrame, n: int = 1, behaviour: str = "exact", token_rules: V.Prune = V.NO_PRUNING, gram_rules: V.Prune | None = None, documents: int | None = None, mask: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(columns, matrix): columns (label, idx) and counts (row_id, col_id, value). The same rules
    prune tokens and then grams unless others are given."""
    if n == 1 and mask is None:
        # known tokens and their counts are already in the document counts
        per = V.document_counts(tokens)
        stats = V.pruned(V.pruned(V.summed(per), token_rules, documents), gram_rules or token_rules, documents)
        columns = V.indexed(stats).withColumn("label", F.array("token"))
        cells = per.join(columns.select("token", F.col("idx").alias("col_id")), "token")
        return columns.drop("token"), cells.select(F.col("doc_id").alias("row_id"), "col_id", F.col("k").cast("double").alias("value"))
    per = gram_counts(ngrams(known_tokens(tokens, V.vocabulary(tokens, token_rules, documents), mask), n, behaviour))
    columns = numbered(V.pruned(V.summed(per), gram_rules or token_rules, documents), "token").withColumnRenamed("token", "label")
    return columns, _cells(per, columns)


def known_tokens(tokens: DataFrame, vocab: DataFrame, mask: str | None = None) -> DataFrame:
    """Rows (doc_id, pos, token) of known tokens in their order, or with the mask in place of others."""
    if mask is None:
        return tokens.join(vocab.select("token"), "token", "left_semi").select("doc_id", "pos", "token")
    known = tokens.join(vocab.select("token", "idx"), "token", "left")
    return known.select("doc_id", "pos", F.when(F.col("idx").isNotNull(), F.col("token")).otherwise(mask).alias("token"))


def count_matrix(grams: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts of known grams; also the transform of new documents, whose unknown grams go."""
    return _cells(gram_counts(grams), columns)


def gram_counts(grams: DataFrame) -> DataFrame:
    """(token, doc_id, k) of grams, dealt out before they are counted: a count in the task of the window
    that makes them takes memory that the window then cannot get back, and few grams of a
    document are alike."""
    return V.document_counts(grams.repartition("gram", "doc_id"), "gram")


def _cells(per: DataFrame, columns: DataFrame) -> DataFrame:
    out = per.join(columns.select(F.col("label").alias("token"), F.col("idx").alias("col_id")), "token")
    return out.select(F.col("doc_id").alias("row_id"), "col_id", F.col("k").cast("double").alias("value"))


def merge_counts(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two fitted count matrices as one: vocabularies united, rows stacked, columns renumbered."""
    labels = a[0].select("label", "n", "df").unionByName(b[0].select("label", "n", "df"))
    columns = numbered(labels.groupBy("label").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "label")
    parts = []
    for names, cells in (a, b):
        new = names.select("label", F.col("idx").alias("col_id")).join(columns.select("label", F.col("idx").alias("new")), "label")
        parts.append(cells.join(new, "col_id").select("row_id", F.col("new").alias("col_id"), "value"))
    return columns, parts[0].unionByName(parts[1])


def pairs_after(encoded: DataFrame, radius: int, kernel: Kernel = flat, reverse: bool = False, carry: tuple[str, ...] = (), own_radii: str | None = None, mask: int | None = None, long: int | None = None) -> DataFrame:
    """(doc_id, head, tail, w): tokens and what follows them (or comes before) within the radius, or
    within the token's own radius in a column. Pairs with the mask's index are left out. Documents
    of more than `long` tokens are cut into blocks."""
    held = _held(encoded, radius if reverse else 0, 0 if reverse else radius, long)
    step = F.lag if reverse else F.lead
    # contexts are plain columns first, so that only whole numbers are exploded
    tails = {f"__t{d}": step("idx", d).over(held.window) for d in range(1, radius + 1)}
    rows = held.own(held.rows.select("doc_id", F.col("idx").alias("head"), *carry, *held.extra, *([own_radii] if own_radii and own_radii not in carry else []), *[c.alias(t) for t, c in tails.items()]))
    near: list[Column] = [F.when(F.col(own_radii) >= d, F.col(t)) if own_radii else F.col(t) for d, t in enumerate(tails, 1)]
    rows = rows.select("doc_id", "head", *carry, F.posexplode(F.array(*near)).alias("d", "tail")).where(F.col("tail").isNotNull())
    if mask is not None:
        rows = rows.where((F.col("head") != mask) & (F.col("tail") != mask))
    weights = F.array(*[F.lit(kernel(d)).cast("double") for d in range(1, radius + 1)])
    return rows.select("doc_id", "head", *carry, "tail", F.get(weights, F.col("d")).alias("w"))


def skip_grams(encoded: DataFrame, radius: int = 5, kernel: Kernel = flat, reverse: bool = False, **how) -> DataFrame:
    """(doc_id, head, tail, value): weighted pairs of each document, summed."""
    return pairs_after(encoded, radius, kernel, reverse, **how).groupBy("doc_id", "head", "tail").agg(F.sum("w").alias("value")).where(F.col("value") > 0)


def corpus_skip_grams(encoded: DataFrame, radius: int = 5, kernel: Kernel = flat, reverse: bool = False) -> DataFrame:
    """(head, tail, value) over all documents."""
    return pairs_after(encoded, radius, kernel, reverse).groupBy("head", "tail").agg(F.sum("w").alias("value")).where(F.col("value") > 0)


def skip_gram_matrix(tokens: DataFrame, vocab: DataFrame, radius: int = 5, kernel: Kernel = flat) -> tuple[DataFrame, DataFrame]:
    """(columns, matrix): columns (head, tail, idx) are the pairs that occur, in index order."""
    cells = skip_grams(V.encode(tokens, vocab, close=False), radius, kernel)
    pairs = cells.select("head", "tail").distinct()
    columns = numbered(pairs, "head", "tail")
    out = cells.join(columns, ["head", "tail"]).select(F.col("doc_id").alias("row_id"), F.col("idx").alias("col_id"), "value")
    return columns, out
