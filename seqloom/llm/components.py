"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and joins over the edges and ends in a table in the shared
folder; the number of rounds grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point every neighbour of a node (large: the greater ones; small: the lesser ones and
    the node itself) at the least node among the neighbours and the node."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): every node of an edge with the least node it reaches.
    Loops and repeated or reversed edges do no harm; no edges give no rows."""
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    edges = materialize(edges, "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = sign(edges)
    while now[0]:
        after = materialize(_star(_star(edges, True), False), "edges")
        release(edges)
        edges, before, now = after, now, sign(after)
        if now == before:
            break
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
