"""Labelled trees and edge lists.

Trees are nodes (tree_id, node_id, label) and edges (tree_id, src, dst, weight). A walk of k
steps is k joins of edges, each followed by a sum, so parallel walks collapse at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialize, numbered, release
from .windows import Kernel, flat


def walks(edges: DataFrame, radius: int, kernel: Kernel = flat) -> DataFrame:
    """(tree_id, src, dst, value): sum over k of kernel(k) times the walks of k steps, counted with
    multiplicity, edge weights multiplied along a walk."""
    one = edges.groupBy("tree_id", "src", "dst").agg(F.sum("weight").alias("weight"))
    step, out = one, one.withColumn("value", F.col("weight") * kernel(1)).drop("weight")
    for k in range(2, radius + 1):
        on = one.select("tree_id", F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("weight").alias("more"))
        step = step.join(on, ["tree_id", "dst"]).groupBy("tree_id", "src", F.col("next").alias("dst")).agg(F.sum(F.col("weight") * F.col("more")).alias("weight"))
        out = out.unionByName(step.withColumn("value", F.col("weight") * kernel(k)).drop("weight"))
    return out.where(F.col("value") != 0)


def collapse(matrix: DataFrame, labels: DataFrame, key: tuple[str, ...] = ("tree_id",)) -> DataFrame:
    """(row_label, col_label, value): a square matrix (src, dst, value) summed by the labels of
    both ends; labels (key.., node_id, label)."""
    end = lambda node, name: labels.select(*key, F.col("node_id").alias(node), F.col("label").alias(name))
    met = matrix.join(end("src", "row_label"), [*key, "src"]).join(end("dst", "col_label"), [*key, "dst"])
    return met.groupBy("row_label", "col_label").agg(F.sum("value").alias("value"))


def splice(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take out the nodes whose label is not in keep(label): each parent inherits the children of
    a removed node with the children's edge weights, once for each way it reached the node; a
    removed node's self-loops are ignored and parallel edges add up. The nodes go one after
    another in a hashed order, many at once: a round takes those that come before all removed
    nodes they share an edge with, and joins their parents with their children. Neighbours never
    go in one round, so a round is what single steps would do, and each takes some node, on
    cycles too."""
    known = nodes.join(keep.select("label").distinct(), "label", "left_semi")
    gone = nodes.join(known, ["tree_id", "node_id"], "left_anti")
    turn = F.struct(F.xxhash64("tree_id", "node_id").alias("h"), "node_id")
    left = materialize(gone.select("tree_id", "node_id", turn.alias("turn")).distinct(), "removed")
    sums = lambda df: df.groupBy("tree_id", "src", "dst").agg(F.sum("ways").alias("ways"), F.sum("weight").alias("weight"))
    now = materialize(sums(edges.withColumn("ways", F.lit(1.0))), "edges")
    end = lambda c: left.select("tree_id", F.col("node_id").alias(c), F.col("turn").alias(f"turn_{c}"))
    while not left.isEmpty():
        both = now.where(F.col("src") != F.col("dst")).join(end("src"), ["tree_id", "src"]).join(end("dst"), ["tree_id", "dst"])
        later = F.when(F.col("turn_src") < F.col("turn_dst"), F.col("dst")).otherwise(F.col("src"))
        waits = both.select("tree_id", later.alias("node_id")).distinct()
        free = materialize(left.join(waits, ["tree_id", "node_id"], "left_anti").select("tree_id", "node_id"), "free")
        at = lambda c: free.select("tree_id", F.col("node_id").alias(c))  # noqa: E731, B023
        loose = now.where(F.col("src") != F.col("dst"))
        above = loose.join(at("dst"), ["tree_id", "dst"], "left_semi").select("tree_id", "src", F.col("dst").alias("mid"), F.col("ways").alias("in"))
        below = loose.join(at("src"), ["tree_id", "src"], "left_semi").select("tree_id", F.col("src").alias("mid"), "dst", "ways", "weight")
        new = above.join(below, ["tree_id", "mid"]).select("tree_id", "src", "dst", (F.col("in") * F.col("ways")).alias("ways"), (F.col("in") * F.col("weight")).alias("weight"))
        rest = now.join(at("src"), ["tree_id", "src"], "left_anti").join(at("dst"), ["tree_id", "dst"], "left_anti")
        after = materialize(sums(rest.select("tree_id", "src", "dst", "ways", "weight").unionByName(new)), "edges")
        still = materialize(left.join(free, ["tree_id", "node_id"], "left_anti"), "removed")
        release(now, left, free)
        now, left = after, still
    inside = known.select("tree_id", "node_id")
    for c in ("src", "dst"):
        now = now.join(inside.withColumnRenamed("node_id", c), ["tree_id", c], "left_semi")
    return known, now.select("tree_id", "src", "dst", "weight")


def tree_cooccurrence(nodes: DataFrame, edges: DataFrame, radius: int = 5, kernel: Kernel = flat, orientation: str = "directional", keep: DataFrame | None = None, mask: str | None = None, nullify: bool = False) -> DataFrame:
    """(row_label, col_label, value): labels that walks of up to `radius` steps connect. With keep
    and a mask, other labels become the mask, whose rows and columns stay empty if it is
    nullified; without a mask their nodes are spliced out."""
    if orientation not in ("before", "after", "symmetric", "directional"):
        raise ValueError(f"unknown orientation {orientation!r}")
    if keep is not None and mask is None:
        nodes, edges = splice(nodes, edges, keep)
    elif keep is not None:
        known = keep.where(F.col("label") != mask).select("label").distinct().withColumn("__known", F.lit(True))
        nodes = nodes.join(known, "label", "left").withColumn("label", F.when(F.col("__known"), F.col("label")).otherwise(mask)).drop("__known")
        nodes = nodes.where(F.col("label") != mask) if nullify else nodes
    after = collapse(walks(edges, radius, kernel), nodes)
    before = after.select(F.col("col_label").alias("row_label"), F.col("row_label").alias("col_label"), "value")
    if orientation == "after":
        return after
    if orientation == "before":
        return before
    if orientation == "symmetric":
        return after.unionByName(before).groupBy("row_label", "col_label").agg(F.sum("value").alias("value"))
    named = lambda df, p: df.withColumn("col_label", F.concat(F.lit(p), F.col("col_label")))
    return named(before, "pre_").unionByName(named(after, "post_"))


def edge_matrix(edges: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None, joint: bool = False) -> DataFrame:
    """(row_label, col_label, row_id, col_id, value) of an edge list, duplicates summed. Given
    dictionaries (label, idx) restrict rows and columns; joint numbers both in one space."""
    summed = edges.groupBy("row_label", "col_label").agg(F.sum("value").alias("value"))
    names = lambda c: summed.select(F.col(c).alias("label")).distinct()
    if joint:
        given = rows if rows is not None else columns
        rows = columns = given if given is not None else numbered(names("row_label").union(names("col_label")).distinct(), "label")
    rows = numbered(names("row_label"), "label") if rows is None else rows
    columns = numbered(names("col_label"), "label") if columns is None else columns
    out = summed.join(rows.select(F.col("label").alias("row_label"), F.col("idx").alias("row_id")), "row_label")
    out = out.join(columns.select(F.col("label").alias("col_label"), F.col("idx").alias("col_id")), "col_label")
    return out.select("row_label", "col_label", "row_id", "col_id", "value")
