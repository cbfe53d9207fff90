"""Windows over sequences of any length.

A window partitioned by the sequence puts a whole sequence into one task. Sequences longer than a
bound are therefore cut into blocks of rows, each a group of its own, and the rows at a block's
borders are copied to its neighbours as far as the window looks: a halo. Ranks within a
long sequence come from ranges of (sequence, position), each sorted in a task of its own, and
from the sizes of the ranges before. All that a window of a bounded frame computes is then the
same as over the whole sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize

#: Sequences of more rows than LONG are cut into blocks of BLOCK rows.
LONG, BLOCK = 1 << 20, 1 << 16


@dataclass
class Blocked:
    """Rows and the groups that `window` orders. Where sequences are cut, rows have a block, their
    rank if their sequence is long, and whether they are their block's own or a copy."""

    rows: DataFrame
    key: str
    order: str
    cut: bool = False

    @property
    def extra(self) -> list[str]:
        return ["__block", "__rank", "__own"] if self.cut else []

    @property
    def window(self):
        return Window.partitionBy(self.key, *self.extra[:1]).orderBy(self.order)

    def rank(self) -> Column:
        """The place of a row in its sequence, from 0."""
        own = F.row_number().over(self.window) - 1
        return F.coalesce("__rank", own) if self.cut else own

    def own(self, df: DataFrame) -> DataFrame:
        """What was computed, without the copies."""
        return df.where("__own").drop(*self.extra) if self.cut else df


def ranked(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Add `__rank`, the place of a row in its sequence, for few sequences of any length."""
    dealt = rows.repartitionByRange(key, order).sortWithinPartitions(key, order)
    dealt = materialize(dealt.withColumn("__id", F.monotonically_increasing_id()), "ranks").withColumn("__part", F.shiftright("__id", 33))
    parts = dealt.groupBy(F.col(key).alias("__k"), F.col("__part").alias("__p")).agg(F.min("__id").alias("__lo"), F.count("*").alias("n"))
    before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__k", "__p", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("__lo")).alias("__shift"))
    met = dealt.join(parts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")))
    return met.withColumn("__rank", F.col("__id") + F.col("__shift")).drop("__k", "__p", "__shift", "__part", "__id")


def blocked(rows: DataFrame, key: str, order: str, before: int, after: int, long: int | None = None, block: int | None = None) -> Blocked:
    """rows, ready for windows that look at most `before` rows back and `after` rows ahead. One pass
    counts the rows of the sequences; where none is longer than `long` they stay as they are.
    The places `order` of a sequence are distinct."""
    long, block = LONG if long is None else long, max(BLOCK if block is None else block, before, after, 1)
    sizes = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n"))
    keys = materialize(sizes.where(F.col("n") > long).select("__key"), "long")
    if keys.isEmpty():
        return Blocked(rows, key, order)
    same = F.col(key).eqNullSafe(F.col("__key"))
    cut = ranked(rows.join(keys, same, "left_semi"), key, order)
    place, number = F.col("__rank") % block, F.floor(F.col("__rank") / block)
    copies = [F.struct(number.alias("b"), F.lit(True).alias("own"))]
    if after:
        copies.append(F.when((place < after) & (number > 0), F.struct((number - 1).alias("b"), F.lit(False).alias("own"))))
    if before:
        copies.append(F.when(place >= block - before, F.struct((number + 1).alias("b"), F.lit(False).alias("own"))))
    cut = cut.withColumn("__x", F.explode(F.array_compact(F.array(*copies)))).withColumns({"__block": F.col("__x.b"), "__own": F.col("__x.own")}).drop("__x")
    rest = rows.join(keys, same, "left_anti").withColumns({"__block": F.lit(0).cast("long"), "__rank": F.lit(None).cast("long"), "__own": F.lit(True)})
    return Blocked(rest.unionByName(cut), key, order, cut=True)
