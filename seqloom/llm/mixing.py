"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's target is its share of all words by weight, at most `most` times its own words; what
a source cannot take goes to the others by weight. In tables: a target is min(most * words,
level * weight), and the level is found in a few rounds, each one sum over the sources.

Blocks: documents of a source stand in a hashed order within classes of like size, and each
block holds the same part of every class, so all blocks of a source have about as many words.
A source is read whole floor(target / words) times and once more in part: its quota is that
many passes of blocks and the blocks of the part. The last block is trimmed to the target, by
whole documents of all classes, the larger ones first, so what is taken comes within about
half of the smallest document of the target.

Tree: the quotas are split over the output shards by multivariate hypergeometric draws; each
node halves its shards and deals every source's exact quota between the halves. Quotas of
groups of sources are dealt first, and each group deals its own among its sources, which is
the same law. A shard's blocks of a source are a range of a permutation of the quota's block
numbers, so shards never share a block. What the mix takes of a document is what shards draw
of its blocks; within a shard, rows follow a hash of the seed.

Size: documents are never gathered. Windows run inside (source, size class, hash bucket), whose
buckets grow with the table. Sources, ranks, targets and quotas are tables of any length; the
driver holds one number a group of GROUP sources and a shard.

Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a
source of its own, last; repeated rows are separate documents; an empty table gives no rows;
columns of docs may have any names but those that mix() adds, which begin with `__`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, number_before

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
ROWS_A_BUCKET, NEXT, GROUP = 20_000, 4, 10_000
#: Words of a block, and blocks of all sources at most: beyond them blocks grow.
BLOCK_WORDS, MAX_BLOCKS = 4096, 1 << 26


def balanced(total: int, shards: int) -> np.ndarray:
    """A total in near-equal parts."""
    return np.array([total * (k + 1) // shards - total * k // shards for k in range(shards)], dtype=np.int64)


def split_quotas(quotas: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Numbers of blocks of each source in each shard, (sources, shards), whose sums are the quotas
    and the shards' totals: the leaves of the tree."""
    out = np.zeros((len(quotas), len(totals)), dtype=np.int64)

    def deal(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = counts
            return
        mid = (lo + hi) // 2
        n, rest = int(totals[lo:mid].sum()), int(counts.sum())
        left = np.zeros_like(counts)
        for i, c in enumerate(counts.tolist()):  # one marginal draw a source, given those before
            rest -= c
            if n and c:
                left[i] = rng.hypergeometric(c, rest, n)
                n -= int(left[i])
        deal(left, lo, mid)
        deal(counts - left, mid, hi)

    deal(quotas.astype(np.int64), 0, len(totals))
    return out


def sources_of(rows: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """rows(source, size) -> (source, rank, source_size, target), a row a source. Ranks follow the
    code points of sources, null last: the sources are dealt out by range and numbered
    within their ranges."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    ranged = materialize(totals.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = number_before(ranged.groupBy("part").agg(F.count("*").alias("n")), "part", "n", "before").select("part", "before")
    at = F.row_number().over(Window.partitionBy("part").orderBy(order))
    rank = (F.col("before") + at - 1).cast("long")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    out = ranged.join(before, "part").select("source", "source_size", rank.alias("rank"))
    out = materialize(out.withColumn("weight", F.get(kinds, (F.col("rank") % len(weights)).cast("int"))), "ranks")
    total = out.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = most * F.col("source_size") < F.col("weight") * level
        r = out.agg(F.sum(F.when(over, most * F.col("source_size"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("w"), F.count_if(over).alias("n")).first()
        if r["n"] == full or not r["w"]:
            break
        level, full = (total - float(r["held"] or 0)) / r["w"], r["n"]
    target = F.least((most * F.col("source_size")).cast("double"), F.col("weight") * level)
    return out.select("source", "rank", "source_size", target.alias("target"))


def _extra(rest: float, next_docs: dict[int, list[int]]) -> dict[int, int]:
    """How many of the next documents of each class fill the rest, larger classes first; at the
    end one document more, where going over is nearer than staying under."""
    out = {c: 0 for c in next_docs}
    for c in sorted(next_docs, reverse=True):
        for size in next_docs[c]:
            if size > rest:
                break
            rest -= size
            out[c] += 1
    over = min(((docs[out[c]] - rest, c) for c, docs in next_docs.items() if out[c] < len(docs)), default=(rest, None))
    if over[0] < rest:
        out[over[1]] += 1
    return out


def _stride(blocks: int) -> int:
    """A multiplier that permutes the block numbers."""
    x = max(1, int(blocks * 0.6180339887))
    while math.gcd(x, max(1, blocks)) != 1:
        x += 1
    return x


def _quotas(sources: DataFrame, most: int, shards: int, seed: int) -> DataFrame:
    """Add whole (passes), part (words of the last pass), blocks (of one pass), last (blocks of
    the last pass), quota, stride and ends, the borders of the shards in the quota."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    words = max(BLOCK_WORDS, -(-most * total // MAX_BLOCKS))
    w = F.col("source_size")
    whole = F.when(w > 0, F.least(F.floor(F.col("target") / w), F.lit(most))).otherwise(0).cast("long")
    out = sources.withColumn("whole", whole)
    part = F.when(F.col("whole") < most, F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * w)).otherwise(0.0)
    out = out.withColumns({"part": part, "blocks": F.greatest(F.lit(1), F.ceil(w / words)).cast("long")})
    last = F.when(w > 0, F.ceil(F.col("part") / w * F.col("blocks"))).otherwise(0).cast("long")
    out = out.withColumn("last", F.least(last, F.col("blocks")))
    quota = F.when(w > 0, F.col("whole") * F.col("blocks") + F.col("last")).otherwise(0)
    out = materialize(out.withColumns({"quota": quota, "group": F.floor(F.col("rank") / GROUP).cast("long")}), "quotas")
    groups = {r["group"]: r["q"] for r in out.groupBy("group").agg(F.sum("quota").alias("q")).collect()}
    order = sorted(groups)
    sums = np.array([groups[g] for g in order], dtype=np.int64)
    dealt = split_quotas(sums, balanced(int(sums.sum()), shards), np.random.default_rng([seed, 0]))
    shared = out.sparkSession.sparkContext.broadcast(dict(zip(order, dealt.tolist(), strict=True)))

    def deal(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rank")
        g = int(df["group"].iloc[0])
        ends = np.cumsum(split_quotas(df["quota"].to_numpy(), np.array(shared.value[g]), np.random.default_rng([seed, 1, g])), axis=1)
        return pd.DataFrame({"rank": df["rank"], "stride": [_stride(int(q)) for q in df["quota"]], "ends": list(ends)})

    ends = out.select("group", "rank", "quota").groupBy("group").applyInPandas(deal, "rank bigint, stride bigint, ends array<bigint>")
    return materialize(out.join(ends, "rank"), "dealt")


def _same(a: str, b: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]


def _running(rows: DataFrame) -> DataFrame:
    """rows(id, source, size, h) -> and class, before (words before in the class, in hashed order)
    and class_size, through exact sums of hash buckets."""
    rows = rows.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(-1).cast("int"))
    # equal rows share a hash; where they are many they are dealt out, since which is which does not matter
    many = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > ROWS_A_BUCKET).select("h", F.lit(True).alias("many"))
    if many.isEmpty():
        rows = rows.withColumn("place", F.col("h"))
    else:
        place = F.when(F.col("many"), F.xxhash64("h", F.monotonically_increasing_id())).otherwise(F.col("h"))
        rows = rows.join(many, "h", "left").select("id", "source", "size", "h", "class", place.alias("place"))
        rows = materialize(rows, "places")
    buckets = max(1, rows.count() // ROWS_A_BUCKET)
    rows = rows.withColumn("bucket", F.floor(F.shiftrightunsigned("place", 12) / float(1 << 52) * buckets).cast("int"))
    group = ["source", "class", "bucket"]
    inside = Window.partitionBy(*group).orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = Window.partitionBy("source", "class")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group).agg(F.sum("size").alias("w"))
    sums = sums.select(*group, F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("earlier"), F.sum("w").over(whole).alias("class_size"))
    met = rows.alias("r").join(sums.alias("s"), _same("r", "s", group))
    return met.select("r.id", "r.source", "r.class", "r.size", "r.h", (F.col("r.before") + F.col("s.earlier")).alias("before"), "class_size")


def _cuts(rows: DataFrame) -> DataFrame:
    """(source, class, cut): documents that end at most at the cut of their class belong to the last
    pass. A group holds a few documents of each of a source's classes: sizes of a class differ
    by less than 2 times."""
    want, end = F.col("part") / F.col("source_size") * F.col("class_size"), F.col("before") + F.col("size")
    met = rows.where((F.col("size") > 0) & (F.col("part") > 0)).withColumns({"want": want, "end": end})
    near = met.where((F.col("end") > F.col("want")) & (F.col("before") <= F.col("want") + NEXT * F.pow(F.lit(2.0), F.col("class") + 1)))
    near = near.groupBy("source", "class").agg(F.max("want").alias("want"), F.array_sort(F.collect_list(F.struct("end", "size"))).alias("next"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for source, rows in zip(df["source"], df["rows"], strict=True):
                classes = {r["class"]: [(x["end"], x["size"]) for x in r["next"][:NEXT]] for r in rows}
                # what the prefixes leave of the part: each class stops before its next document
                rest = sum(r["want"] - (classes[r["class"]][0][0] - classes[r["class"]][0][1]) for r in rows)
                more = _extra(rest, {c: [z for _, z in x] for c, x in classes.items()})
                out += [(source, c, x[more[c] - 1][0] if more[c] else x[0][0] - x[0][1]) for c, x in classes.items()]
            yield pd.DataFrame(out, columns=["source", "class", "cut"])

    by_source = near.groupBy("source").agg(F.collect_list(F.struct("class", "want", "next")).alias("rows"))
    return by_source.mapInPandas(cut, "source string, class int, cut bigint")


def _identity(docs: DataFrame, seed: int) -> Column:
    """A hash of a whole row, in which a null and the column it is in count."""
    whole = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(F.lit(seed), *[x for c in whole for x in (c.isNull(), c)])


def plan(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: int = MOST, shards: int = 8, seed: int = 7) -> DataFrame:
    """(id, h, source, size, source_size, target, draws) for every row of docs: draws are the
    (shard, block) of each copy that the mix takes; h is a hash of the row."""
    h = _identity(docs, seed)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"), h.alias("h")), "sizes")
    facts = _quotas(sources_of(rows, weights, most), most, shards, seed)
    rows = _running(rows)
    held = ["source_size", "target", "whole", "part", "blocks", "last", "quota", "stride", "ends"]
    rows = rows.alias("r").join(facts.alias("f"), _same("r", "f", ["source"])).select("r.*", *[F.col(f"f.{c}") for c in held])
    rows = materialize(rows.drop("ends", "stride"), "running")
    cuts = materialize(_cuts(rows), "cuts")
    met = rows.alias("r").join(cuts.alias("c"), _same("r", "c", ["source", "class"]), "left").select("r.*", "c.cut")
    met = met.alias("r").join(facts.alias("f"), _same("r", "f", ["source"])).select("r.*", "f.stride", "f.ends")
    block = F.least(F.floor(F.col("before") / F.col("class_size") * F.col("blocks")), F.col("blocks") - 1)
    met = met.withColumn("block", F.when(F.col("size") > 0, block).otherwise(0).cast("long"))
    # a class without a next document is taken whole if the part needs it
    partly = (F.col("part") > 0) & F.coalesce(F.col("before") + F.col("size") <= F.col("cut"), F.lit(True))
    passes = F.when(F.col("size") > 0, F.col("whole") + partly.cast("int")).otherwise(0)
    number = lambda k: k * F.col("blocks") + F.when(k == F.col("whole"), F.least("block", F.col("last") - 1)).otherwise(F.col("block"))
    shard = lambda n: F.size(F.filter("ends", lambda e: e <= F.pmod(n * F.col("stride"), F.col("quota"))))
    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(passes - 1, F.lit(0))), lambda k: F.struct(shard(number(k)).alias("shard"), number(k).alias("block")))
    none = F.array().cast("array<struct<shard:int,block:bigint>>")
    return met.select("id", "h", "source", "size", "source_size", "target", F.when(passes > 0, draws).otherwise(none).alias("draws"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", shards: int = 8, seed: int = 7, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with its `__shard`, its `__block` and
    `__order`, the place of a row in its shard's local shuffle. Rows that are equal in all
    columns count each."""
    h = _identity(docs, seed)
    drawn = plan(docs, id, text, source, shards=shards, seed=seed, **how).select("id", "h", F.explode("draws").alias("x"))
    drawn = drawn.groupBy("id", "h", "x").agg(F.count("*").alias("n"))
    own = docs.withColumn("__h", h).dropDuplicates([id, "__h"])
    out = own.alias("d").join(drawn.alias("p"), F.col(f"d.{id}").eqNullSafe(F.col("p.id")) & (F.col("d.__h") == F.col("p.h")))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.n"))).alias("__copy")
    out = out.select(*[F.col(f"d.{c}") for c in own.columns], F.col("p.x.shard").alias("__shard"), F.col("p.x.block").alias("__block"), copy)
    return out.withColumn("__order", F.xxhash64("__h", "__block", "__copy")).drop("__h", "__copy")


def write_mix(mixed: DataFrame, path: str, shards: int = 8, files_a_shard: int = 1) -> None:
    """Write path/__shard=N, each file in its shuffled order."""
    out = mixed.withColumn("__file", F.pmod(F.col("__order"), F.lit(files_a_shard)))
    out = out.repartition(shards * files_a_shard, "__shard", "__file").sortWithinPartitions("__shard", "__order").drop("__file", "__order", "__block")
    out.write.partitionBy("__shard").parquet(path)
