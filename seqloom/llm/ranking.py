"""Ranked lexical search: the k best documents of each item, scores in integers.

Terms are maximal runs of ASCII letters and digits and of all code points above 127, with A-Z
lower-cased. A term weighs floor(1000 * ln((2N + 2) / (2df + 1))); a document's score for an item
sums the impacts of the item's terms, w * (10^9 tf div (1000 tf + 8m)), m = 10 + 90 n N div L.

Sort-based accumulation: a task looks up which items hold the terms of its documents,
concatenates all (item, document, impact) entries of a few documents, sorts their packed keys
by radix, sums equal keys by reduceat, and keeps a heap of k documents an item. No entry
is shuffled: a document's impacts meet where the document is. The heaps of the tasks are
dealt out by ranges of (item, slot), each selects again, and so do ranges of items, so no
task reads more than a slot's share of the heaps.

Size: documents become lists of the matched terms, written once. Items are taken in blocks
of at most BLOCK_ENTRIES terms (or one item), which is what goes to every task; each
block is one pass over the documents. A task holds CHUNK entries and those of one document.

Defined cases: a null text has no terms and is never found; N and L count documents with a term;
repeated rows are separate documents; equal scores go by ascending id, null last; each row of
items is ranked by itself, one without terms finds nothing; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import before_parts, ranged
from .common import materialize, release

TOP, BLOCK_ENTRIES, CHUNK, SLOTS = 10, 1 << 18, 1 << 20, 64
#: Bytes outside terms become blanks, A-Z become a-z.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(data: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return data.translate(_FOLD).split() if data else []


class Block:
    """Some items: which of them hold each term."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        held = defaultdict(list)
        for item, terms in items:
            for t in terms:
                held[t.encode()].append(item)
        self.place = {t: i for i, t in enumerate(held)}
        self.counts = np.array([len(x) for x in held.values()], dtype=np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        numbers = sorted({i for x in held.values() for i in x})
        self.items = np.array(numbers, dtype=np.int64)
        at = {n: i for i, n in enumerate(numbers)}
        self.flat = np.array([at[i] for x in held.values() for i in x], dtype=np.int64)


def _distinct_terms(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted({x.decode() for x in terms_of(t)}) for t in texts], dtype=object)


def _items(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item, item_id, terms, block): items numbered, in blocks by their running number of terms."""
    rows = items.select(F.col(id).alias("item_id"), F.pandas_udf(_distinct_terms, "array<string>")(F.col(text).cast("binary")).alias("terms"))
    rows = ranged(rows.where(F.size("terms") > 0), "item_id", "terms")
    w = Window.partitionBy("part").orderBy("item_id", "terms")
    earlier = F.coalesce(F.sum(F.size("terms")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"at": F.row_number().over(w), "earlier": earlier})
    rows = rows.join(before_parts(rows, F.lit(1)), "part").withColumn("item", F.col("before") + F.col("at") - 1).drop("before")
    rows = rows.join(before_parts(rows, F.size("terms")), "part")
    block = F.floor((F.col("before") + F.col("earlier")) / F.lit(BLOCK_ENTRIES)).cast("long")
    return materialize(rows.select(F.col("item").cast("long").alias("item"), "item_id", "terms", block.alias("block")), "items")


def _matches(shared) -> Callable:
    """UDF: the number of a text's terms, and those of the block with their occurrences."""

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        place = shared.value.place
        for texts in batches:
            n, t, f = [], [], []
            for data in texts:
                terms = terms_of(data)
                hits = [(place[x], c) for x, c in Counter(terms).items() if x in place]
                n.append(len(terms))
                t.append([x for x, _ in hits])
                f.append([c for _, c in hits])
            yield pd.DataFrame({"n": n, "t": pd.Series(t, dtype=object), "f": pd.Series(f, dtype=object)})

    return F.pandas_udf(found, "n bigint, t array<int>, f array<bigint>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys that are not negative, by counting sorts of 16-bit digits."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, max(1, top.bit_length()), 16):
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def accumulate(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


def _rank(entry: tuple) -> tuple:
    """Order of (score, id): higher scores, then smaller ids, null last."""
    score, i = entry
    return -score, i is None, 0 if i is None else i


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else 0


def _chunks(work: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about CHUNK entries."""
    total, lo = np.cumsum(work), 0
    while lo < len(work):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK, side="right")))
        yield lo, hi
        lo = hi


def _score(shared, weights: np.ndarray, n_docs: int, length: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, heaps, kind = shared.value, defaultdict(list), None
        for batch in batches:
            kind = batch.schema.field("id").type
            t_col, f_col = batch.column("t"), batch.column("f")
            sizes = np.diff(t_col.offsets.to_numpy())
            ends = np.cumsum(sizes)
            t, f = t_col.flatten().to_numpy().astype(np.int64), f_col.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            m = 10 + 90 * batch.column("n").to_numpy().astype(np.int64) * n_docs // length
            impact = weights[t] * (1_000_000_000 * f // (1000 * f + 8 * m[doc]))
            work = np.bincount(doc, weights=block.counts[t], minlength=len(sizes)).astype(np.int64)
            for lo, hi in _chunks(work):
                a, b = ends[lo] - sizes[lo], ends[hi - 1]
                reps = block.counts[t[a:b]]
                at = np.repeat(block.starts[t[a:b]] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
                keys, sums = accumulate(block.flat[at] * (hi - lo) + np.repeat(doc[a:b] - lo, reps), np.repeat(impact[a:b], reps))
                keys, sums = keys[sums > 0], sums[sums > 0]
                item = keys // (hi - lo)
                cuts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else []
                for x, y in zip(cuts, [*cuts[1:], len(item)], strict=True):
                    heap = heaps[int(item[x])]
                    floor = max(_kth(sums[x:y], k), heap[-1][0] if len(heap) == k else 1)
                    best = x + np.flatnonzero(sums[x:y] >= floor)
                    if len(best):
                        ids = batch.column("id").take(pa.array(keys[best] % (hi - lo) + lo)).to_pylist()
                        heap[:] = heapq.nsmallest(k, [*heap, *zip(sums[best].tolist(), ids, strict=True)], key=_rank)
        out = [(int(block.items[i]), s, d) for i, heap in heaps.items() for s, d in heap]
        if out:
            yield _batch(out, kind)

    return run


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    item, score, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, kind)], ["item", "score", "id"])


def _select(k: int) -> Callable:
    """Rows in order of item: the k best of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap, kind = None, [], None
        for batch in batches:
            kind, out = batch.schema.field("id").type, []
            for item, score, i in zip(*(batch.column(c).to_pylist() for c in ("item", "score", "id")), strict=True):
                if item != now:
                    out += [(now, s, d) for s, d in heapq.nsmallest(k, heap, key=_rank)]
                    now, heap = item, []
                heap.append((score, i))
                if len(heap) >= 64 * k:
                    heap = heapq.nsmallest(k, heap, key=_rank)
            if out:
                yield _batch(out, kind)
        if heap:
            yield _batch([(now, s, d) for s, d in heapq.nsmallest(k, heap, key=_rank)], kind)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, id, score): the k best documents of every row of items, from rank 1."""
    spark = docs.sparkSession
    known = _items(items, item_id, item_text)
    blocks = [r["block"] for r in known.select("block").distinct().orderBy("block").collect()]
    kind = docs.schema[id].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", kind)])
    partitions, found = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    for number in blocks:
        held = known.where(F.col("block") == number).select("item", "terms").toLocalIterator()
        block = Block([(r["item"], r["terms"]) for r in held])
        shared = spark.sparkContext.broadcast(block)
        rows = docs.select(F.col(id).alias("id"), _matches(shared)(F.col(text).cast("binary")).alias("p"))
        postings = materialize(rows.select("id", "p.n", "p.t", "p.f"), "postings")
        size = postings.where(F.col("n") > 0).agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        n_docs, length = size["docs"], size["terms"] or 1
        weights = np.zeros(len(block.place), dtype=np.int64)
        for r in postings.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            weights[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        heaps = postings.where(F.size("t") > 0).select("id", "n", "t", "f").mapInArrow(_score(shared, weights, n_docs, length, k), schema)
        heaps = materialize(heaps.withColumn("slot", F.spark_partition_id() % SLOTS), "heaps")
        release(postings)
        found = heaps if found is None else found.unionByName(heaps)
    if found is None:
        found = spark.createDataFrame([], schema).withColumn("slot", F.lit(0))
    pick = _select(k)
    once = found.repartitionByRange(partitions, "item", "slot").sortWithinPartitions("item", "slot").select("item", "score", "id").mapInArrow(pick, schema)
    best = once.repartitionByRange(partitions, "item").sortWithinPartitions("item").mapInArrow(pick, schema)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(w))
    return ranked.join(known.select("item", "item_id"), "item").select("item_id", "rank", F.col("id").alias(id), "score")
