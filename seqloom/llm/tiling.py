"""Benchmark decontamination by greedy string tiling.

Seeds, the windows of MATCH words that a document shares with a benchmark item, are found by
rolling hashes: each task joins its documents' windows with the sorted windows of a block of
items. On each (item, document) pair with enough seeds the longest match of unmarked words is
marked on both sides again and again, until none of MATCH words is left (running Karp-Rabin
greedy string tiling). Tiles may lie in any order, so an item whose sentences were reordered is
still covered. A document is contaminated by an item if the tiles cover at least COVERAGE of
the item's words.

The benchmark is a query set against all documents: its distinct items go to every task in blocks
of at most BLOCK_WORDS words (or one item), one pass a block, and the table is written
between passes, so that driver and workers hold one block at a time. Documents are never
exploded, joined or shuffled, and each is tiled within its own row. Windows that match are
listed by hash on either side and never as pairs, so repetitive texts take memory in
proportion to their words.

Defined cases: case and punctuation do not count (words are runs of letters and digits, lower
case; in scripts that are written without blanks each character is a word); null or empty
texts are never contaminated and null or shorter items than MATCH words contaminate nothing;
items of equal words count once, under the least item_id, whatever their blocks; an item without
an id contaminates, and is named null where no equal item has an id; columns of any name pass
through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

MATCH, COVERAGE, BLOCK_WORDS = 5, 0.5, 1_000_000
#: Scripts written without blanks: Thai and Lao, Myanmar, Khmer, kana, Han.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORDS, _MIXED = re.compile(r"\w+").findall, re.compile(f"[^\\W{_DENSE}]+|[{_DENSE}]").findall
_HAS_DENSE = re.compile(f"[{_DENSE}]").search
_BASE = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    return _WORDS(text) if text.isascii() or not _HAS_DENSE(text) else _MIXED(text)


def word_hashes(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words(text)], dtype=np.uint64)


def windows(h: np.ndarray, n: int = MATCH) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n words: sum of h[i + k] * BASE^(n - 1 - k)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
    return out


class Block:
    """Benchmark items with an index of their seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words = [], []
        for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0)):
            h = word_hashes(text)
            if len(h) >= MATCH:
                self.ids.append(i)
                self.words.append(h)
        seeds = [windows(h) for h in self.words]
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        # a bit for the top bits of each seed, so that most windows need no search
        bits = min(24, max(16, (64 * len(flat)).bit_length()))
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << bits, dtype=bool)
        self.table[flat >> self.shift] = True
        self.item = np.concatenate([np.full(len(s), k) for k, s in enumerate(seeds)])[order] if seeds else np.zeros(0, int)
        self.at = np.concatenate([np.arange(len(s)) for s in seeds])[order] if seeds else np.zeros(0, int)

    def _shared(self, w: np.ndarray) -> np.ndarray:
        """The windows that may be seeds: their top bits are in the table."""
        return w[self.table[w >> self.shift]]

    def seeded(self, h: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The items that share windows with a document: places of these in the item, and the
        windows' hashes. Each window of the block is listed once, however often it occurs."""
        found = self._shared(windows(h))
        if not len(found):
            return {}
        found = np.unique(found)
        lo, hi = np.searchsorted(self.seeds, found, "left"), np.searchsorted(self.seeds, found, "right")
        counts = hi - lo
        if not counts.any():
            return {}
        at = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        at = at[np.argsort(self.item[at], kind="stable")]
        items, starts = np.unique(self.item[at], return_index=True)
        return {int(k): (self.at[x], self.seeds[x]) for k, x in zip(items, np.split(at, starts[1:]), strict=True)}


def _marked(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in windows that begin at the starts."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + MATCH, -1)
    return np.cumsum(edge[:n]) > 0


class _Rolling:
    """Karp-Rabin hashes of windows of any length, from running sums: word k counts BASE^-k."""

    def __init__(self, h: np.ndarray, inverse: np.ndarray, base: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * inverse[: len(h)], dtype=np.uint64)])
        self.base, self.marks = base, np.zeros(len(h), dtype=bool)

    def free(self, size: int) -> np.ndarray:
        """Starts of the windows without a marked word."""
        taken = np.concatenate([[0], np.cumsum(self.marks)])
        return np.flatnonzero(taken[size:] == taken[: len(taken) - size])

    def hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.base[starts]


def _powers(x: int, n: int) -> np.ndarray:
    """1, x, x^2, .. modulo 2^64."""
    out = np.full(n, x, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def tile(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, words): the longest first, ties by
    place in the item, then in the document. The greatest length of a free match is found by
    halving; its windows are listed by hash on either side, never as pairs, and each is tried with
    the first free place of its hash. A round leaves no match of its length, so there are at most
    as many rounds as tiles of different lengths fit into the item."""
    size = max(len(item), len(doc)) + 1
    base, inverse = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    a, b = _Rolling(item, inverse, base), _Rolling(doc, inverse, base)
    tiles, most = [], min(len(item), len(doc))

    def met(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of n words on both sides that meet, and their hashes."""
        i, j = a.free(n), b.free(n)
        x, y = a.hashes(i, n), b.hashes(j, n)
        both = np.intersect1d(x, y)
        p, q = np.isin(x, both), np.isin(y, both)
        return i[p], x[p], j[q], y[q]

    while most >= MATCH:
        low = MATCH - 1
        while low < most:
            n = (low + most + 1) // 2
            low, most = (n, most) if len(met(n)[0]) else (low, n - 1)
        if most < MATCH:
            break
        i, x, j, y = met(most)
        order = np.argsort(y, kind="stable")
        places, ends = j[order], dict(zip(*np.unique(y, return_counts=True), strict=True))
        start = dict(zip(ends, np.cumsum([0, *ends.values()])[:-1].tolist(), strict=True))
        ends = {k: start[k] + n for k, n in ends.items()}
        for at, key in zip(i.tolist(), x, strict=True):
            if a.marks[at : at + most].any():
                continue
            # a place that is taken once stays so
            while start[key] < ends[key] and b.marks[places[start[key]] : places[start[key]] + most].any():
                start[key] += 1
            if start[key] < ends[key]:
                to = int(places[start[key]])
                if (item[at : at + most] == doc[to : to + most]).all():
                    tiles.append((at, to, most))
                    a.marks[at : at + most] = b.marks[to : to + most] = True
        most -= 1
    return tiles


def covered(text: str | None, block: Block, least: float) -> list[tuple[int, float]]:
    """(item id, coverage) of the items that a text contains to the least share or more."""
    h = word_hashes(text)
    own, out = None, []
    for k, (i, seeds) in block.seeded(h).items():
        item = block.words[k]
        # no tiling covers more of the item than its seeds do
        if _marked(i, len(item)).sum() < least * len(item):
            continue
        own = windows(h) if own is None else own
        near = _marked(np.flatnonzero(np.isin(own, seeds)), len(h))
        # words outside all seeds are left out; one that equals no other stands for each gap
        kept = np.flatnonzero(near | np.concatenate([[False], near[:-1]]))
        doc = np.where(near[kept], h[kept], _gap(np.concatenate([item, h[kept]]), len(kept)))
        share = sum(t[2] for t in tile(item, doc)) / len(item)
        if share >= least and share > 0:
            out.append((block.ids[k], round(share, 9)))
    return out


def _gap(known: np.ndarray, n: int) -> np.ndarray:
    """n distinct values that are not known."""
    new = np.setdiff1d(np.arange(n + len(known), dtype=np.uint64), known)
    return new[:n]


def _digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        found = [words(t) for t in batch]
        yield pd.DataFrame({"n": [len(w) for w in found], "digest": [hashlib.sha256(" ".join(w).encode("utf-8", "surrogatepass")).digest() for w in found]})


def _blocks(benchmark: DataFrame, id: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's distinct items in blocks, one in the driver's memory at a time."""
    found = F.pandas_udf(_digests, "n int, digest binary")
    items = benchmark.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("w", found("text"))
    same = items.where(F.col("w.n") >= MATCH).groupBy("w.digest").agg(F.min("id").alias("id"), F.first("text").alias("text"), F.first("w.n").alias("n"))
    held, size = [], 0
    for r in same.toLocalIterator():
        if held and size + r["n"] > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append((r["id"], r["text"]))
        size += r["n"]
    if held:
        yield held


def _finder(shared, least: float):
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"item_id": i, "coverage": c} for i, c in covered(t, shared.value, least)] for t in texts], dtype=object)

    return found


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = COVERAGE, out: str = "leaks") -> DataFrame:
    """Add `out`, an array of (item_id, coverage), the best first, to every row of docs. A column
    of that name in docs becomes `__` and the name."""
    kind = "array<struct<item_id:bigint,coverage:double>>"
    rows = docs.withColumnRenamed(out, f"__{out}").withColumn(out, F.array().cast(kind))
    text = f"__{out}" if text == out else text
    shared, held = None, None
    for items in _blocks(benchmark, item_id, item_text):
        if shared is not None:
            # the pass of the block before ends here
            written = materialize(rows, "leaks")
            shared.destroy()
            if held is not None:
                release(held)
            rows = held = written
        shared = docs.sparkSession.sparkContext.broadcast(Block(items))
        rows = rows.withColumn(out, F.concat(out, F.pandas_udf(_finder(shared, least), kind)(F.col(text))))
    best = F.transform(out, lambda x: F.struct((-x["coverage"]).alias("c"), x["item_id"].alias("i")))
    return rows.withColumn(out, F.transform(F.array_sort(best), lambda x: F.struct(x["i"].alias("item_id"), (-x["c"]).alias("coverage"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that contain no benchmark item, with the columns of docs."""
    return with_leaks(docs, benchmark, out="__tiling_leaks", **how).where(F.size("__tiling_leaks") == 0).drop("__tiling_leaks")
