"""Compression tokenizers: Lempel-Ziv phrase counts and byte-pair encodings of strings.

Both are sequential within a string and independent between strings, so strings are
spread over tasks. Distinct strings are counted with multiplicity."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import materialize, numbered, release

#: Largest code points of named character sets.
LIMITS = {"ascii": 127, "common": 2047, "bmp": 65535, "unicode": 1114111}


def lz_phrases(text: str, known: Iterable[str] = (), max_size: int = 1 << 20) -> dict[str, int]:
    """Counts of the phrases that a growing dictionary parses a string into, from the phrases
    `known` on. The empty phrase counts once and the last character is never part of one."""
    seen = dict.fromkeys(known, 0)
    start = 0
    for end in range(len(text)):
        phrase = text[start:end]
        if phrase in seen:
            seen[phrase] += 1
        elif len(seen) >= max_size:
            start = end
        else:
            seen[phrase] = 1
            start = end
    return {p: n for p, n in seen.items() if n}


def lz_counts(strings: DataFrame, id: str = "id", text: str = "s", max_size: int = 1 << 16, known: Iterable[str] = ()) -> DataFrame:
    """(id, phrase, n); a null string has none. known: phrases that every string's dictionary begins
    with."""
    if max_size <= 1:
        raise ValueError("a dictionary has at least 2 places")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = [lz_phrases(s, known, max_size) for s in df["s"]]
            yield df[["id"]].assign(phrases=[list(f) for f in found], n=[list(f.values()) for f in found])

    known = tuple(known)
    rows = strings.where(F.col(text).isNotNull()).select(F.struct(F.col(id).alias("id")).alias("id"), F.col(text).alias("s"))
    kind = dict(strings.select(F.col(id).alias("id")).dtypes)["id"]
    # the id travels in a struct, so that a null among whole numbers makes none a floating number
    out = rows.mapInPandas(run, f"id struct<id:{kind}>, phrases array<string>, n array<bigint>")
    out = out.select("id.id", F.explode(F.arrays_zip("phrases", "n")).alias("x"))
    return out.select("id", F.col("x.phrases").alias("phrase"), F.col("x.n").alias("n"))


def lz_matrix(counts: DataFrame, max_columns: int | None = 1 << 16, hash_function: Callable[[Column], Column] = F.hash) -> tuple[DataFrame | None, DataFrame]:
    """(columns, matrix): phrases hashed into max_columns columns by a function from a column to a
    column of whole numbers, or each a column of its own."""
    if max_columns is not None:
        if max_columns <= 1:
            raise ValueError("at least 2 columns")
        rows = counts.withColumn("col_id", F.pmod(hash_function(F.col("phrase")), F.lit(max_columns)).cast("long"))
        return None, rows.groupBy(F.col("id").alias("row_id"), "col_id").agg(F.sum("n").cast("double").alias("value"))
    columns = numbered(counts.select(F.col("phrase").alias("label")).distinct(), "label")
    out = counts.join(columns, counts["phrase"] == columns["label"]).select(F.col("id").alias("row_id"), F.col("idx").alias("col_id"), F.col("n").cast("double").alias("value"))
    return columns, out


#: Stands between strings in an array of codes; no code is negative.
BREAK = -1
#: Codes of a block of strings; a longer string is a block of its own.
BLOCK_CODES = 1 << 18
#: Texts that are Python strings at once; a batch of Arrow holds the others.
TEXTS = 256
#: Pairs that the driver holds, pairs it looks at for a round, and merges that tasks repeat before
#: the strings are written anew.
HELD, LOOK, PENDING = 100_000, 256, 64


def found(codes: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
    """Where a pair is merged, greedily from the left."""
    at = np.flatnonzero((codes[:-1] == pair[0]) & (codes[1:] == pair[1]))
    if pair[0] == pair[1] and len(at):
        # in a run of one code every other place
        first = np.concatenate([[True], np.diff(at) > 1])
        at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
    return at


def contract(codes: np.ndarray, pair: tuple[int, int], code: int, at: np.ndarray | None = None) -> np.ndarray:
    """Replace a pair by a code."""
    at = found(codes, pair) if at is None else at
    if not len(at):
        return codes
    codes, keep = codes.copy(), np.ones(len(codes), dtype=bool)
    codes[at], keep[at + 1] = code, False
    return codes[keep]


def joined(texts: Iterable[str | None], first: int) -> np.ndarray:
    """Strings as codes, a BREAK after each; characters above the limit become code 0."""
    flat = np.frombuffer("".join(f"{t or ''}\U0010ffff" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t or "") + 1 for t in texts]) - 1
    codes = np.where(flat < first, flat, 0).astype(np.int32)
    codes[ends] = BREAK
    return codes


def pair_counts(codes: np.ndarray, times: np.ndarray, at: np.ndarray, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that begin at the places, as a << 32 | b, and how often each counts."""
    at = at[(at >= 0) & (at + 1 < len(codes))]
    at = at[(codes[at] != BREAK) & (codes[at + 1] != BREAK)]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    string = np.searchsorted(np.flatnonzero(codes == BREAK), at)
    pairs, which = np.unique(codes[at].astype(np.int64) << 32 | codes[at + 1], return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, which, sign * times[string])
    return pairs, n


@dataclass
class Merges:
    """A trained encoding: merge number i makes code first + i of a pair of codes."""

    first: int
    pairs: list[tuple[int, int]]

    def text_of(self, code: int) -> str:
        if code < self.first:
            return chr(code)
        a, b = self.pairs[code - self.first]
        return self.text_of(a) + self.text_of(b)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The codes of each text; characters above the limit become code 0."""
        if not texts:
            return []
        codes = joined(texts, self.first)
        for i, pair in enumerate(self.pairs):
            codes = contract(codes, pair, self.first + i)
        return [x[:-1] for x in np.split(codes, np.flatnonzero(codes == BREAK)[:-1] + 1)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, codes: list[int]) -> str:
        return "".join(map(self.text_of, codes))


def _few(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Rows of a batch, few of them Python objects at once."""
    for at in range(0, batch.num_rows, TEXTS):
        some = batch.slice(at, TEXTS)
        yield from zip(*[some.column(c).to_pylist() for c in columns], strict=True)


#: Blocks of strings; codes are compressed, since an executor holds a batch of blocks several times over.
STATE = "codes binary, size bigint, times binary"


def _packed(codes: np.ndarray, times: bytes) -> pa.RecordBatch:
    packed = pa.compress(codes.tobytes(), codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([codes.nbytes], pa.int64()), pa.array([times], pa.binary())], ["codes", "size", "times"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bytes]]:
    """(codes, times) of each block of a batch."""
    for c, n, t in zip(*(batch.column(x) for x in ("codes", "size", "times")), strict=True):
        yield np.frombuffer(pa.decompress(c.as_buffer(), n.as_py(), codec="zstd"), np.int32), t.as_py()


def _blocks(strings: DataFrame, first: int) -> DataFrame:
    """(codes, size, times): distinct strings and how often each occurs, in blocks of arrays."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(texts, times):
            return _packed(joined(texts, first), np.array(times, dtype=np.int64).tobytes())

        texts, times, size = [], [], 0
        for batch in batches:
            for t, n in _few(batch, "s", "times"):
                if texts and size + len(t) >= BLOCK_CODES:
                    yield block(texts, times)
                    texts, times, size = [], [], 0
                texts.append(t)
                times.append(n)
                size += len(t) + 1
        if texts:
            yield block(texts, times)

    rows = strings.groupBy("s").agg(F.count("*").alias("times"))
    return rows.repartition(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s").mapInArrow(build, STATE)


def _counted(state: DataFrame, done: list[tuple[tuple[int, int], int]], new: list[tuple[tuple[int, int], int]] | None) -> DataFrame:
    """(pair, n) after the merges `done`: of all pairs, or what the merges `new` change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, t in _unpacked(batch):
                times, parts = np.frombuffer(t, np.int64), []
                for pair, code in done:
                    codes = contract(codes, pair, code)
                if new is None:
                    parts.append(pair_counts(codes, times, np.arange(len(codes))))
                for pair, code in new or []:
                    at = found(codes, pair)
                    if len(at):
                        parts.append(pair_counts(codes, times, np.unique(np.concatenate([at - 1, at, at + 1])), -1))
                        codes = contract(codes, pair, code, at)
                        made = np.flatnonzero(codes == code)
                        parts.append(pair_counts(codes, times, np.unique(np.concatenate([made - 1, made]))))
                if parts:
                    pairs, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return state.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def _written(state: DataFrame, done: list[tuple[tuple[int, int], int]]) -> DataFrame:
    """The blocks with the merges in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, times in _unpacked(batch):
                for pair, code in done:
                    codes = contract(codes, pair, code)
                yield _packed(codes, times)

    return materialize(state.mapInArrow(run, STATE), "codes")


def _round(held: dict[int, int], sizes: list[int], first: int, least: int, most: int) -> list[tuple[int, int]]:
    """The next merges, as single steps would choose them, as many as are certain together. Merging
    a pair leaves the counts of pairs without its symbols alone, and the new pairs that it makes
    are no more frequent than those it is next to. So a pair is next as long as it shares no
    symbol with those before it, and no pair that does is as frequent. A pair of one symbol
    twice makes pairs of its own kind and ends the round."""
    size = lambda c: 1 if c < first else sizes[c - first]
    split = lambda p: (p >> 32, p & 0xFFFFFFFF)
    key = lambda x: (x[1], size(x[0] >> 32) + size(x[0] & 0xFFFFFFFF), split(x[0]))
    top = heapq.nlargest(LOOK, held.items(), key=key)
    chosen, used, more = [], set(), len(top) == LOOK
    for p, n in top:
        a, b = split(p)
        tied = chosen and (more and n == top[-1][1] or any(m == n and q != p and used & set(split(q)) for q, m in top))
        if n <= least or len(chosen) == most or used & {a, b} or tied:
            break
        chosen.append((a, b))
        used |= {a, b}
        if a == b:
            break
    return chosen


def bpe_train(strings: DataFrame, text: str = "s", max_vocab: int = 10_000, limit: str | int = "unicode", min_count: int = 1) -> Merges:
    """Merge the pair with the largest (count, length, codes) until its count is at most min_count
    or 1, or the vocabulary is full.

    Pair counts are kept and changed only by what merges change. Pairs of old symbols only become
    rarer and pairs of a new symbol are counted when it is made, so the driver need hold only
    the HELD most frequent pairs and is exact until the best of them is no more frequent than those
    it left out; then all are counted anew. A round of several merges is one job, whose tasks
    repeat the merges since the strings were last written."""
    first = (LIMITS[limit] if isinstance(limit, str) else limit) + 1
    merges, sizes, least = Merges(first, []), [], max(1, min_count)
    known = strings.where(F.col(text).isNotNull()).select(F.col(text).alias("s"))
    characters = known.select(F.explode(F.split("s", "")).alias("c")).distinct().count()
    state = materialize(_blocks(known, first), "codes")
    done: list[tuple[tuple[int, int], int]] = []
    held, floor = {}, None
    while characters + len(merges.pairs) < max_vocab:
        if floor is None or floor and max(held.values(), default=0) <= floor:
            top = _counted(state, done, None).where(F.col("n") > least).orderBy(F.desc("n")).limit(HELD + 1).toArrow()
            n = top["n"].to_numpy()
            floor = int(n[-1]) if len(n) > HELD else 0
            held = {p: c for p, c in zip(top["pair"].to_pylist(), n.tolist(), strict=True) if c > floor}
            if floor and not held:  # more pairs tie than the driver looks at: hold them all
                held = {r["pair"]: r["n"] for r in _counted(state, done, None).where(F.col("n") >= floor).toLocalIterator()}
                floor -= 1
        chosen = _round(held, sizes, first, max(least, floor), max_vocab - characters - len(merges.pairs))
        if not chosen:
            break
        new = [(pair, first + len(merges.pairs) + i) for i, pair in enumerate(chosen)]
        merges.pairs += chosen
        for a, b in chosen:
            sizes.append(sum(1 if c < first else sizes[c - first] for c in (a, b)))
        change = _counted(state, done, new).toArrow()
        made = {code for _, code in new}
        for p, n in zip(change["pair"].to_pylist(), change["n"].to_pylist(), strict=True):
            if p in held:
                held[p] += n
            elif n > floor and (p >> 32 in made or p & 0xFFFFFFFF in made):
                held[p] = n
        for a, b in chosen:
            held.pop(a << 32 | b, None)
        done += new
        if len(done) >= PENDING:
            after = _written(state, done)
            release(state)
            state, done = after, []
    release(state)
    return merges


def bpe_encode(strings: DataFrame, merges: Merges, id: str = "id", text: str = "s", tokens: bool = True) -> DataFrame:
    """(id, tokens): strings as lists of token strings, or of codes. Tasks hold the codes of a block of
    strings at once, and labels only once for each code; no token is a Python string of its own."""
    shared = strings.sparkSession.sparkContext.broadcast(merges)

    def lists(texts: list[str | None]) -> pa.Array:
        out = shared.value.encode_all(texts)
        ends = np.cumsum([0, *map(len, out)])
        codes = np.concatenate(out)
        if not tokens:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, pa.int32()))
        used, at = np.unique(codes, return_inverse=True)
        labels = pa.array([shared.value.text_of(c) for c in used.tolist()], pa.string())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), labels.take(pa.array(at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, begin = [], 0, 0

            def encoded(texts: list[str | None], begin: int, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column("id").slice(begin, len(texts)), lists(texts)], ["id", "tokens"])

            for (t,) in _few(batch, "s"):
                if texts and size + len(t or "") >= BLOCK_CODES:
                    yield encoded(texts, begin)
                    texts, size, begin = [], 0, begin + len(texts)
                texts.append(t)
                size += len(t or "") + 1
            if texts:
                yield encoded(texts, begin)

    rows = strings.select(F.col(id).alias("id"), F.col(text).alias("s"))
    schema = T.StructType([rows.schema["id"], T.StructField("tokens", T.ArrayType(T.StringType() if tokens else T.IntegerType()))])
    return rows.mapInArrow(run, schema)
