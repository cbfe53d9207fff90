"""Token counts with overlap resynchronisation for huge documents.

A text of more than `chunk` characters becomes chunks that overlap, each a row of its own, so
one document spreads over many tasks. Every chunk reports where the pre-tokeniser's words begin
inside its two overlaps and how many tokens lie before. The pre-tokeniser never looks back, so
once two neighbouring chunks both begin a word at one place, all that follows is the same in
both; the counts are spliced there. (The place must also be far enough before the earlier
chunk's end for no look-ahead to have met the end.) Where an overlap holds no such place, the
document is done again with a wider overlap, in the end as one chunk.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows;
a null id stays null and crosses to Python as a flag, so that no id becomes a floating number;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .encoder import batches_of, encoder

CHUNK, OVERLAP, GUARD = 1 << 15, 512, 32
#: A document's key: whether it has no id, its id or 0, and two hashes of its text, so that equal
#: ids do no harm.
KEY = ["no_id", "id", "a", "b"]
_KEY = "no_id boolean, id bigint, a bigint, b bigint"
_PART = f"{_KEY}, n_bytes bigint, k int, chunks int, n int, head array<struct<p:bigint,n:bigint>>, tail array<struct<p:bigint,n:bigint>>"


def _pairs(p: np.ndarray, n: np.ndarray) -> list[dict]:
    return [{"p": int(x), "n": int(y)} for x, y in zip(p, n, strict=True)]


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """docs(no_id, id, text) -> (key, k, chunks, start, piece); a text no longer than a chunk is one."""
    text = F.col("text")
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / chunk) - 1).cast("int")
    rows = _keyed(docs).select(*KEY, "text", F.octet_length(text).cast("long").alias("n_bytes"), (last + 1).alias("chunks"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    # the last chunk runs to the end of the text
    piece = F.when(F.col("chunks") == 1, text).when(F.col("k") == F.col("chunks") - 1, F.substr(text, F.col("k") * chunk + 1)).otherwise(
        F.substr(text, F.col("k") * chunk + 1, F.lit(chunk + overlap))
    )
    return rows.select(*KEY, "n_bytes", "k", "chunks", (F.col("k").cast("long") * chunk).alias("start"), piece.alias("piece"))


def _count_parts(rows: DataFrame, path: str, overlap: int) -> DataFrame:
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for df in frames:
            single = (df["chunks"] == 1).to_numpy()
            counts = np.zeros(len(df), dtype=np.int32)
            heads, tails = [[] for _ in counts], [[] for _ in counts]
            texts = df["piece"].tolist()
            at = np.flatnonzero(single)
            some = [texts[i] for i in at]
            for a, b in batches_of(some):
                counts[at[a:b]] = [len(x) // 4 for x in enc.encode(some[a:b])]
            for i in np.flatnonzero(~single):
                row = df.iloc[i]
                p, n, counts[i] = enc.boundaries(texts[i])
                length = len(texts[i])
                if row["k"] > 0:
                    heads[i] = _pairs(p[p < overlap] + row["start"], n[p < overlap])
                if row["k"] < row["chunks"] - 1:
                    m = (p >= length - overlap) & (p < length - GUARD)
                    tails[i] = _pairs(p[m] + row["start"], n[m])
            yield df[[*KEY, "n_bytes", "k", "chunks"]].assign(n=counts, head=heads, tail=tails)

    return rows.mapInPandas(count, _PART)


def splice(parts: list[tuple[int, int, list, list]]) -> int | None:
    """Tokens of a text from its chunks (k, n, head, tail) in order; None where some pair of
    neighbours shares no word start."""
    total, since = 0, 0
    for (_, n, _, tail), nxt in zip(parts, [*parts[1:], None], strict=True):
        if nxt is None:
            return total + n - since
        head = {x["p"]: x["n"] for x in nxt[2]}
        met = next((x for x in tail if x["p"] in head), None)
        if met is None or met["n"] < since:
            return None
        total += met["n"] - since
        since = head[met["p"]]
    return total


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of docs. Files without word boundaries that chunks
    could share (all but byte-level BPE .json) are encoded a text at a time."""
    key = F.col(id).cast("long")
    base = docs.select(key.isNull().alias("no_id"), F.coalesce(key, F.lit(0)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not encoder(path).pieces:
        chunk = (1 << 31) - 1 - overlap
    parts = materialize(_count_parts(_chunks(base, chunk, overlap), path, overlap), "parts")
    own = F.when(~F.col("no_id"), F.col("id")).alias(id)
    single = lambda df: df.where(F.col("chunks") == 1).select(own, "n_bytes", F.col("n").cast("long").alias("n_tokens"))
    out, seam = single(parts), overlap
    while True:
        done = materialize(_spliced(parts.where(F.col("chunks") > 1)), "spliced")
        out = out.union(done.where(~F.col("failed")).select(own, "n_bytes", "n_tokens"))
        failed = done.where("failed")
        if failed.isEmpty():
            return out
        seam, chunk = seam * 8, max(chunk, seam * 16)
        again = _keyed(base).join(failed.select(*KEY).distinct(), KEY, "left_semi").select("no_id", "id", "text")
        parts = materialize(_count_parts(_chunks(again, chunk, seam), path, seam), "parts")
        out = out.union(single(parts))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64("text", F.lit(7))})


def _spliced(parts: DataFrame) -> DataFrame:
    """One row for each repetition of a document. Repetitions are counted before the exchange, so
    a group holds the overlaps of one text's chunks."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("k")
        n = splice(list(zip(df["k"], df["n"], df["head"], df["tail"], strict=True)))
        return df[[*KEY, "n_bytes", "times"]].iloc[:1].assign(n_tokens=n or 0, failed=n is None)

    once = parts.groupBy(*KEY, "n_bytes", "k").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("n", "head", "tail")])
    found = once.groupBy(*KEY).applyInPandas(one, f"{_KEY}, n_bytes bigint, times bigint, n_tokens bigint, failed boolean")
    return found.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
