"""Fitted models on streams: encoding and counting new documents as they come, and vocabularies
that grow by merging the counts of each batch, and windows that go on from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import vocab as V
from ..sources.sequences import tokens_of_text


def known_tokens(stream: DataFrame, vocab: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, idx) of a stream of documents: a stream-static join, without state. Positions
    are those of the whole text, since closing them up would need a sort."""
    return tokens_of_text(stream, id, text).join(vocab.select("token", "idx"), "token").drop("token")


def windowed_counts(stream: DataFrame, vocab: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour", text: str = "text") -> DataFrame:
    """(window, idx, n): counts of known tokens in windows of event time. State is bounded by the
    vocabulary times the windows that the watermark keeps open."""
    rows = stream.withWatermark(time, late).select(F.col(time).alias("t"), F.explode(F.split(text, " ")).alias("token"))
    met = rows.join(vocab.select("token", "idx"), "token")
    return met.groupBy(F.window("t", window), "idx").agg(F.count("*").alias("n"))


def merge_into(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds each batch's token counts under path/batch=N; a batch that is
    tried again overwrites itself, so counts stay exact."""

    def sink(batch: DataFrame, number: int) -> None:
        V.counts(tokens_of_text(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def merged_counts(spark, path: str) -> DataFrame:
    """(token, n, df) over all batches so far; prune and index it as any other counts."""
    return spark.read.parquet(path).groupBy("token").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def pairs_over_batches(stream: DataFrame, radius: int, kind: str = "bigint") -> DataFrame:
    """(doc_id, head, tail, d) of a stream of token rows (doc_id, pos, idx): every token and those that
    come up to `radius` places after it, d places on, whether or not a batch ends between them. The
    state of a sequence is its last `radius` tokens. Tokens of a sequence must come in the order
    of pos from batch to batch; within one they may come in any."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(frames)).sort_values("pos")
        held = list(state.get[0]) if state.exists else []
        tokens = np.array([*held, *df["idx"]], dtype=np.int64)
        new = np.arange(len(tokens)) >= len(held)
        parts = []
        for d in range(1, radius + 1):
            tail = np.flatnonzero(new[d:]) + d
            parts.append(pd.DataFrame({"doc_id": [key[0]] * len(tail), "head": tokens[tail - d], "tail": tokens[tail], "d": d}))
        state.update((tokens[max(0, len(tokens) - radius) :].tolist(),))
        yield pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "head": [], "tail": [], "d": []})

    rows = stream.select("doc_id", "pos", F.col("idx").cast("long").alias("idx"))
    return rows.groupBy("doc_id").applyInPandasWithState(step, f"doc_id {kind}, head bigint, tail bigint, d int", "tokens array<bigint>", "append", GroupStateTimeout.NoTimeout)
