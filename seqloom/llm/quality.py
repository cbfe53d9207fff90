"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text (lengths, shares of character classes, repetition) are standardised and
mapped by cosines of random projections, whose inner products approximate a Gaussian kernel.
Normal equations of the ridge fit are sums over rows, so each task sums its own and only sums
are shuffled; they are kept for a few folds, and the scores that calibrate come from fits that
did not see the row. Pool-adjacent-violators over a fixed grid of scores gives the calibration.

Every labelled row is used; nothing is sampled. The model is a few arrays whose size depends
on FEATURES alone. Inputs of a score are statistics of the text only.

Defined cases: a null text is an empty one and has a score like any other; labels that are null
are ignored, a document with several labels counts as their majority (ties: 1); without any
label, or with one class only, every score is that class's share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FEATURES, FOLDS, RIDGE, GRID, SEED = 192, 4, 1e-3, 2000, 20240
STATS = [
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digits", "stops", "commas", "symbols", "excited",
    "marks", "high", "lines", "line_repeats", "word_variety", "entropy", "top_byte", "upper_words",
]
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "stops": b".;:", "commas": b",",
    "symbols": b"#$%&*@^~|<>{}[]\\/_=+`", "excited": b"!?", "marks": b"'\"()-", "high": range(128, 256), "lines": b"\n",
}
_SELECT = np.array([[b in set(c) for b in range(256)] for c in _CLASSES.values()], dtype=np.float64)


def text_stats(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n, words, rows = len(data), data.split(), data.split(b"\n")
    share = counts[counts > 0] / n
    counts[32] = 0
    w = max(1, len(words))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(sum(map(len, words)) / w), *(_SELECT @ counts / n),
        1 - len(set(rows)) / len(rows), len(set(words)) / w, float(-(share * np.log(share)).sum()), counts.max() / n,
        sum(map(bytes.isupper, words)) / w,
    ]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_stats(t) for t in texts], dtype=object)

    return docs.withColumn("stats", stats(F.col(text)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        wave = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase)
        return np.hstack([np.ones((len(z), 1)), wave])

    def calibrate(self, raw: np.ndarray) -> np.ndarray:
        """The isotonic fit, with a small slope so that its steps keep the raw order."""
        return 0.99 * np.interp(raw, self.knots, self.values) + 0.01 * np.clip(raw, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.calibrate(self.features(stats) @ self.weights[-1])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: means y of n rows at increasing x -> centres and values of the pools."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _stack(df: pd.DataFrame) -> np.ndarray:
    return np.stack(df["stats"].to_numpy()) if len(df) else np.zeros((0, len(STATS)))


def fit(train: DataFrame) -> Model:
    """train(stats, label, fold): label 0 or 1, fold 0 to FOLDS - 1."""
    d = len(STATS)
    moments = train.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, scale = np.zeros(d), np.ones(d)
    for r in moments:
        mean[r["i"]], scale[r["i"]] = r["m"], max(r["s"], 1e-6)
    rng = np.random.default_rng(SEED)
    omega = rng.normal(size=(d, FEATURES)) / np.sqrt(2 * d)
    model = Model(mean, scale, omega, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros((FOLDS + 1, FEATURES + 1)), np.array([0.0]), np.array([0.5]))
    shared = train.sparkSession.sparkContext.broadcast(model)
    size = FEATURES + 1

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((FOLDS, size, size + 1))
        for df in frames:
            x, y, fold = shared.value.features(_stack(df)), df["label"].to_numpy(float), df["fold"].to_numpy()
            for k in range(FOLDS):
                at = fold == k
                sums[k] += x[at].T @ np.hstack([x[at], y[at, None]])
        if sums.any():
            yield pd.DataFrame({"fold": np.repeat(np.arange(FOLDS), size), "row": np.tile(np.arange(size), FOLDS), "v": list(sums.reshape(-1, size + 1))})

    def add(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": df["fold"].iloc[:1], "row": df["row"].iloc[:1], "v": [np.sum(df["v"].to_list(), axis=0)]})

    schema = "fold int, row int, v array<double>"
    sums = np.zeros((FOLDS, size, size + 1))
    # one row of each matrix from each task meets in a group; the result has FOLDS * size rows
    for r in train.select("stats", "label", "fold").mapInPandas(partial, schema).groupBy("fold", "row").applyInPandas(add, schema).collect():
        sums[r["fold"], r["row"]] = r["v"]
    count = sums[:, 0, 0].sum()
    if count == 0:
        return model
    whole = sums.sum(axis=0)
    share = whole[0, -1] / count
    if share in (0.0, 1.0):
        model.values = np.array([share])
        return model
    for k in range(FOLDS + 1):
        part = whole - sums[k] if k < FOLDS else whole
        model.weights[k] = np.linalg.solve(part[:, :-1] + RIDGE * max(1.0, part[0, 0]) * np.eye(size) / size, part[:, -1])
    return _calibrated(train, model)


def _calibrated(train: DataFrame, model: Model) -> Model:
    shared = train.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def bin_of(stats: pd.Series, fold: pd.Series) -> pd.Series:
        m = shared.value
        raw = (m.features(np.stack(stats.to_numpy())) * m.weights[fold.to_numpy()]).sum(axis=1)
        return pd.Series(np.floor(np.clip(raw + 0.5, 0, 1.9999) / 2 * GRID).astype(np.int32))

    rows = train.groupBy(bin_of("stats", "fold").alias("bin")).agg(F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    x = np.array([(r["bin"] + 0.5) / GRID * 2 - 0.5 for r in rows])
    model.knots, model.values = isotonic(x, np.array([r["y"] for r in rows]), np.array([r["n"] for r in rows], dtype=float))
    return model


def held_out(id: str = "doc_id"):
    """True for the documents whose labels may not be learnt from."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", predict_at: float = 0.7, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs, and the columns of `keep`."""
    keep = keep or {}
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), *[c.alias(f"keep_{k}") for k, c in keep.items()])
    rows = materialize(with_stats(rows).drop("text"), "stats")
    known = labels.where(F.col(label).isNotNull() & ~held_out(id)).groupBy(F.col(id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    train = rows.join(known, "id").withColumn("fold", F.pmod(F.shiftright(F.crc32(F.col("id").cast("string").cast("binary")), 2), F.lit(FOLDS)).cast("int"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(materialize(train, "train")))

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(np.round(shared.value.score(np.stack(stats.to_numpy())), 9))

    out = rows.select(F.col("id").alias(id), held_out("id").alias("held_out"), score("stats").alias("score"), *[F.col(f"keep_{k}").alias(k) for k in keep])
    return out.withColumn("predicted", (F.col("score") >= predict_at).cast("int"))
