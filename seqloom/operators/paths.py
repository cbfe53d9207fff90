"""Signatures of paths, rows (path_id, points ARRAY<ARRAY<DOUBLE>>)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialize


def multiply(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The signature of a path followed by another: the tensor product of theirs."""
    out = []
    for k in range(len(a)):
        level = a[k] + b[k]
        for i in range(k):
            level = level + np.multiply.outer(a[i], b[k - 1 - i]).ravel()
        out.append(level)
    return out


def of_steps(steps: np.ndarray, level: int = 2) -> list[np.ndarray]:
    """Levels 1 to `level`, flat, of the path that makes the steps: the product of the exponentials
    of its increments."""
    now = [np.zeros(steps.shape[1] ** k) for k in range(1, level + 1)]
    for step in steps:
        e = [step]
        for k in range(2, level + 1):
            e.append(np.multiply.outer(e[-1], step).ravel() / k)
        now = multiply(now, e)
    return now


def signature(path: np.ndarray, level: int = 2) -> list[np.ndarray]:
    """Signature of a piecewise linear path."""
    return of_steps(np.diff(path, axis=0), level)


def log_signature(sig: list[np.ndarray]) -> list[np.ndarray]:
    """The tensor logarithm: sum over n of (-1)^(n+1) / n times powers of the signature less 1."""
    level = len(sig)
    power, out = sig, [x.copy() for x in sig]
    for n in range(2, level + 1):
        nxt = [np.zeros_like(x) for x in sig]
        for i in range(level):
            for j in range(level - i - 1):
                nxt[i + j + 1] = nxt[i + j + 1] + np.multiply.outer(power[i], sig[j]).ravel()
        power = nxt
        out = [o + (-1) ** (n + 1) / n * p for o, p in zip(out, power, strict=True)]
    return out


def lyndon_words(d: int, level: int) -> list[tuple[int, ...]]:
    """Words that are less than all their rotations, by length and then in order."""
    out, w = [], [-1]
    while w:
        w[-1] += 1
        if len(w) <= level:
            out.append(tuple(w))
        m = len(w)
        while len(w) < level:
            w.append(w[-m])
        while w and w[-1] == d - 1:
            w.pop()
    return sorted(out, key=lambda x: (len(x), x))


@cache
def bracket(word: tuple[int, ...]) -> dict[tuple[int, ...], int]:
    """The words and coefficients of a Lyndon word's bracket: of the word uv, whose longest proper
    Lyndon suffix is v, it is [u, v]."""
    if len(word) == 1:
        return {word: 1}
    cut = next(k for k in range(1, len(word)) if all(word[k:] < word[j:] for j in range(k + 1, len(word))))
    out: dict[tuple[int, ...], int] = {}
    u, v = bracket(word[:cut]), bracket(word[cut:])
    for a, x in u.items():
        for b, y in v.items():
            out[a + b] = out.get(a + b, 0) + x * y
            out[b + a] = out.get(b + a, 0) - x * y
    return {w: n for w, n in out.items() if n}


@cache
def _lyndon_basis(d: int, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the places of the Lyndon words, and the matrix from coefficients of brackets to
    coefficients at words, which is triangular: a bracket's other words are greater than its own."""
    out = []
    for n in range(1, level + 1):
        words = [w for w in lyndon_words(d, n) if len(w) == n]
        at = {w: i for i, w in enumerate(words)}
        m = np.zeros((len(words), len(words)))
        for j, w in enumerate(words):
            for other, c in bracket(w).items():
                if other in at:
                    m[at[other], j] = c
        out.append((np.array([_place(w, d) for w in words], dtype=int), m))
    return out


def lyndon_coefficients(log: list[np.ndarray], d: int) -> np.ndarray:
    """A tensor logarithm in the basis of the Lyndon words' brackets, by length and then in order."""
    parts = [np.linalg.solve(m, x[at]) if len(at) else np.zeros(0) for x, (at, m) in zip(log, _lyndon_basis(d, len(log)), strict=True)]
    return np.concatenate(parts)


def signatures(paths: DataFrame, level: int = 2, log: bool = False, basepoint: bool = False) -> DataFrame:
    """(path_id, signature ARRAY). Logarithms are given in the basis of the Lyndon words' brackets. A
    basepoint puts the origin before the path."""
    if level < 1:
        raise ValueError("the level is 1 or more")

    @F.pandas_udf("array<double>")
    def run(points: pd.Series) -> pd.Series:
        out = []
        for p in points:
            x = np.stack([np.asarray(v, dtype=float) for v in p])
            x = np.vstack([np.zeros(x.shape[1]), x]) if basepoint else x
            sig = signature(x, level)
            if log:
                out.append(lyndon_coefficients(log_signature(sig), x.shape[1]))
            else:
                out.append(np.concatenate(sig))
        return pd.Series(out, dtype=object)

    return paths.select("path_id", run("points").alias("signature"))


def signatures_of_rows(rows: DataFrame, coordinates: list[str], level: int = 2, log: bool = False, block: int = 1000, fan: int = 64) -> DataFrame:
    """(path_id, signature ARRAY) of long-form paths (path_id, pos, coordinates..), as signatures()
    gives them, of paths of any length: steps are numbered along the path, a task holds the
    signature of a block of steps at a time, and blocks are multiplied in order, `fan` at a
    time. Paths of one point have none."""
    d = len(coordinates)
    w = Window.partitionBy("path_id").orderBy("pos")
    step = F.array(*[(F.lead(c).over(w) - F.col(c)).cast("double") for c in coordinates])
    last = F.lead(F.lit(True)).over(w).isNull()
    steps = rows.select("path_id", (F.row_number().over(w) - 1).cast("long").alias("n"), last.alias("last"), step.alias("step")).where(~F.col("last"))
    sizes = np.cumsum([d**k for k in range(1, level + 1)])

    def ordered(frames: pd.Series) -> Iterator[np.ndarray]:
        for x in frames:
            yield np.stack(list(x))

    @F.pandas_udf("array<double>")
    def blocks(x: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate(of_steps(s, level)) for s in ordered(x)], dtype=object)

    @F.pandas_udf("array<double>")
    def product(x: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate(reduce(multiply, [np.split(s, sizes[:-1]) for s in m])) for m in ordered(x)], dtype=object)

    def packed(df: DataFrame, size: int, value: str) -> DataFrame:
        groups = df.groupBy("path_id", F.floor(F.col("n") / size).alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("at"), value))).alias("e"))
        return groups.select("path_id", "n", F.transform("e", lambda e: e[value]).alias("e"))

    now = packed(steps, block, "step").select("path_id", "n", blocks("e").alias("s"))
    now = materialize(now, "signatures")
    while (now.agg(F.max("n")).first()[0] or 0) > 0:
        now = materialize(packed(now, fan, "s").select("path_id", "n", product("e").alias("s")), "signatures")
    if not log:
        return now.select("path_id", F.col("s").alias("signature"))

    @F.pandas_udf("array<double>")
    def logarithm(x: pd.Series) -> pd.Series:
        return pd.Series([lyndon_coefficients(log_signature(np.split(np.asarray(s), sizes[:-1])), d) for s in x], dtype=object)

    return now.select("path_id", logarithm("s").alias("signature"))


def _place(word: tuple[int, ...], d: int) -> int:
    return sum(c * d ** (len(word) - 1 - k) for k, c in enumerate(word))


def signature_level2(rows: DataFrame, coordinates: list[str]) -> DataFrame:
    """(path_id, i, j, value) of the level 2 terms, and level 1 as j null, for long-form paths
    (path_id, pos, coordinates..), by window functions alone."""
    w = Window.partitionBy("path_id").orderBy("pos")
    start = Window.partitionBy("path_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = {}
    for c in coordinates:
        cols[f"d_{c}"] = F.col(c) - F.lag(c).over(w)
        cols[f"m_{c}"] = F.lag(c).over(w) - F.first(c).over(start)
    steps = rows.select("path_id", *[v.alias(k) for k, v in cols.items()]).where(F.col(f"d_{coordinates[0]}").isNotNull())
    terms = [F.sum(f"d_{c}").alias(f"s_{i}") for i, c in enumerate(coordinates)]
    terms += [
        F.sum((F.col(f"m_{a}") + 0.5 * F.col(f"d_{a}")) * F.col(f"d_{b}")).alias(f"s_{i}_{j}")
        for i, a in enumerate(coordinates) for j, b in enumerate(coordinates)
    ]
    return steps.groupBy("path_id").agg(*terms)
