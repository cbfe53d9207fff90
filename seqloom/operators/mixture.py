"""Gaussian mixtures of point clouds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_mixture(points: DataFrame, n: int = 20, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of a mixture of all points (cloud_id, point ARRAY)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    if n < 2:
        raise ValueError("a mixture has at least 2 components")
    model = GaussianMixture(k=n, seed=seed, featuresCol="f").fit(points.select(array_to_vector("point").alias("f")))
    rows = model.gaussiansDF.collect()  # n rows
    return np.array([r["mean"].toArray() for r in rows]), np.array([r["cov"].toArray() for r in rows])


def likelihoods(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Normal densities of points under each component, (points, components)."""
    d = means.shape[1]
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covs, strict=True)):
        z = x - m
        out[:, k] = -0.5 * (np.einsum("ij,ij->i", z @ np.linalg.pinv(c), z) + np.linalg.slogdet(c)[1] + d * np.log(2 * np.pi))
    return np.exp(out)


def cloud_vectors(points: DataFrame, means: np.ndarray, covs: np.ndarray) -> DataFrame:
    """(cloud_id, component, value): each point's densities over their sum, added up by cloud."""
    shared = points.sparkSession.sparkContext.broadcast((means, covs))

    @F.pandas_udf("array<double>")
    def shares(p: pd.Series) -> pd.Series:
        like = likelihoods(np.stack(p.to_numpy()).astype(float), *shared.value)
        s = like.sum(axis=1, keepdims=True)
        return pd.Series(list(np.divide(like, s, out=np.zeros_like(like), where=s > 0)), dtype=object)

    rows = points.select("cloud_id", F.posexplode(shares("point")).alias("component", "r"))
    return rows.groupBy("cloud_id", "component").agg(F.sum("r").alias("value"))


def _root(m: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(m)
    return (v * np.sqrt(np.maximum(w, 0))) @ v.T


def wasserstein2_gaussian(m1: np.ndarray, c1: np.ndarray, m2: np.ndarray, c2: np.ndarray) -> float:
    r = _root(c2)
    return float(np.sqrt(max(0.0, ((m1 - m2) ** 2).sum() + np.trace(c1 + c2 - 2 * _root(r @ c1 @ r)))))


def ground_distances(means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Distances of all pairs of components."""
    n = len(means)
    return np.array([[wasserstein2_gaussian(means[i], covs[i], means[j], covs[j]) for j in range(n)] for i in range(n)])
