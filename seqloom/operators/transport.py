"""Optimal-transport vectors of distributions over a metric space.

Distributions are weights (row_id, col_id, value) and vectors (col_id, vec). Each row's points
travel as arrays, a bounded number a row, and are solved in Arrow batches against a small set of
reference points that every task gets. Vectors of rows are then compressed by a distributed SVD."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialize
from . import linalg


def cosine_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.maximum(0.0, 1 - unit(a) @ unit(b).T)


def euclidean_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T))


def manhattan_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)


#: Rows that share the arrays of a Sinkhorn iteration.
SINKHORN_ROWS = 64
METRICS: dict[str, Callable] = {"cosine": cosine_cost, "euclidean": euclidean_cost, "manhattan": manhattan_cost}


def metric_of(metric: str | Callable) -> Callable:
    if callable(metric):
        return metric
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: {sorted(METRICS)}")
    return METRICS[metric]


def pairwise(rows: DataFrame, points: np.ndarray, metric: str | Callable = "cosine", vec: str = "vec", block: int = 256) -> DataFrame:
    """Add `distances`, those of each row's vector to a bounded set of points, in blocks of rows."""
    shared, f = rows.sparkSession.sparkContext.broadcast(np.asarray(points, dtype=float)), metric_of(metric)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        parts = [f(np.stack(x.iloc[i : i + block].to_list()).astype(float), shared.value) for i in range(0, len(x), block)]
        return pd.Series([d for p in parts for d in p], dtype=object)

    return rows.withColumn("distances", run(vec))


class _Basis:
    """A spanning tree of sources 0 .. n - 1 and sinks n .. n + m - 1: each node's parent, depth,
    children and the flow between it and its parent; u and v are the potentials at which the
    tree's costs vanish."""

    def __init__(self, cells: dict[tuple[int, int], float], cost: np.ndarray):
        n, m = cost.shape
        near: list[list[tuple[int, float]]] = [[] for _ in range(n + m)]
        for (i, j), f in cells.items():
            near[i].append((n + j, f))
            near[n + j].append((i, f))
        self.n, self.u, self.v = n, np.zeros(n), np.zeros(m)
        self.parent, self.depth, self.flow = [-1] * (n + m), [0] * (n + m), [0.0] * (n + m)
        self.children: list[set[int]] = [set() for _ in range(n + m)]
        todo = [0]
        while todo:
            x = todo.pop()
            for y, f in near[x]:
                if y != self.parent[x]:
                    self.parent[y], self.depth[y], self.flow[y] = x, self.depth[x] + 1, f
                    self.children[x].add(y)
                    if y >= n:
                        self.v[y - n] = cost[x, y - n] - self.u[x]
                    else:
                        self.u[y] = cost[y, x - n] - self.v[x - n]
                    todo.append(y)

    def enter(self, i: int, j: int, gain: float) -> None:
        """Send as much as fits from source i to sink j, and let the arc that empties first go."""
        n, x, y = self.n, i, self.n + j
        sides: tuple[list[int], list[int]] = ([], [])
        while x != y:
            if self.depth[x] >= self.depth[y]:
                sides[0].append(x)
                x = self.parent[x]
            else:
                sides[1].append(y)
                y = self.parent[y]
        # what i sends to j it sends elsewhere no more, and j needs no more from elsewhere
        less = [(self.flow[x], s, x) for s in (0, 1) for x in sides[s] if (x < n) == (s == 0)]
        amount, side, last = min(less)
        for s in (0, 1):
            for x in sides[s]:
                self.flow[x] += -amount if (x < n) == (s == 0) else amount
        # the part of the tree below the arc that goes hangs on the new arc
        self.children[self.parent[last]].discard(last)
        x, above, f = (i, n + j, amount) if side == 0 else (n + j, i, amount)
        while True:
            old, old_flow = self.parent[x], self.flow[x]
            if x != last:
                self.children[old].discard(x)
            self.parent[x], self.flow[x] = above, f
            self.children[above].add(x)
            if x == last:
                break
            above, x, f = x, old, old_flow
        top = i if side == 0 else n + j
        todo, sources, sinks = [top], [], []
        while todo:
            x = todo.pop()
            self.depth[x] = self.depth[self.parent[x]] + 1
            (sources if x < n else sinks).append(x)
            todo.extend(self.children[x])
        shift = gain if side == 0 else -gain
        self.u[sources] += shift
        self.v[np.array(sinks, dtype=int) - n] -= shift


def transport_plan(p: np.ndarray, q: np.ndarray, cost: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """An optimal plan between masses p and q, by the network simplex on a spanning tree in arrays.
    start: potentials of q that a similar problem ended with, for a better first tree; see
    solve_transport."""
    return solve_transport(p, q, cost, start)[0]


def solve_transport(p: np.ndarray, q: np.ndarray, cost: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(plan, potentials of q)."""
    n, m = cost.shape
    left, need = p / p.sum(), q / q.sum()
    tiny = 1e-13 / (n + 1)
    left = left + tiny  # no tree has an arc without flow
    need = need.copy()
    need[-1] += left.sum() - need.sum()
    cells, rows, columns = {}, np.ones(n, bool), np.ones(m, bool)
    a, b = left.copy(), need.copy()
    # the cheapest cells first, each filled; a source or a sink is done with it, never both
    for k in np.argsort(cost if start is None else cost - start, axis=None).tolist():
        i, j = divmod(k, m)
        if rows[i] and columns[j]:
            f = min(a[i], b[j])
            cells[i, j] = f
            a[i], b[j] = a[i] - f, b[j] - f
            if len(cells) == n + m - 1:
                break
            if (a[i] <= b[j] and rows.sum() > 1) or columns.sum() == 1:
                rows[i] = False
            else:
                columns[j] = False
    tree = _Basis(cells, cost)
    least = 1e-12 * max(1.0, float(np.abs(cost).max()))
    for _ in range(50 * (n + m) + n * m):
        gain = cost - tree.u[:, None] - tree.v
        k = int(gain.argmin())
        i, j = divmod(k, m)
        if gain[i, j] >= -least:
            break
        tree.enter(i, j, float(gain[i, j]))
    flow = np.zeros((n, m))
    for x, up in enumerate(tree.parent):
        if up >= 0:
            flow[(x, up - n) if x < n else (up, x - n)] = tree.flow[x]
    return np.where(flow > 1e-12, flow, 0.0), tree.v


def sinkhorn_plans(masses: list[np.ndarray], q: np.ndarray, costs: list[np.ndarray], regularization: float = 0.05, rounds: int = 1000, tolerance: float = 1e-9) -> list[np.ndarray]:
    """Entropic plans of many rows against one reference, all at once over arrays padded to the
    largest row. Potentials are scaled as logarithms, so none overflows, and the regularisation
    comes down by halves from the costs' own size, each step from the potentials before. A row
    stops on its own marginal error and does not depend on the others."""
    size, m = max(map(len, masses)), len(q)
    log_p, cost = np.full((len(masses), size), -np.inf), np.zeros((len(masses), size, m))
    for k, (p, c) in enumerate(zip(masses, costs, strict=True)):
        with np.errstate(divide="ignore"):
            log_p[k, : len(p)] = np.log(np.asarray(p, float) / np.sum(p))
        cost[k, : len(p)] = c
    with np.errstate(divide="ignore"):
        log_q = np.log(q / q.sum())
    f, g = np.zeros((len(masses), size)), np.zeros((len(masses), m))
    scale = np.array([max(regularization, float(np.max(c, initial=0.0))) for c in costs])

    def soft(x: np.ndarray, axis: int) -> np.ndarray:
        top = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
        return np.log(np.maximum(np.exp(x - top).sum(axis=axis), 1e-300)) + top.squeeze(axis)

    todo = np.arange(len(masses))
    eps = scale.copy()
    steps = np.zeros(len(masses), dtype=int)
    while len(todo):
        e = eps[todo][:, None]
        x, lp = cost[todo] / e[:, :, None], log_p[todo]
        pad = ~np.isfinite(lp)
        h = np.where(pad, -np.inf, f[todo] / e)
        gg = log_q - soft(h[:, :, None] - x, 1)
        ff = np.where(pad, 0.0, lp - soft(gg[:, None, :] - x, 2))
        f[todo], g[todo] = ff * e, gg * e
        steps[todo] += 1
        check = steps[todo] % 10 == 1
        if check.any():
            mass = np.exp(soft(np.where(pad, -np.inf, ff)[:, :, None] + gg[:, None, :] - x, 1))
            error = np.abs(mass - q / q.sum()).sum(axis=1)
            final = eps[todo] <= regularization
            settled = check & (error <= np.where(final, tolerance, 1e-3)) | (steps[todo] >= np.where(final, rounds, 100))
            move = todo[settled & ~final]
            eps[move], steps[move] = np.maximum(regularization, eps[move] / 2), 0
            todo = todo[~(settled & final)]
    plans = []
    for k, p in enumerate(masses):
        n = len(p)
        with np.errstate(invalid="ignore"):
            h = np.where(np.isfinite(log_p[k, :n]), f[k, :n], -np.inf)
        plans.append(np.exp((h[:, None] + g[k] - cost[k, :n]) / regularization))
    return plans


def sinkhorn_plan(p: np.ndarray, q: np.ndarray, cost: np.ndarray, regularization: float = 0.05, rounds: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """An entropic plan; its first marginal is exact, the second within the tolerance."""
    return sinkhorn_plans([p], q, [cost], regularization, rounds, tolerance)[0]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def lot_vector(weights: np.ndarray, points: np.ndarray, ref: np.ndarray, ref_mass: np.ndarray, metric: str | Callable = "cosine", method: str = "exact", regularization: float = 0.05, plan: np.ndarray | None = None) -> np.ndarray:
    """The images of the reference points under the transport to a distribution, less the points;
    on the sphere, in its tangent space and scaled by the cosine distance."""
    if plan is None:
        cost = metric_of(metric)(points, ref)
        plan = transport_plan(weights, ref_mass, cost) if method == "exact" else sinkhorn_plan(weights, ref_mass, cost, regularization)
    image = (plan / ref_mass).T @ points
    if metric != "cosine":
        return (image - ref).ravel()
    image = _unit(image)
    out = image - ref
    out = _unit(out - (out * ref).sum(axis=1, keepdims=True) * ref) * np.maximum(0, 1 - (image * ref).sum(axis=1, keepdims=True))
    flat = out.ravel()
    return np.sign(flat) * np.sqrt(np.abs(flat)) if method == "exact" else flat


@dataclass
class Reference:
    points: np.ndarray
    mass: np.ndarray


def packed_rows(coo: DataFrame, vectors: DataFrame, max_size: int = 256) -> DataFrame:
    """(row_id, weights, points): the heaviest points of each row, at most max_size."""
    w = Window.partitionBy("row_id").orderBy(F.desc("value"), "col_id")
    top = coo.where(F.col("value") > 0).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= max_size)
    met = top.join(vectors, "col_id").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("__k", "value", "vec"))).alias("e"))
    return met.select("row_id", F.transform("e", lambda e: e["value"]).alias("weights"), F.transform("e", lambda e: e["vec"]).alias("points"))


def reference_of(packed: DataFrame, size: int | None = None, scale: float = 0.01, metric: str | Callable = "cosine", seed: int = 42) -> Reference:
    """Points around the mean of all rows' means; by default as many as a row has in the median."""
    means = packed.select(F.size("weights").alias("n"), F.transform("points", lambda p: p).alias("points"), "weights")

    @F.pandas_udf("array<double>")
    def mean(points: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([np.average(np.stack([np.asarray(v, float) for v in p]), axis=0, weights=np.asarray(w, float)) for p, w in zip(points, weights, strict=True)], dtype=object)

    rows = means.select("n", F.posexplode(mean("points", "weights")).alias("k", "x"))
    centre = np.array([r["x"] for r in rows.groupBy("k").agg(F.avg("x").alias("x")).orderBy("k").collect()])
    size = size or max(1, int(packed.agg(F.percentile_approx(F.size("weights"), 0.5)).first()[0]))
    points = centre + np.random.default_rng(seed).normal(scale=scale, size=(size, len(centre)))
    return Reference(_unit(points) if metric == "cosine" else points, np.full(size, 1 / size))


def ot_vectors(packed: DataFrame, reference: Reference, method: str = "exact", metric: str | Callable = "cosine", regularization: float = 0.05) -> DataFrame:
    """(row_id, vec) of rows (row_id, weights, points)."""
    if method not in ("exact", "sinkhorn"):
        raise ValueError("the method is exact or sinkhorn")
    shared = packed.sparkSession.sparkContext.broadcast(reference)

    @F.pandas_udf("array<double>")
    def run(weights: pd.Series, points: pd.Series) -> pd.Series:
        ref, cost_of, out, start = shared.value, metric_of(metric), [None] * len(weights), None
        masses = [np.asarray(w, float) for w in weights]
        rows = [np.stack([np.asarray(v, dtype=float) for v in p]) for p in points]
        rows = [_unit(x) for x in rows] if metric == "cosine" else rows
        # rows of like size share an array; an exact plan starts from the potentials of the one before
        order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
        for at in range(0, len(order), SINKHORN_ROWS):
            part = order[at : at + SINKHORN_ROWS]
            costs = [cost_of(rows[k], ref.points) for k in part]
            if method == "sinkhorn":
                plans = sinkhorn_plans([masses[k] for k in part], ref.mass, costs, regularization)
            else:
                plans = []
                for k, c in zip(part, costs, strict=True):
                    plan, start = solve_transport(masses[k], ref.mass, c, start)
                    plans.append(plan)
            for k, plan in zip(part, plans, strict=True):
                out[k] = lot_vector(masses[k], rows[k], ref.points, ref.mass, metric, method, regularization, plan)
        return pd.Series(out, dtype=object)

    return packed.select("row_id", run("weights", "points").alias("vec"))


def compressed(rows: DataFrame, k: int = 128, n_iter: int = 7, sketch: int | None = None) -> tuple[linalg.Factors, DataFrame]:
    """(factors, (row_id, embedding)) of dense rows (row_id, vec). sketch: singular vectors in one pass,
    from so many frequent directions, for rows that are dear to make again."""
    rows = materialize(rows, "vectors")  # read several times, dear to make
    first = rows.first()
    d = len(first["vec"]) if first else 0
    coo = rows.select("row_id", F.posexplode("vec").alias("col_id", "value"))
    if sketch is not None:
        factors = linalg.frequent_directions(rows, "vec", sketch).factors(min(k, d))
    else:
        factors = linalg.svd(coo, d, min(k, d), n_iter)
    return factors, linalg.project(coo, factors)


def heaviest(rows: DataFrame, size: int) -> DataFrame:
    """(row_id, weights, points) with at most `size` points a row, the heaviest, ties in their order."""
    pairs = F.transform(F.arrays_zip("weights", "points"), lambda x, i: F.struct((-x["weights"]).alias("w"), i.alias("i"), x["points"].alias("p")))
    top = F.slice(F.array_sort(pairs), 1, size)
    out = rows.withColumn("__top", F.when(F.size("weights") > size, top))
    pick = lambda name, old: F.when(F.col("__top").isNull(), F.col(old)).otherwise(F.transform("__top", lambda x: -x["w"] if name == "w" else x["p"]))
    return out.withColumns({"weights": pick("w", "weights"), "points": pick("p", "points")}).drop("__top")


def mean_vectors(coo: DataFrame, vectors: DataFrame, power: float = 1.0) -> DataFrame:
    """(row_id, vec): weighted sums of vectors over the row's mass to a power."""
    return linalg.weighted_sums(coo, vectors, power)
