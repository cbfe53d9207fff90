"""Numeric series: sliding windows, differences, change points, histograms and densities.

Series are rows (series_id, pos, x). Windows of a fixed width are `lead`s over one sort within a
series, or within blocks of a series that is too long for one task; kernels are matrices whose
rows become weighted sums of those columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.halo import blocked
from ..plans.tables import before_parts, ranged


def padded(series: DataFrame, width: int, value: float = 0.0) -> DataFrame:
    """`width` values before and after each series."""
    if width == 0:
        return series
    ends = series.groupBy("series_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    pad = lambda at: ends.select("series_id", F.explode(F.sequence(F.lit(1), F.lit(width))).alias("k"), "lo", "hi").select("series_id", at.alias("pos"), F.lit(value).alias("x"))
    return series.select("series_id", "pos", F.col("x").cast("double")).unionByName(pad(F.col("lo") - F.col("k"))).unionByName(pad(F.col("hi") + F.col("k")))


def sliding_windows(series: DataFrame, width: int = 10, stride: int = 1, sample: list[int] | None = None, pad: int = 0, pad_value: float = 0.0) -> DataFrame:
    """(series_id, start, points ARRAY) of all whole windows; sample picks places of a window."""
    held = blocked(padded(series, pad, pad_value), "series_id", "pos", 0, width - 1)
    at = [F.lead("x", k).over(held.window) for k in range(width)]
    rows = held.rows.select("series_id", *held.extra, held.rank().cast("int").alias("start"), at[-1].isNotNull().alias("whole") if width > 1 else F.lit(True).alias("whole"), F.array(*[at[k] for k in (sample or range(width))]).alias("points"))
    return held.own(rows).where(F.col("whole") & (F.col("start") % stride == 0)).drop("whole")


# Kernels: lists of rows, each a list of weights over the places of a window.


def averaging(n: int) -> list[list[float]]:
    return [[1.0 / n] * n]


def _steps(n: int, pairs: list[tuple[int, int]]) -> list[list[float]]:
    """A row for each pair (from, to) of places: the value at `to` less that at `from`."""
    return [(np.eye(n)[to] - np.eye(n)[at]).tolist() for at, to in pairs]


def differences(n: int, start: int = 0, step: int = 1, stride: int = 1) -> list[list[float]]:
    places = range(start, start + stride * ((n - start - step) // stride), stride)
    return _steps(n, [(at, at + step) for at in places])


def position_velocity(n: int, position: int = 0, step: int = 1, stride: int = 1) -> list[list[float]]:
    """The value at a place, then differences going back from it and forward from it."""
    back = range(0, stride * max(0, (position - step) // stride), stride)
    ahead = range(0, stride * max(0, (n - position - step) // stride), stride)
    return [np.eye(n)[position].tolist()] + _steps(n, [(position - k - step, position - k) for k in back] + [(position + k, position + k + step) for k in ahead])


def weighted(weights: list[float], n: int) -> list[list[float]]:
    if len(weights) != n:
        raise ValueError("as many weights as the window has places")
    return [[w if i == k else 0.0 for i in range(n)] for k, w in enumerate(weights)]


def gaussian_weights(n: int, sigma: float = 1.0) -> list[list[float]]:
    x = np.linspace(-n / 2, n / 2, n)
    return weighted([float(v) for v in np.exp(-((x / sigma) ** 2) / 2) / (2 * np.pi * sigma)], n)


def fold(kernels: list[Callable[[int], list[list[float]]]], n: int) -> list[list[float]]:
    """One matrix of kernels applied in turn, the first to the window."""
    out = np.eye(n)
    for kernel in kernels:
        out = np.array(kernel(out.shape[0])) @ out
    return out.tolist()


def apply_kernel(windows: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Add `values`: the matrix times each window, as sums of its entries that are not zero."""
    rows = []
    for weights in matrix:
        terms = [F.col("points")[i] * w for i, w in enumerate(weights) if w != 0.0]
        rows.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return windows.withColumn("values", F.array(*rows))


def apply_function(windows: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Add `values` from any function on a window's array."""

    @F.pandas_udf("array<double>")
    def run(points: pd.Series) -> pd.Series:
        return pd.Series([np.atleast_1d(np.asarray(f(np.asarray(p, dtype=float)), dtype=float)) for p in points], dtype=object)

    return windows.withColumn("values", run("points"))


def of_values(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Mark a function of a window's values as one, for lists of kernels."""
    f.of_values = True
    return f


def sequential_differences(series: DataFrame, stride: int = 1) -> DataFrame:
    """(series_id, pos, x): x[i + stride] - x[i]."""
    held = blocked(series.select("series_id", "pos", "x"), "series_id", "pos", 0, stride)
    return held.own(held.rows.withColumn("x", F.lead("x", stride).over(held.window) - F.col("x"))).where(F.col("x").isNotNull())


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0, by Stirling's series after eight steps up."""
    steps = F.ln(x)
    for i in range(1, 8):
        steps = steps + F.ln(x + i)
    y = x + 8.0
    series_ = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series_ - steps


def log_binomial(n: Column, k: Column) -> Column:
    """ln C(n, k), whatever their size."""
    return F.when(k < 1, F.lit(0.0)).otherwise(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0))


def count_changepoints(series: DataFrame, width: int = 10, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(series_id, start, score): how unexpected a window's last count is under the negative
    binomial that its other counts predict."""
    held = blocked(series.select("series_id", "pos", F.col("x").cast("long").alias("x")), "series_id", "pos", width - 1, 0)
    before = held.window.rowsBetween(-(width - 1), -1)
    rows = held.own(held.rows.withColumns({"start": (held.rank() + 1 - width).cast("int"), "s": F.sum("x").over(before)}))
    a, b, x = F.lit(alpha) + F.col("s"), beta + width - 1, F.col("x")
    p = 1.0 / (1.0 + b)
    score = -(log_binomial(x + a - 1, x) + a * math.log(1 - p) + x * math.log(p))
    return rows.where(F.col("start") >= 0).select("series_id", "start", score.alias("score"))


def arrival_changepoints(series: DataFrame, width: int = 10, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """The same for gaps between arrivals, through the whole part of their inverse."""
    return count_changepoints(series.withColumn("x", F.floor(1.0 / (F.col("x") + 1e-8))), width, alpha, beta)


# Histograms


def uniform_bins(series: DataFrame, n: int = 20, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, lo, hi], n bins of equal width over the range of the values."""
    ends = series.agg(F.min("x").cast("double").alias("a"), F.max("x").cast("double").alias("b"))
    rows = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    edge = lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / n
    return expanded(rows.select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi")), n, low, high)


def expanded(bins: DataFrame, n: int, low: float | None, high: float | None) -> DataFrame:
    """Stretch the outer bins to an absolute range, by default to infinity."""
    lo, hi = float("-inf") if low is None else low, float("inf") if high is None else high
    return bins.select(
        "bin", F.when(F.col("bin") == 0, F.least("lo", F.lit(lo))).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("bin") == n - 1, F.greatest("hi", F.lit(hi))).otherwise(F.col("hi")).alias("hi"),
    )


def outlier_bins(bins: DataFrame, n: int, low: float = float("-inf"), high: float = float("inf")) -> DataFrame:
    """A bin below and one above n bins whose outer edges are the range of the values."""
    inner = bins.select((F.col("bin") + 1).alias("bin"), "lo", "hi")
    first = bins.where(F.col("bin") == 0).select(F.lit(0).alias("bin"), F.lit(low).alias("lo"), F.col("lo").alias("hi"))
    last = bins.where(F.col("bin") == n - 1).select(F.lit(n + 1).alias("bin"), F.col("hi").alias("lo"), F.lit(high).alias("hi"))
    return inner.unionByName(first).unionByName(last)


def mass_bins(series: DataFrame, n: int = 20) -> DataFrame:
    """Bins that hold about equal sums of values: a border where the running sum of the sorted
    values first passes k / n of the total. Values are summed by value first, and the running sum
    goes over ranges of distinct values, each in a task of its own."""
    by_value = ranged(series.groupBy(F.col("x").cast("double").alias("x")).agg(F.sum(F.col("x").cast("double")).alias("m")), "x")
    inside = F.sum("m").over(Window.partitionBy("part").orderBy("x"))
    running = by_value.withColumn("inside", inside).join(before_parts(by_value, F.col("m")), "part").select("x", (F.col("inside") + F.col("before")).alias("cum"))
    running = running.crossJoin(F.broadcast(by_value.agg(F.sum("m").alias("total"))))  # one row
    step = running.withColumn("k", F.least(F.lit(n - 1), F.floor(F.col("cum") * n / F.col("total"))))
    borders = step.groupBy("k").agg(F.min("x").alias("hi")).where(F.col("k") >= 1)
    w = Window.orderBy("hi")
    top = by_value.agg(F.max("x").alias("hi"))
    edges = borders.select("hi").unionByName(top).distinct()
    return edges.select((F.row_number().over(w) - 1).alias("bin"), F.coalesce(F.lag("hi").over(w), F.lit(float("-inf"))).alias("lo"), "hi")


def quantile_bins(series: DataFrame, n: int = 20, accuracy: int = 10_000) -> DataFrame:
    """Bins of about equal counts, by approximate quantiles."""
    q = series.agg(F.percentile_approx(F.col("x").cast("double"), [i / n for i in range(1, n)], accuracy).alias("q"))
    edges = q.select(F.explode(F.array_distinct(F.concat(F.array(F.lit(float("-inf"))), "q", F.array(F.lit(float("inf")))))).alias("lo"))
    w = Window.orderBy("lo")
    return edges.select((F.row_number().over(w) - 1).alias("bin"), "lo", F.lead("lo").over(w).alias("hi")).where(F.col("hi").isNotNull())


def histogram(series: DataFrame, bins: DataFrame) -> DataFrame:
    """(series_id, bin, n) with a row for every bin of every series. Bins, a few rows whose number
    is a parameter, go to every task as one sorted array of their upper edges."""
    packed = bins.agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "bin"))).alias("bins"))
    rows = series.crossJoin(F.broadcast(packed))  # one row
    hit = F.get(F.filter("bins", lambda b: (b["lo"] < F.col("x")) & (F.col("x") <= b["hi"])), F.lit(0))
    # the least value belongs to the first bin where that is not open below
    first = F.when(F.col("x") <= F.get(F.col("bins"), F.lit(0))["lo"], F.lit(None)).otherwise(hit["bin"])
    counted = rows.select("series_id", first.alias("bin")).groupBy("series_id", "bin").agg(F.count("*").alias("n"))
    grid = series.select("series_id").distinct().crossJoin(F.broadcast(bins.select("bin")))
    return grid.join(counted, ["series_id", "bin"], "left").select("series_id", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cyclic_month(rows: DataFrame, t: str = "t") -> DataFrame:
    """(month, day, n): times collapsed to one year of twelve months."""
    return rows.groupBy(F.month(t).alias("month"), F.dayofmonth(t).alias("day")).agg(F.count("*").alias("n"))


# Kernel densities


def grid_of(series: DataFrame, n: int = 50, strategy: str = "uniform") -> DataFrame:
    """(g, at): n places over the range of the values, equally spaced or at quantiles."""
    if strategy == "uniform":
        ends = series.agg(F.min("x").cast("double").alias("a"), F.max("x").cast("double").alias("b"))
        return ends.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g"), "a", "b").select("g", (F.col("a") + (F.col("b") - F.col("a")) * F.col("g") / (n - 1)).alias("at"))
    if strategy == "density":
        q = series.agg(F.percentile_approx(F.col("x").cast("double"), [i / (n - 1) for i in range(n)], 10_000).alias("q"))
        return q.select(F.posexplode("q").alias("g", "at"))
    raise ValueError("the grid is uniform or density")


def _sphere(u: Column) -> Column:
    return F.when(F.abs(u) <= 1, F.lit(1.0)).otherwise(0.0)


#: Densities by name: the kernel at distance u, in bandwidths, and its integral.
DENSITIES: dict[str, tuple[Callable[[Column], Column], float]] = {
    "gaussian": (lambda u: F.exp(-0.5 * u * u), math.sqrt(2 * math.pi)),
    "tophat": (_sphere, 2.0),
    "epanechnikov": (lambda u: (1 - u * u) * _sphere(u), 4 / 3),
    "exponential": (lambda u: F.exp(-F.abs(u)), 2.0),
    "linear": (lambda u: (1 - F.abs(u)) * _sphere(u), 1.0),
    "cosine": (lambda u: F.cos(u * (math.pi / 2)) * _sphere(u), 4 / math.pi),
}


def kde(series: DataFrame, grid: DataFrame, bandwidth: float, kernel: str = "gaussian") -> DataFrame:
    """(series_id, g, density): density of each series at the places of a grid, a few rows that
    every task gets. kernel: a name in DENSITIES."""
    if kernel not in DENSITIES:
        raise ValueError(f"unknown kernel {kernel!r}: {sorted(DENSITIES)}")
    value, whole = DENSITIES[kernel]
    rows = series.crossJoin(F.broadcast(grid))
    u = (F.col("at") - F.col("x")) / bandwidth
    return rows.groupBy("series_id", "g").agg((F.avg(value(u)) / (bandwidth * whole)).alias("density"))


#: Terms of the Taylor series of the kernel about the distance of two cells of one bandwidth each, and
#: cells on either side that count. Offsets within cells differ by at most 1, so a term of order TERMS is
#: below 1 / sqrt(TERMS!), 1e-9 of a kernel's height, and what is left out beyond REACH is below 3e-11.
TERMS, REACH, CELLS = 20, 7, 4096


def _gauss_terms() -> np.ndarray:
    """For each distance in cells, -REACH to REACH, what moments i and j of two cells contribute."""
    out = np.zeros((2 * REACH + 1, TERMS, TERMS))
    for k, distance in enumerate(range(-REACH, REACH + 1)):
        hermite = [1.0, float(distance)]
        for n in range(1, 2 * TERMS):
            hermite.append(distance * hermite[n] - n * hermite[n - 1])
        slope = [(-1) ** n * hermite[n] * math.exp(-distance * distance / 2) for n in range(2 * TERMS)]
        for i in range(TERMS):
            for j in range(TERMS - i):
                out[k, i, j] = slope[i + j] * (-1) ** i / math.factorial(i) / math.factorial(j)
    return out


def gauss_sums(series: DataFrame, widths: np.ndarray) -> DataFrame:
    """(series_id, k, s): for each width h, the sum of exp(-(x - y)^2 / (2 h^2)) over all ordered pairs of
    values of a series, a value with itself included, by cells of one width. Powers of the offsets within
    cells are grouped sums, so a long series is many cells and no pair of values ever meets; cells meet
    those near them in blocks of CELLS, with copies of the cells at the borders."""
    low = float(series.agg(F.min(F.col("x").cast("double"))).first()[0] or 0.0)
    rows = series.where(F.col("x").isNotNull()).select("series_id", (F.col("x").cast("double") - low).alias("x"), F.posexplode(F.array(*[F.lit(float(h)) for h in widths])).alias("k", "h"))
    at = F.floor(F.col("x") / F.col("h"))
    rows = rows.select("series_id", "k", at.alias("cell"), (F.col("x") / F.col("h") - at - 0.5).alias("u"))
    powers, names = F.lit(1.0), [f"m{i}" for i in range(TERMS)]
    cols = {}
    for n in names:
        cols[n] = powers
        powers = powers * F.col("u")
    cells = rows.groupBy("series_id", "k", "cell").agg(*[F.sum(c).alias(n) for n, c in cols.items()])
    block, place = F.floor(F.col("cell") / CELLS), F.pmod("cell", F.lit(CELLS))
    copies = F.array_compact(F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.when(place < REACH, F.struct((block - 1).alias("b"), F.lit(False).alias("own"))), F.when(place >= CELLS - REACH, F.struct((block + 1).alias("b"), F.lit(False).alias("own")))))
    cells = cells.withColumn("c", F.explode(copies)).select("series_id", "k", F.col("c.b").alias("block"), F.col("c.own").alias("own"), "cell", *names)
    terms = _gauss_terms()

    def met(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("cell")
        cell, own, m = df["cell"].to_numpy(), df["own"].to_numpy(bool), df[names].to_numpy()
        total, mine = 0.0, np.flatnonzero(own)
        for d in range(-REACH, REACH + 1):
            to = np.minimum(np.searchsorted(cell, cell[mine] + d), len(cell) - 1)
            hit = cell[to] == cell[mine] + d
            total += float(np.einsum("ni,ij,nj->", m[mine[hit]], terms[d + REACH], m[to[hit]], optimize=True))
        return pd.DataFrame({"series": [df["series_id"].iloc[0]], "k": [df["k"].iloc[0]], "s": [total]})

    kind = dict(series.dtypes)["series_id"]
    sums = cells.groupBy("series_id", "k", "block").applyInPandas(met, f"series {kind}, k int, s double")
    return sums.groupBy(F.col("series").alias("series_id"), "k").agg(F.sum("s").alias("s"))


def jackknife_bandwidth(series: DataFrame, n: int = 50) -> float:
    """The bandwidth, of n log-spaced ones, under which the other values of a series make each
    value likeliest."""
    values = ranged(series.select(F.col("x").cast("double").alias("x")).distinct(), "x")
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("part").orderBy("x"))
    ends = values.groupBy("part").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # a row a range
    border = ends.select((F.col("lo") - F.lag("hi").over(Window.orderBy("part"))).alias("g"))
    least = values.select(gap.alias("g")).unionByName(border).where(F.col("g") > 0).agg(F.min("g")).first()[0]
    lo, hi, rows, ids = series.agg(F.min("x"), F.max("x"), F.count("*"), F.count_distinct("series_id")).first()
    if not least:
        return 1.0
    widths = np.geomspace(least, (hi - lo) / (rows / ids), n) if (hi - lo) / (rows / ids) > least else np.array([least])
    sizes = series.where(F.col("x").isNotNull()).groupBy("series_id").agg(F.count("*").alias("n"))
    scores = gauss_sums(series, widths).join(sizes, "series_id")
    scores = scores.groupBy("k").agg(F.sum((F.col("s") - F.col("n")) / F.greatest(F.lit(1), F.col("n") - 1)).alias("s")).collect()
    best = max(scores, key=lambda r: (r["s"] / widths[r["k"]], -r["k"]))
    return float(widths[best["k"]])
