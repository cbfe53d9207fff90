"""Distances of distributions, for arrays and for matrices in coordinates.

Array forms are column expressions. Coordinate forms take pairs (a, b, col_id, x, y), the outer
join of two rows on the column, and sum over a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-11


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _paired(x: Column, y: Column, f) -> Column:
    return total(F.zip_with(x, y, f))


def hellinger(x: Column, y: Column) -> Column:
    """0 if both are zero, 1 if one is."""
    sx, sy = total(x), total(y)
    mixed = _paired(x, y, lambda a, b: F.sqrt(a * b))
    d = F.sqrt(F.greatest(F.lit(0.0), 1 - mixed / F.sqrt(sx * sy)))
    return F.when((sx == 0) & (sy == 0), 0.0).when((sx == 0) | (sy == 0), 1.0).otherwise(d)


def total_variation(x: Column, y: Column) -> Column:
    sx, sy = total(x), total(y)
    return _paired(x, y, lambda a, b: F.abs(a / sx - b / sy)) * 0.5


def _smoothed(x: Column) -> Column:
    s = total(x) + EPS * F.size(x)
    return F.transform(x, lambda a: (a + EPS) / s)


def jensen_shannon(x: Column, y: Column) -> Column:
    p, q = _smoothed(x), _smoothed(y)
    half = lambda a, b: a * F.ln(2 * a / (a + b))
    return (_paired(p, q, half) + _paired(q, p, half)) * 0.5


def symmetric_kl(x: Column, y: Column) -> Column:
    return _paired(_smoothed(x), _smoothed(y), lambda a, b: a * F.ln(a / b) + b * F.ln(b / a))


def _cdf_gaps(x: Column, y: Column) -> Column:
    """Differences of the two running shares."""
    sx, sy = total(x), total(y)
    step = F.zip_with(x, y, lambda a, b: a / sx - b / sy)
    run = F.aggregate(step, F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(v + F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(0.0))))
    return F.when(F.size(x) == 0, F.array().cast("array<double>")).otherwise(run)


def _minkowski(gaps: Column, p: int) -> Column:
    if p < 1:
        raise ValueError("p is 1 or more")
    s = total(F.transform(gaps, lambda g: F.pow(F.abs(g), F.lit(float(p)))))
    return s if p == 1 else F.pow(s, F.lit(1.0 / p))


def kantorovich(x: Column, y: Column, p: int = 1) -> Column:
    return _minkowski(_cdf_gaps(x, y), p)


def median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def circular_kantorovich(x: Column, y: Column, p: int = 1) -> Column:
    """On a circle the cut is free: the running differences are shifted by their median."""
    gaps = _cdf_gaps(x, y)
    shift = median(F.transform(gaps, lambda g: F.pow(g, F.lit(float(p)))))
    return _minkowski(F.transform(gaps, lambda g: g - shift), p)


# Coordinates


def aligned(a: DataFrame, b: DataFrame, how: str = "full") -> DataFrame:
    """(pair, col_id, x, y) of two sets of rows (pair, col_id, value); absent entries are 0."""
    x = a.select("pair", "col_id", F.col("value").alias("x"))
    y = b.select("pair", "col_id", F.col("value").alias("y"))
    return x.join(y, ["pair", "col_id"], how).select("pair", "col_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def sparse_sum(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    out = aligned(a, b).select("pair", "col_id", (F.col("x") + sign * F.col("y")).alias("value"))
    return out.where(F.col("value") != 0)


def sparse_product(a: DataFrame, b: DataFrame) -> DataFrame:
    out = aligned(a, b, "inner").select("pair", "col_id", (F.col("x") * F.col("y")).alias("value"))
    return out.where(F.col("value") != 0)


def sparse_distances(pairs: DataFrame) -> DataFrame:
    """(pair, hellinger, total_variation, jensen_shannon, symmetric_kl) of aligned rows; the
    smoothing of the last two counts the columns that either row has."""
    own = Window.partitionBy("pair")
    s = pairs.withColumns({"sx": F.sum("x").over(own), "sy": F.sum("y").over(own), "n": F.count("*").over(own)})
    p = (F.col("x") + EPS) / (F.col("sx") + EPS * F.col("n"))
    q = (F.col("y") + EPS) / (F.col("sy") + EPS * F.col("n"))
    both = F.max("sx") * F.max("sy")
    return s.groupBy("pair").agg(
        F.when((F.max("sx") == 0) & (F.max("sy") == 0), 0.0).when(both == 0, 1.0)
        .otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(F.col("x") * F.col("y"))) / F.sqrt(both)))).alias("hellinger"),
        (0.5 * F.sum(F.abs(F.try_divide(F.col("x"), F.col("sx")) - F.try_divide(F.col("y"), F.col("sy"))))).alias("total_variation"),
        (0.5 * F.sum(p * F.ln(2 * p / (p + q)) + q * F.ln(2 * q / (p + q)))).alias("jensen_shannon"),
        F.sum(p * F.ln(p / q) + q * F.ln(q / p)).alias("symmetric_kl"),
    )
