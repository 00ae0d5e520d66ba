"""Vector functions on ``array<double>`` columns, as expressions that stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def neg_euclidean(a: Column, b: Column) -> Column:
    return -euclidean(a, b)


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean, "neg_euclidean": neg_euclidean}


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: one of {', '.join(METRICS)}")
    return METRICS[metric](a, b)


def l2_normalize(a: Column) -> Column:
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / length)


def blend(a: Column, b: Column, weight: float = 0.7) -> Column:
    """``weight`` of ``a`` and the rest of ``b``, made to unit length."""
    return l2_normalize(F.zip_with(a, b, lambda x, y: x * weight + y * (1 - weight)))


def fuse_concat(a: Column, b: Column) -> Column:
    return l2_normalize(F.concat(a, b))


def fuse_add(a: Column, b: Column) -> Column:
    return l2_normalize(F.zip_with(a, b, lambda x, y: x + y))


def fuse_weighted(a: Column, b: Column, w1: float, w2: float) -> Column:
    """Both parts weighted by the sigmoids of the two parameters, which are scaled to a sum of 1."""
    s1, s2 = 1 / (1 + math.exp(-w1)), 1 / (1 + math.exp(-w2))
    return l2_normalize(F.zip_with(a, b, lambda x, y: x * (s1 / (s1 + s2)) + y * (s2 / (s1 + s2))))


def pad(a: Column, size: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), (size - F.size(a)).cast("int")))


def clean(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def clean_cost(x: Column) -> Column:
    """A cost: NaN and minus infinity become 0, infinity 1e10."""
    return F.when(F.isnan(x) | (x == float("-inf")), F.lit(0.0)).when(x == float("inf"), F.lit(1e10)).otherwise(x)


def rounded(x: Column, digits: int) -> Column:
    """A value rounded as DuckDB rounds it: scaled, halves away from zero, scaled back; a zero keeps its sign. Spark's own rounds the decimal that a value is printed as."""
    out = F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return F.when(out == 0, x * 0.0).when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)
