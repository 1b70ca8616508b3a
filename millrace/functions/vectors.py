"""Vector measures over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1.0 - dot(a, b) / n).otherwise(1.0)


def clipped_cosine(a: Column, b: Column, least: float = 1e-9) -> Column:
    """Cosine with each norm taken as ``least`` at the smallest: a zero vector has similarity 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(least)) * F.greatest(norm(b), F.lit(least)))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def inner_product_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_d(a), lambda x: x / n)).otherwise(_d(a))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


METRICS = {"cosine": cosine_distance, "l2": squared_l2, "ip": inner_product_distance}


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance by name; ``l2`` stays squared, its root keeps the order."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return METRICS[metric](a, b)
