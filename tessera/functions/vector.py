"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + F.sqrt(squared_distance(a, b)))


def manhattan(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + _sum(_pairs(a, b, lambda x, y: F.abs(x - y))))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of vectors."""
    first = F.get(vectors, F.lit(0))
    total = F.aggregate(vectors, F.transform(first, lambda _: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean, "manhattan": manhattan}


def metric(name: str):
    """A metric by name; an unknown name warns and gives cosine."""
    if name not in METRICS:
        warnings.warn(f"no such metric: {name}; cosine is used (there are {', '.join(METRICS)})", stacklevel=2)
    return METRICS.get(name, cosine)
