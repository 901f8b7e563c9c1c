"""Vector functions as column expressions; vectors are arrays of numbers, taken as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x / n)


def unit_softened(v: Column, eps: float = 1e-12) -> Column:
    n = norm(v) + eps
    return F.transform(v, lambda x: x / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot of two unit vectors, between 0 and 2."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - dot(a, b)))


def logsumexp(v: Column) -> Column:
    top = F.array_max(v)
    return F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(v, lambda x: F.exp(x - top) / total)
