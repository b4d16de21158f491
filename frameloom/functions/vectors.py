"""Vectors in arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    n = norm(a) + 1e-12
    return F.transform(a, lambda x: x.cast("double") / n)


def valid(a: Column) -> Column:
    return norm(a) > 1e-9


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(a: Column) -> Column:
    """First place of the greatest, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def expectation(p: Column, values: Column) -> Column:
    return dot(p, values)
