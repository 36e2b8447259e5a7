"""Vectors as arrays: dot product, norm, cosine. Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is null, empty or shorter than 1e-12."""
    size = norm(a) * norm(b)
    small = (norm(a) < 1e-12) | (norm(b) < 1e-12)
    return F.when(a.isNull() | b.isNull() | small, F.lit(0.0)).otherwise(dot(a, b) / size)


def distance_squared(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
