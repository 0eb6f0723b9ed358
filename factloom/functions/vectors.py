"""Vectors as arrays of numbers: norm, cosine similarity and distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """Unit length; a vector of zeros stays."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n)))[0]


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of different lengths and zero vectors."""
    length = norm(a) * norm(b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0)
    return F.when(fits, dot(a, b) / length).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if a vector has the length zero."""
    return 1.0 - F.try_divide(dot(a, b), norm(a) * norm(b))
