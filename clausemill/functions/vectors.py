"""Column functions on vectors (arrays of numbers); arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return let(doubles(v), lambda d: F.sqrt(dot(d, d)))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is. The norm is bound, or each element would sum it anew."""
    return let(doubles(v), lambda d: let(F.sqrt(dot(d, d)), lambda n: F.transform(d, lambda x: x / F.when(n == 0, 1.0).otherwise(n))))


def finite(v: Column) -> Column:
    return ~F.exists(doubles(v), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
