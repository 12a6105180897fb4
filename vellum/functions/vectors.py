"""Vector scalars as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Empty or zero vectors: 0. Different sizes: an error."""
    size = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size")).cast("double"))
    scale = norm(a) * norm(b)
    return F.coalesce(size, F.when((F.size(a) == 0) | (scale == 0), 0.0).otherwise(dot(a, b) / scale))


def is_normalised(a: Column, tolerance: float = 1e-4) -> Column:
    return F.when(F.size(a) == 0, False).otherwise(F.abs(norm(a) - 1) <= tolerance)


def assert_dimensions(a: Column, n: int) -> Column:
    """The vector itself; an error where its size is not n."""
    return F.when(F.size(a) != n, F.raise_error(F.lit(f"a vector has not {n} dimensions")).cast("array<double>")).otherwise(a.cast("array<double>"))
