"""Vector expressions over array columns; vectors stay in the row they belong to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 when a vector has no length, null when one is missing."""
    ratio = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(ratio, F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def pack(*columns: Column) -> Column:
    """One array column from scalar columns."""
    return F.array(*columns)


def slice_vector(vector: Column, start: int, length: int) -> Column:
    """``length`` components from position ``start`` (counted from 0)."""
    return F.slice(vector, start + 1, length)
