"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalized(v: Column) -> Column:
    return F.transform(F.array(norm(v)), lambda n: F.transform(doubles(v), lambda x: x / n))[0]


def is_valid(v: Column, dim: int | None = None) -> Column:
    """Whether a vector is finite, not zero, and of the dimension asked for."""
    finite = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & finite & F.exists(doubles(v), lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == dim) if dim else ok, F.lit(False))


def checked(v: Column, dim: int | None = None) -> Column:
    """The vector; raises if it is not valid."""
    return F.when(is_valid(v, dim), v).otherwise(F.raise_error(F.lit("invalid embedding")))
