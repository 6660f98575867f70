"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def added(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def summed(vectors: Column) -> Column:
    """Element-wise sum of a non-empty array of vectors, in array order."""
    return F.reduce(F.slice(vectors, 2, F.size(vectors)), vectors[0], added)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def unit(vector: Column) -> Column:
    """The vector at length one; null for a zero vector."""
    return F.transform(F.array(F.struct(vector.alias("v"), norm(vector).alias("n"))), lambda p: F.when(
        p["n"] > 0, F.transform(p["v"], lambda x: x / p["n"])
    ))[0]
