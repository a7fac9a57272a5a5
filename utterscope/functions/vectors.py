"""Arithmetic on array columns. Elements are promoted to double before they are combined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(vec: Column) -> Column:
    return F.sqrt(
        F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))


def unit(vec: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    # An expression inside a lambda runs once per element. Repeating the length next to the elements
    # has it computed once per vector.
    lengths = F.array_repeat(norm(vec), F.size(vec))
    return F.zip_with(
        vec,
        lengths,
        lambda x, length: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)),
    )


def cosine_from_sums(ab: Column, aa: Column, bb: Column) -> Column:
    """Cosine similarity from the three inner products, 0.0 when either vector is zero."""
    lengths = F.sqrt(aa) * F.sqrt(bb)
    return F.when(lengths > 0, ab / lengths).otherwise(F.lit(0.0))
