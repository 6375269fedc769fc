"""Small column expressions used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(c: Column, size: float) -> Column:
    """The voxel of a coordinate: round half to even of c / size."""
    return F.rint(c / size).cast("long")


def trunc_cell(c: Column, size: float) -> Column:
    """The grid cell of a coordinate: c / size towards zero, so that the cell at 0 is twice as wide."""
    return (c / size).cast("long")


def distance2(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)])


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def array_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column) -> Column:
    """Softmax of an array."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(x: Column) -> Column:
    """The first place (from 0) of an array's largest value."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")
