"""Column functions on feature vectors (arrays of doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def normalise(x: Column) -> Column:
    """``x`` over its Euclidean norm; zero vectors stay as they are."""
    size = norm(x)
    return F.when(size == 0, x).otherwise(F.transform(x, lambda v: v / size))


def pick(x: Column, ids: list[int]) -> Column:
    """The components of ``x`` at ``ids``, in that order."""
    return F.array(*(x[i] for i in ids))


def drop_small(x: Column, least: float = 1e-13) -> Column:
    """The sparse form of ``x``: (i, v) for each component of at least ``least`` in size."""
    pairs = F.transform(x, lambda v, i: F.struct(i.cast("long").alias("i"), v.alias("v")))
    return F.filter(pairs, lambda p: F.abs(p["v"]) >= least)
