"""Vectors as arrays of floats; sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), l2(a) * l2(b))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    norm = F.coalesce(F.nullif(l2(a), F.lit(0.0)), F.lit(1.0))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(a, lambda x: x / n)), F.lit(0))  # the norm once, not for each entry


def min_max(value: Column, low: Column, high: Column) -> Column:
    """0 to 1 between the extremes; 0 where they are equal."""
    return F.when(high - low < 1e-9, 0.0).otherwise((value - low) / (high - low))
