"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, digits: int = 6) -> Column:
    """Cosine similarity in double precision, rounded so that equal scores tie; null for zero vectors."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.round(dot(a, b) / size, digits))


def unit(v: Column) -> Column:
    """The vector scaled to length 1, once, so that scoring needs products only."""
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(dot(v, v)))
