"""Vector arithmetic in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def dist2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def sim01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2; 0 where a vector is null, all zero or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), (dot(a, b) / n + 1) / 2).otherwise(F.lit(0.0))


def blended(q: Column, text: Column, visual: Column, alpha: float) -> Column:
    return F.lit(alpha) * sim01(q, text) + F.lit(1 - alpha) * sim01(q, visual)
