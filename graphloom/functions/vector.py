"""Vector functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_score(similarity: Column) -> Column:
    """Cosine mapped from -1..1 to 0..1, as vector indexes report it."""
    return (1 + similarity) / 2


def normalized(a: Column) -> Column:
    """a scaled to length 1; null where its norm is zero."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm))
