"""Numeric functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2 ** 27 + 1: parts a double into two halves of its digits


def round_even(x: Column, places: int) -> Column:
    """x to places decimals: the decimal nearest to the exact value of the double, of two equally near ones the even one; 2.675 is less than that, and goes to 2.67.

    The engine's own rounding goes by the digits that a double prints with, and up from the half. Here the product with 10 ** places is taken with its rounding error (x
    in two halves, each times a number of few digits is exact), so that it is known on which side of the half it lies. From 2 ** 52 /
    10 ** places on, where a double has hardly a digit to lose, and for what isn't finite the engine's rounding counts."""
    x, scale = x.cast("double"), 10.0**places
    product = x * scale
    high = x * _SPLIT - (x * _SPLIT - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    side = (product - below - 0.5) + error
    up = F.when(side > 0, 1.0).when(side < 0, 0.0).otherwise(F.abs(below) % 2)
    return F.when(F.abs(product) < 2.0**52, (below + up) / scale).otherwise(F.round(x, places))


def sql_round_even(x: str, places: int) -> str:
    """The same as SQL, of an expression without aggregates."""
    s = f"{10.0**places}::DOUBLE"
    inner = f"SELECT v * {s} AS p, ({_SPLIT}::DOUBLE * v - ({_SPLIT}::DOUBLE * v - v)) AS h, v FROM (SELECT ({x})::DOUBLE AS v)"
    return f"(SELECT (floor(p) + CASE WHEN (p - floor(p) - 0.5) + ((h * {s} - p) + (v - h) * {s}) > 0 THEN 1 WHEN (p - floor(p) - 0.5) + ((h * {s} - p) + (v - h) * {s}) < 0 THEN 0 ELSE abs(floor(p)) % 2 END) / {s} FROM ({inner}))"
