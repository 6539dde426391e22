"""Row numbers, top-k and first-occurrence dedup with explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import settled


def numbered(rows: DataFrame, *order: str, into: str, start: int = 0) -> DataFrame:
    """rows numbered over all of them in a total order, without one task that sees all.

    A range partitioning deals them out in order; each partition numbers its own rows, and the partitions' counts,
    a small map, move each up by what came before."""
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*order)
    ranged = settled(ranged.withColumn("_own", F.row_number().over(own)))  # two branches read it: the ranges must be the same
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(into, (F.col("_own") + F.coalesce("_before", F.lit(0)) - 1 + start).cast("long")).drop("_part", "_own", "_before")


def top_k(rows: DataFrame, k: int, by: list[str], *order: Column, into: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1; ranks beyond k are cut before the shuffle."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(into) <= k)


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return top_k(rows, 1, keys, *order, into="_rank").drop("_rank")
