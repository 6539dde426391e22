"""Community detection by modularity, and roll-ups of its result."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import COMMUNITY_MIN, COMMUNITY_RESOLUTION, MEMBERS_STORED, PROJECTION_EXCLUDES
from graphloom.sources.tables import settled


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides meet on executors whatever their size: turns are many, and each table broadcast in one would go through the driver."""
    return left.join(right.hint("merge"), on, how)


def projection(nodes: DataFrame, edges: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """(a, b), a < b: the simple undirected graph over nodes of the wanted types."""
    ids = nodes.filter(~F.col("label").isin(exclude if exclude is not None else PROJECTION_EXCLUDES)).select(F.col("id").alias("_id")).distinct()
    held = _met(_met(edges, ids, F.col("src") == F.col("_id"), "left_semi"), ids, F.col("dst") == F.col("_id"), "left_semi")
    return held.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()


def modularity(pairs: DataFrame, partition: DataFrame, resolution: float = COMMUNITY_RESOLUTION) -> DataFrame:
    """One row, q: the share of weight inside communities less what degrees alone would put there. pairs: a, b[, w]."""
    w = F.col("w") if "w" in pairs.columns else F.lit(1.0)
    rows = pairs.select("a", "b", w.alias("w"))
    ca, cb = partition.select(F.col("node").alias("a"), F.col("community").alias("ca")), partition.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    ends = _met(_met(rows, ca, "a"), cb, "b")
    inside = F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)
    by_side = ends.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "w", inside.alias("i")), F.struct(F.col("cb").alias("c"), "w", F.lit(0.0).alias("i")))).alias("x")).select("x.*")
    sums = by_side.groupBy("c").agg(F.sum("w").alias("d"), F.sum("i").alias("i"))
    total = sums.agg((F.sum("d") / 2).alias("m"), F.sum("i").alias("inside"), F.sum(F.col("d") * F.col("d")).alias("squares"))
    return total.select(F.round(F.coalesce(F.try_divide("inside", "m") - resolution * F.try_divide(F.col("squares"), 4 * F.col("m") * F.col("m")), F.lit(0.0)), 6).alias("q"))


def gaining_moves(weights: DataFrame, degrees: DataFrame, partition: DataFrame, m: float, resolution: float = COMMUNITY_RESOLUTION) -> DataFrame:
    """(node, community, to, d, gain): of every node that gains by it alone, its best move into a neighbour's community, ties to the smaller one.

    weights: a, b, w both ways round; degrees: node, d; gain is that of modularity times m, the weight of all edges."""
    of_b = partition.select(F.col("node").alias("b"), F.col("community").alias("to"))
    links = _met(weights.filter("a <> b"), of_b, "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("links"))
    own = _met(partition, degrees, "node")
    mass = own.groupBy(F.col("community").alias("to")).agg(F.sum("d").alias("mass"))
    tried = _met(_met(links, mass, "to"), own, "node")
    here = F.col("to") == F.col("community")
    value = F.col("links") - resolution * F.col("d") * (F.col("mass") - F.when(here, F.col("d")).otherwise(0.0)) / (2 * m)
    best = tried.groupBy("node").agg(F.min(F.struct((-value).alias("v"), "to")).alias("best"), F.max(F.when(here, F.col("links"))).alias("kept"))
    now = _met(best, _met(own, mass.withColumnRenamed("to", "community"), "community"), "node")
    stay = F.coalesce("kept", F.lit(0.0)) - resolution * F.col("d") * (F.col("mass") - F.col("d")) / (2 * m)
    moves = now.select("node", "community", F.col("best.to").alias("to"), "d", (-F.col("best.v") - stay).alias("gain"))
    return moves.filter((F.col("to") != F.col("community")) & (F.col("gain") > 1e-9))


def independent_moves(moves: DataFrame, m: float, resolution: float, turn: int) -> DataFrame:
    """Of moves those that raise modularity when they are made at once, whatever the others do.

    A move counts as the first of its community if none that leaves or enters it gains more. On even turns a hash parts communities into those that are
    left and those that are entered: then two moves can only take from each other by their degrees' product, and a move is made if its gain exceeds
    what all others of its two communities may take, or if it is the first of both. On odd turns moves that are the first of both
    communities are made, which share no community with each other. Only sums and firsts by community meet."""
    if turn % 2 == 0:
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2))
        moves = moves.filter((coin("community") == 0) & (coin("to") == 1))
    rank = F.struct("gain", F.xxhash64("node", F.lit(turn)).alias("h"), "node")
    ends = moves.select(F.explode(F.array("community", "to")).alias("c"), rank.alias("r"), "d")
    by = ends.groupBy("c").agg(F.max("r").alias("first"), F.sum("d").alias("mass"))
    side = lambda c: by.select(F.col("c").alias(c), F.col("first.node").alias(f"first_{c}"), F.col("mass").alias(f"mass_{c}"))
    held = _met(_met(moves, side("community"), "community"), side("to"), "to")
    chosen = (F.col("first_community") == F.col("node")) & (F.col("first_to") == F.col("node"))
    if turn % 2 == 0:
        taken = resolution * F.col("d") * (F.col("mass_community") + F.col("mass_to") - 2 * F.col("d")) / (2 * m)
        chosen = chosen | (F.col("gain") > taken)
    return held.filter(chosen).select("node", "to")


def settled_moves(weights: DataFrame, partition: DataFrame, m: float, resolution: float = COMMUNITY_RESOLUTION, most: int = 100_000) -> tuple[DataFrame, bool]:
    """partition (node, community) after moves of single nodes until none gains any more, and whether there was any.

    Every turn raises modularity, so this ends; most turns are allowed before it is called an error. Each turn is a few joins and sums over edges, and writes the partition."""
    degrees = settled(weights.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d")))
    moved = False
    for turn in range(most):
        moves = settled(gaining_moves(weights, degrees, partition, m, resolution))
        if moves.isEmpty():
            return partition, moved
        made = independent_moves(moves, m, resolution, turn)
        partition, moved = settled(_met(partition, made, "node", "left").select("node", F.coalesce("to", "community").alias("community"))), True
    raise RuntimeError(f"communities not settled after {most} turns")


def aggregated(weights: DataFrame, partition: DataFrame) -> DataFrame:
    """The graph whose nodes are communities: (a, b, w) both ways round, edges inside one as its loop."""
    ca, cb = partition.select(F.col("node").alias("a"), F.col("community").alias("ca")), partition.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    return settled(_met(_met(weights, ca, "a"), cb, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))


def louvain(pairs: DataFrame, resolution: float = COMMUNITY_RESOLUTION, nodes: DataFrame | None = None) -> DataFrame:
    """(node, community) of every end of pairs (a, b[, w]) and every row of nodes (id); communities are named by one of their nodes.

    Single nodes move until none gains; then communities move as nodes do, level upon level, until none gains by joining another; then
    single nodes again, from where they are now, and so on until neither moves. So in the result no node gains by moving to a neighbour's
    community, and no community by joining another one. Modularity rises with every turn and is never below that of every node by itself. Loops and null ends are left out, an edge that
    comes more than once counts by its weights; nodes without an edge are communities of their own."""
    w = F.col("w").cast("double") if "w" in pairs.columns else F.lit(1.0)
    rows = pairs.select("a", "b", w.alias("w")).filter("a <> b")
    base = settled(rows.unionAll(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    m = (base.agg(F.sum("w")).first()[0] or 0.0) / 2
    result = settled(base.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct())
    while m:
        result, moved = settled_moves(base, result, m, resolution)
        level, merged = aggregated(base, result), False
        while True:
            own = level.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct()
            joined, some = settled_moves(level, settled(own), m, resolution)
            if not some:
                break
            merged = True
            result = settled(_met(result, joined.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community")))
            level = aggregated(level, joined)
        if not merged:
            break
    if nodes is not None:
        alone = _met(nodes.select(F.col("id").alias("node")).filter("node is not null").distinct(), result, "node", "left_anti")
        result = result.unionByName(alone.select("node", F.col("node").alias("community")))
    return result


def rollup(partition: DataFrame, nodes: DataFrame, least: int = COMMUNITY_MIN) -> DataFrame:
    """(community, size, chapters): communities of least members or more, with their chapters but 00, sorted."""
    rows = partition.join(nodes.select(F.col("id").alias("node"), "ata"), "node")
    return rows.groupBy("community").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("ata") != "00", F.col("ata")))), ",").alias("chapters")).filter(F.col("size") >= least)


def described(partition: DataFrame, nodes: DataFrame, names: int = 8) -> DataFrame:
    """(community, summary): by type, in order, its count and its first names; what a summary is written from."""
    rows = partition.join(nodes.select(F.col("id").alias("node"), "type", "name"), "node")
    by_type = rows.groupBy("community", "type").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, names), ", ").alias("names"))
    line = F.concat(F.col("type"), F.lit("s ("), F.col("n").cast("string"), F.lit("): "), F.col("names"))
    return by_type.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", line.alias("line")))), lambda x: x["line"]), "\n").alias("summary"))


def members(partition: DataFrame, stored: int = MEMBERS_STORED) -> DataFrame:
    """(community, size, member_ids) with at most stored ids, as a comma-joined list."""
    return partition.groupBy("community").agg(F.count("*").alias("size"), F.array_join(F.slice(F.array_sort(F.collect_list("node")), 1, stored), ",").alias("member_ids"))


def summarised(communities: DataFrame, write: Callable[[str], str] | None = None) -> DataFrame:
    """communities with summary; without a writer, a fixed sentence of the size."""
    if write is None:
        return communities.withColumn("summary", F.concat(F.lit("Community of "), F.col("size").cast("string"), F.lit(" entities.")))

    @F.pandas_udf("string")
    def written(texts: pd.Series) -> pd.Series:
        return texts.map(write, na_action="ignore")

    return communities.withColumn("summary", written(F.col("summary")))
