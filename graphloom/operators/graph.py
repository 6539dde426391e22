"""The property graph as tables of nodes (id, label, ...) and edges (src, dst, type), and walks over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import DEFAULT_PRIORITY, NODE_LABELS, NODE_PRIORITY
from graphloom.functions import text as T
from graphloom.operators.ranking import first_by


def label_of(kind: Column) -> Column:
    return F.when(kind.isin(NODE_LABELS), kind).otherwise("Entity")


def priority(label: Column) -> Column:
    out = F.lit(DEFAULT_PRIORITY)
    for k, v in NODE_PRIORITY.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def clean_properties(rows: DataFrame, *drop: str) -> DataFrame:
    """rows without the columns drop; empty strings become null, structs and maps JSON, in lists too, where a null becomes an empty string."""
    out = []
    for f in rows.drop(*drop).schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "array":
            inner = f.dataType.elementType.typeName()
            c = F.transform(c, lambda x: F.to_json(x)) if inner in ("struct", "map") else c
            c = F.transform(c, lambda x: F.coalesce(x, F.lit(""))) if inner in ("struct", "map", "string") else c
        out.append((T.truthy(c) if kind == "string" else F.to_json(c) if kind in ("struct", "map") else c).alias(f.name))
    return rows.select(*out)


def last_properties(rows: DataFrame) -> DataFrame:
    """One row of each (label, id), without ord: of every other column the last value by ord that isn't null. Values combine before they move."""
    columns = [c for c in rows.columns if c not in ("label", "id", "ord")]
    return rows.groupBy("label", "id").agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("ord"))).alias(c) for c in columns])


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new merged in by (label, id): a value that new has overwrites, one that it lacks stays. In new the last by ord wins, column by column."""
    columns = [c for c in old.columns if c not in ("label", "id")]
    last = last_properties(new.select("label", "id", *columns, "ord"))
    both = old.alias("o").join(last.alias("n"), ["label", "id"], "full")
    return both.select("label", "id", *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns])


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist, each (src, dst, type) once."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    held = edges.join(ids, F.col("src") == F.col("_id"), "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_semi")
    return held.select("src", "dst", "type").distinct()


def unique_violations(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).filter("n > 1")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("nodes").alias("what")).unionAll(edges.select(F.lit("edges"))).groupBy("what").agg(F.count("*").alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    """(edge_id, a, b) both ways round; edge_id names the stored edge."""
    named = edges.select(F.concat_ws(">", "src", "type", "dst").alias("edge_id"), "src", "dst")
    return named.select("edge_id", F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(named.select("edge_id", F.col("dst").alias("a"), F.col("src").alias("b")))


def trails(roots: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(root, node, used) of every walk of 1 to hops edges from a root that uses no edge twice; edges count in both directions.

    One join a hop on the walk's end; used holds the edges so far. No cut between hops, so walks may
    pass through any label."""
    ways = undirected(edges)
    walk = roots.select(F.col("root"), F.col("root").alias("node"), F.array().cast("array<string>").alias("used"))
    out = None
    for _ in range(hops):
        step = walk.join(ways, F.col("node") == F.col("a")).filter(~F.array_contains("used", F.col("edge_id")))
        walk = step.select("root", F.col("b").alias("node"), F.concat("used", F.array("edge_id")).alias("used"))
        out = walk if out is None else out.unionAll(walk)
    return out


def neighbourhood(roots: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2, without: str | None = "Chunk") -> DataFrame:
    """(root, node) pairs of distinct ends of trails whose label is not without; a root without any keeps a row with a null node."""
    ends = trails(roots, edges, hops).select("root", "node").distinct()
    kept = nodes.filter(F.col("label") != without) if without else nodes
    found = ends.join(kept.select(F.col("id").alias("_id")).distinct(), F.col("node") == F.col("_id"), "left_semi")
    return roots.select("root").join(found, "root", "left")


def path_edges(roots: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2, without: str | None = "Chunk") -> DataFrame:
    """(root, src, dst, type): the stored edges on any trail to a kept end, each once, in their own direction."""
    kept = nodes.filter(F.col("label") != without) if without else nodes
    walks = trails(roots, edges, hops).join(kept.select(F.col("id").alias("_id")).distinct(), F.col("node") == F.col("_id"), "left_semi")
    named = edges.select(F.concat_ws(">", "src", "type", "dst").alias("edge_id"), "src", "dst", "type")
    return walks.select("root", F.explode("used").alias("edge_id")).distinct().join(named, "edge_id").select("root", "src", "dst", "type").distinct()


def ranked_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct nodes of hits (query_id, node, ord) with their type's priority, the best of each, first by arrival."""
    rows = hits.join(nodes.select(F.col("id").alias("node"), "label"), "node").withColumn("score", priority(F.col("label")))
    return first_by(rows, ["query_id", "node"], F.desc("score"), F.asc("ord"), F.asc("label"))


def viz_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", T.first_truthy(F.col("name"), F.col("id")).alias("title"), F.coalesce("label", F.lit("Node")).alias("type")).distinct()


def contains_edges(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk -> entity edges from the comma-joined source_chunks of entities."""
    rows = entities.select(F.col("id").alias("dst"), F.explode(F.filter(F.split(F.coalesce("source_chunks", F.lit("")), ","), lambda c: c != "")).alias("src"))
    return rows.join(chunks.select(F.col("chunk_id").alias("_c")).distinct(), F.col("src") == F.col("_c"), "left_semi").select("src", "dst", F.lit("CONTAINS").alias("type")).distinct()


def radial_layout(ranked: DataFrame, order: str) -> DataFrame:
    """x and y of nodes by rank: the first in the middle, six on an inner ring, the rest on an outer one."""
    rank = F.col(order)
    ring = F.when(rank == 0, 0.0).when(rank <= 6, 1.0).otherwise(2.0)
    angle = F.when(rank <= 6, (rank - 1) / 6.0).otherwise((rank - 7) / 12.0) * 2 * F.pi()
    return ranked.select("*", F.round(ring * F.cos(angle), 6).alias("x"), F.round(ring * F.sin(angle), 6).alias("y"))
