"""The graph as stored tables that are changed bucket by bucket and read whole or by label, type and neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.sources.tables import settled
from graphloom.sources.versions import VersionedTables, bucket_of, digests

WITHIN = {"nodes": ["label"], "edges": ["type"]}


def _bucketed(nodes: DataFrame, edges: DataFrame, buckets: int) -> dict[str, DataFrame]:
    return {"nodes": nodes.withColumn("bucket", bucket_of(F.col("id"), buckets)), "edges": edges.select("src", "dst", "type").withColumn("bucket", bucket_of(F.col("src"), buckets))}


def _marked(tables: dict[str, DataFrame]) -> dict[str, dict[str, str]]:
    return {name: {str(b): d for b, d in digests(rows, *sorted(c for c in rows.columns if c != "bucket")).items()} for name, rows in tables.items()}


def store_graph(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = 64) -> dict[str, list[int]]:
    """Makes the graph at path be nodes (label, id, ...) and edges (src, dst, type); the buckets it wrote, by table.

    Nodes lie in buckets by id and within them by label, edges by src and type. Where a graph lies there already, each bucket's rows are compared by digest
    with what was written, and only those that differ are written; both tables change in one version, so readers see the old graph or the new one and
    a failure between the two writes leaves the old. Columns that differ from the stored ones write all."""
    held = VersionedTables(nodes.sparkSession, path)
    old = held.snapshot()
    tables = {name: settled(rows) for name, rows in _bucketed(nodes, edges, old.buckets if old else buckets).items()}
    now = _marked(tables)
    touched = {}
    for name, rows in tables.items():
        before = old.notes.get(name, {}) if old else {}
        names = {f["name"] for f in old.schemas[name]["fields"]} if old and name in old.schemas else None
        every = set(map(str, range(held_buckets(old, buckets))))
        touched[name] = sorted(int(b) for b in every if before.get(b) != now[name].get(b)) if names == set(rows.columns) else sorted(map(int, every))
    if old and not any(touched.values()):
        return touched
    changes = {name: rows.filter(F.col("bucket").isin(touched[name])) for name, rows in tables.items() if touched[name] or not old}
    held.write(changes, held_buckets(old, buckets), touched={name: touched[name] for name in changes}, within=WITHIN, notes=now)
    return touched


def held_buckets(old, buckets: int) -> int:
    """A stored graph's number of buckets, or that of a new one."""
    return old.buckets if old else buckets


def upsert_graph(path: str, nodes: DataFrame, edges: DataFrame) -> dict[str, list[int]]:
    """Merges nodes (label, id, ord, ...) and edges into the graph at path; the buckets it wrote.

    A property that a new node has overwrites the stored one, one that it lacks stays, new properties become columns (which writes every bucket of nodes); the last by ord wins. Edges count
    if both ends exist afterwards; for that only the ids of stored nodes are read. Buckets without a changed row are neither read whole nor written."""
    spark = nodes.sparkSession
    held = VersionedTables(spark, path)
    old = held.snapshot()
    fresh = settled(nodes.withColumn("bucket", bucket_of(F.col("id"), old.buckets)))
    hit = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
    stored = held.rows("nodes", old)
    added = [c for c in nodes.columns if c not in (*stored.columns, "ord")]
    hit = list(range(old.buckets)) if added else hit
    before = held.rows("nodes", old, hit).drop("bucket")
    before = before.select("*", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in added])
    missing = [c for c in before.columns if c not in nodes.columns]
    new = fresh.drop("bucket").select("*", *[F.lit(None).cast(before.schema[c].dataType).alias(c) for c in missing])
    merged = settled(graph.upsert_nodes(before, new).select(*before.columns, bucket_of(F.col("id"), old.buckets).alias("bucket")))
    ids = stored.select("id").unionByName(fresh.select("id"))
    kept = settled(graph.upsert_edges(edges, ids).withColumn("bucket", bucket_of(F.col("src"), old.buckets)))
    ways = sorted(r["bucket"] for r in kept.select("bucket").distinct().collect())
    joined = held.rows("edges", old, ways).unionByName(kept).select("src", "dst", "type", "bucket").distinct()
    joined = settled(joined)
    notes = {name: old.notes.get(name, {}) | d for name, d in _marked({"nodes": merged, "edges": joined}).items()}
    touched = {"nodes": hit, "edges": ways}
    tables = {name: rows for name, rows in (("nodes", merged), ("edges", joined)) if touched[name]}
    if tables:
        held.write(tables, old.buckets, touched=touched, within=WITHIN, notes=notes)
    return touched


def open_graph(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the newest version, or of one that is still there."""
    held = VersionedTables(spark, path)
    snapshot = held.snapshot(version)
    return tuple(held.rows(name, snapshot).drop("bucket") for name in ("nodes", "edges"))


def nodes_by_id(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The nodes of a few given ids: only their buckets are opened."""
    held = VersionedTables(spark, path)
    snapshot = held.snapshot()
    at = {r["b"] for r in spark.createDataFrame([(i,) for i in ids], "id string").select(bucket_of(F.col("id"), snapshot.buckets).alias("b")).collect()}
    return held.rows("nodes", snapshot, at).filter(F.col("id").isin(ids)).drop("bucket")
