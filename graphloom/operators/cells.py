"""A stored vector index: coarse cells with radii, searched exactly by leaving out cells that the triangle inequality rules out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.index import rounded
from graphloom.operators.ranking import top_k
from graphloom.sources.tables import settled
from graphloom.sources.versions import VersionedTables

SLACK = 1e-6  # of angles and scores, for rounding; bounds are given so much way that none cuts off an equal score


def matrix(lists: pa.Array | pa.ChunkedArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which of the given rows they are: those of dim components (or of the first row's number), all finite, not all zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), -1), dtype=np.int64)
    dim = dim if dim is not None else int(size[size > 0][0]) if (size > 0).any() else 0
    at = np.flatnonzero(size == dim)
    flat = pc.list_flatten(lists.take(pa.array(at)))
    x = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")), dtype=np.float64).reshape(len(at), dim)
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good, None], at[good]


def centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Directions that a bounded sample of unit rows gathers about: k-means on the sphere, begun at its first rows. Any would do for right results."""
    c = sample[:cells].copy()
    for _ in range(rounds):
        own = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], c)
    return c


def _unit_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _assigned(middle: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = matrix(batch.column("vector"), middle.shape[1])
            if len(at):
                near = x @ middle.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), _unit_lists(x), pa.array(cell, pa.int32()), pa.array(angle)], names=["id", "vector", "bucket", "angle"])

    return run


def _placed(vectors: DataFrame, middle: np.ndarray) -> DataFrame:
    kind = vectors.schema["id"].dataType.simpleString()
    return settled(vectors.select("id", "vector").filter("id is not null").mapInArrow(_assigned(middle), f"id {kind}, vector array<double>, bucket int, angle double"))


def _stored(index: VersionedTables, rows: DataFrame, middle: np.ndarray, block_rows: int, touched: list[int] | None) -> None:
    """Writes rows (id, vector, bucket, angle) by cell, in blocks of about block_rows, and the cells' table."""
    spark, cells = rows.sparkSession, len(middle)
    sizes = {r["bucket"]: (r["n"], r["radius"]) for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    blocks = [max(1, -(-sizes.get(c, (0, 0.0))[0] // block_rows)) for c in range(cells)]
    block = F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("bucket") + 1)).cast("int")
    table = [(c, c, middle[c].tolist(), float(sizes[c][1]), int(sizes[c][0]), blocks[c]) for c in (touched if touched is not None else range(cells)) if c in sizes]
    heads = spark.createDataFrame(table, "bucket int, cell int, centre array<double>, radius double, n long, blocks int")
    marks = None if touched is None else {"vectors": touched, "cells": touched}
    index.write({"vectors": rows.withColumn("block", block), "cells": heads}, cells, touched=marks, notes={"block_rows": block_rows})


def build_cells(corpus: DataFrame, path: str, a_cell: int = 1024, most: int = 1024, sample_rows: int = 8192, block_rows: int = 8192) -> VersionedTables:
    """The index of corpus (id, vector) at path.

    Cells lie about centres of a sample: sample_rows vectors at most, those with the smallest hashes of their ids, and one cell for every a_cell vectors,
    most at most; that bounds what the driver and each task hold. Every vector is indexed, in the cell whose centre it is nearest to, and a cell's
    radius is the largest angle to its centre over all its vectors. A cell of any size lies in blocks of about block_rows, which are what a task
    searches. Vectors without id, null, zero, not finite or of another length than the sample's first are left out; repeated rows stay."""
    spark = corpus.sparkSession
    rows = corpus.select("id", F.col("vector").cast("array<double>").alias("vector")).filter("id is not null and vector is not null")
    sample, _ = matrix(rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow().column("vector"))
    cells = int(min(most, max(1, rows.count() // a_cell, min(16, len(sample) // 8)), max(1, len(sample))))
    middle = centres(sample, cells) if len(sample) else np.zeros((1, 1))
    index = VersionedTables(spark, path)
    _stored(index, _placed(rows, middle), middle, block_rows, None)
    return index


def add_vectors(index: VersionedTables, more: DataFrame) -> list[int]:
    """A version with the vectors of more (id, vector) added, those of an id that is there already replacing it in the cells that more touches; the cells written.

    Centres stay, radii and blocks follow. An id whose new vector falls in another cell keeps the old one there, too: remove it by building anew."""
    snapshot = index.snapshot()
    heads = _heads(index, snapshot)
    middle = np.zeros((snapshot.buckets, len(heads[0]["centre"])))
    middle[:] = heads[0]["centre"]  # cells without vectors have no centre of their own
    for h in heads:
        middle[h["cell"]] = h["centre"]
    fresh = _placed(more.select("id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null"), middle)
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
    if not touched:
        return []
    old = index.rows("vectors", snapshot, touched).select("id", "vector", "bucket", "angle").join(fresh.select("id").distinct(), "id", "left_anti")
    _stored(index, settled(old.unionByName(fresh)), middle, snapshot.notes["block_rows"], touched)
    return touched


def _heads(index: VersionedTables, snapshot) -> list:
    return index.rows("cells", snapshot).orderBy("cell").collect()  # as many as there are cells, a bounded number


def _bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Queries x cells: no vector of the cell is more similar, as an angle to it is at least that to the centre less the radius."""
    angle = np.arccos(np.clip(q @ centre.T, -1.0, 1.0))
    return np.cos(np.maximum(0.0, angle - radius[None, :] - SLACK)) + SLACK


def _routes(heads: list, first: bool, k: int | None, floor: float):
    """Which blocks a query goes to: first the nearest cells that hold k vectors together, then all others whose bound reaches the query's floor."""
    cell, blocks, n = (np.array([h[c] for h in heads]) for c in ("cell", "blocks", "n"))
    centre, radius = np.array([h["centre"] for h in heads]), np.array([h["radius"] for h in heads])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, at = matrix(batch.column("q"), centre.shape[1])
            if not len(at):
                continue
            limit = np.full(len(at), floor - SLACK)
            if not first:
                limit = np.maximum(limit, np.asarray(pc.fill_null(batch.column("reached"), -2.0), dtype=np.float64)[at] - SLACK)
            bound = _bounds(q, centre, radius)
            ask = bound >= limit[:, None]
            if k is not None:
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                near = np.zeros_like(ask)
                np.put_along_axis(near, order, before < k, axis=1)
                ask &= near if first else ~near
            which, c = np.nonzero(ask)
            many = blocks[c]
            which, c = np.repeat(which, many), np.repeat(c, many)
            block = np.arange(len(c)) - np.repeat(np.cumsum(many) - many, many)
            for low in range(0, len(c), 8192):
                part = slice(low, low + 8192)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at[which[part]])), _unit_lists(q[which[part]]), pa.array(cell[c[part]], pa.int32()), pa.array(block[part], pa.int32())], names=["query_id", "q", "bucket", "block"])

    return run


def _compared(k: int | None, floor: float, unit: bool):
    def run(key: tuple, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        which, found, scores = [], [], []
        if vectors.num_rows and asked.num_rows:
            vectors = vectors.take(pc.sort_indices(vectors, [("id", "ascending")]))
            x, _ = matrix(vectors.column("vector"))
            q, _ = matrix(asked.column("q"))
            for low in range(0, len(q), 256):
                part = q[low : low + 256] @ x.T
                part = (1 + part) / 2 if unit else part
                for i, row in enumerate(part):
                    reach = floor if k is None or len(row) <= k else max(floor, np.partition(row, len(row) - k)[len(row) - k])
                    at = np.flatnonzero(row >= reach - 2 * SLACK)
                    value = rounded(row[at])
                    at, value = at[value >= floor], value[value >= floor]
                    keep = np.lexsort((at, -value))[: len(at) if k is None else k]
                    which += [low + i] * len(keep)
                    found.append(at[keep])
                    scores.append(value[keep])
        take = lambda column, at: column.combine_chunks().take(pa.array(at, pa.int64()))
        found = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.table({"query_id": take(asked.column("query_id"), which), "id": take(vectors.column("id"), found), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})

    return run


def _asked(index: VersionedTables, snapshot, routed: DataFrame, queries: int, k: int | None, floor: float, unit: bool, queries_a_block: int) -> DataFrame:
    parts = -(-max(1, queries) // queries_a_block)
    vectors = index.rows("vectors", snapshot).select("id", "vector", "bucket", "block")
    vectors = vectors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0))
    routed = routed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    out = f"query_id {routed.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    return vectors.groupBy("bucket", "block", "part").cogroup(routed.groupBy("bucket", "block", "part")).applyInArrow(_compared(k, floor, unit), out)


def search_cells(index: VersionedTables, queries: DataFrame, k: int | None = 5, floor: float | None = None, mode: str = "raw", queries_a_block: int = 4096, routes: list | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k vectors most similar to each query (query_id, q), or with k None all of floor or more; cosines rounded to 6 places, ties to the smaller id.

    A query first asks its nearest cells that hold k vectors; what the k-th of those reaches, or floor, then decides which other cells it
    has to ask: a cell whose centre is so far off that no vector within its radius can be that similar is left out, which
    loses nothing. In a block all queries meet all vectors by matrix products, and k rows a query and block go on. mode unit maps scores to 0..1.
    Given a list routes, it gets the tables of (query_id, bucket, block) asked. Queries without id or of another length take no part."""
    snapshot, unit = index.snapshot(), mode == "unit"
    spark, heads = index.spark, _heads(index, snapshot)
    kind = queries.schema["query_id"].dataType.simpleString()
    out = f"query_id {kind}, id {index.rows('vectors', snapshot).schema['id'].dataType.simpleString()}, score double"
    if not heads:
        return spark.createDataFrame([], out + ", rank long")
    least = -2.0 if floor is None else 2 * floor - 1 if unit else floor
    asked = settled(queries.select("query_id", F.col("q").cast("array<double>").alias("q")).filter("query_id is not null and q is not null"))
    n = asked.count()
    to = f"query_id {kind}, q array<double>, bucket int, block int"
    low = -2.0 if floor is None else floor
    ways = asked.mapInArrow(_routes(heads, True, k, least), to)
    found = _asked(index, snapshot, ways, n, k, low, unit, queries_a_block)
    if routes is not None:
        routes.append(ways.drop("q"))
    if k is not None:
        found = settled(found)
        near = top_k(found, k, ["query_id"], F.desc("score"), F.asc("id"))
        reached = near.filter(F.col("rank") == k).select("query_id", (2 * F.col("score") - 1 if unit else F.col("score")).alias("reached"))
        more = asked.join(reached, "query_id", "left").select("query_id", "q", "reached").mapInArrow(_routes(heads, False, k, least), to)
        found = found.unionByName(_asked(index, snapshot, more, n, k, low, unit, queries_a_block))
        if routes is not None:
            routes.append(more.drop("q"))
    return top_k(found, 1 << 62 if k is None else k, ["query_id"], F.desc("score"), F.asc("id"))
