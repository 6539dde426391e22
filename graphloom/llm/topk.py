"""Exact top-k search by integer inner product: exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import shared_dir, table

FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows that take part: id and vector are set and every component is a finite number."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)


def quantised(lists: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of a list array as a rows x terms matrix; a term that a shorter vector lacks weighs 0.

    Integers of Python where 64 bits may not hold a score."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    width = int(sizes.max()) if len(sizes) else 0
    values = np.floor(np.asarray(lists.flatten(), dtype=np.float64) * scale)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    if out.size and np.abs(out).max() >= 2.0**24:
        return np.array([[int(v) for v in r] for r in out], dtype=object).reshape(out.shape)
    return out.astype(np.int64)


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Dense scores, queries x rows of the block: each term's posting list is scattered, weighted, into all queries' arrays."""
    terms = min(queries.shape[1], block.shape[1])
    exact = object in (queries.dtype, block.dtype)
    if not exact and terms:
        top = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * terms
        kind = np.int32 if top < 2.0**31 else np.int64
    else:
        kind = object if exact else np.int64
    q, b = queries[:, :terms].astype(kind), np.ascontiguousarray(block[:, :terms].T).astype(kind)
    scores, room = np.zeros((len(q), block.shape[0]), dtype=kind), np.empty((len(q), block.shape[0]), dtype=kind)
    for term in range(terms):
        weights, postings = q[:, term], np.flatnonzero(b[term])
        if not len(postings) or not np.any(weights):
            continue
        if 2 * len(postings) >= block.shape[0]:  # most rows hold the term: the whole array is the posting list
            np.multiply(weights[:, None], b[term][None, :], out=room)
            scores += room
        else:
            scores[:, postings] += weights[:, None] * b[term][postings][None, :]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids are in ascending order."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > floor)
        at = np.concatenate([above, np.flatnonzero(scores == floor)[: k - len(above)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


class QueryBlocks:
    """Blocks of queries in the shared folder, as tasks read them: one after the other, the last one kept."""

    def __init__(self, path: str, blocks: int, scale: float):
        self.path, self.blocks, self.scale, self._last = path, blocks, scale, (None, None)

    def read(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's ids, ascending, and quantised vectors."""
        if self._last[0] != block:
            from pyarrow import fs, parquet

            store, base = fs.FileSystem.from_uri(self.path)
            folder = f"{base}/block={block}"
            found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            tables = [parquet.ParquetFile(store.open_input_file(x.path)).read(["vec_id", "x"]) for x in found if x.path.endswith(".parquet")]
            if tables:
                rows = pa.concat_tables(tables).combine_chunks()
                ids = np.asarray(rows.column(0), dtype=np.int64)
                order = np.argsort(ids, kind="stable")
                x = quantised(rows.column(1).combine_chunks(), self.scale)
                self._last = block, (ids[order], x[order])
            else:
                self._last = block, (np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
        return self._last[1]


def _search(asked: QueryBlocks, k: int, scale: float, rows: int, held: int):
    """Vectors of a task in runs of about held; each run meets every block of queries, of which k rows a query go on."""

    def found(run: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for number in range(asked.blocks):
            query_ids, queries = asked.read(number)
            kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
            for ids, block in run:
                for low in range(0, len(query_ids), 256):
                    scores = accumulate(queries[low : low + 256], block)
                    for i, own in enumerate(query_ids[low : low + 256]):
                        mine, names = scores[i], ids
                        a, b = np.searchsorted(ids, [own, own + 1])
                        if b > a:
                            mine, names = np.delete(mine, slice(a, b)), np.delete(ids, slice(a, b))
                        top = best(mine, names, k)
                        old_scores, old_ids = kept[low + i]
                        s, n = np.concatenate([old_scores, mine[top]]), np.concatenate([old_ids, names[top]])
                        keep = np.lexsort((n, -s))[:k]
                        kept[low + i] = s[keep], n[keep]
            if kept:
                yield _batch(query_ids, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids = np.asarray(batch.column(0), dtype=np.int64)
                order = np.argsort(ids, kind="stable")
                blocks.append((ids[order], quantised(batch.column(1), scale)[order]))
                size += len(ids)
                if size >= held:
                    yield from found(blocks)
                    blocks, size = [], 0
        if size:
            yield from found(blocks)

    return run


def _batch(query_ids: np.ndarray, kept: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    scores = [int(x) for s, _ in kept for x in s]
    if scores and not -(1 << 63) <= min(scores) <= max(scores) < 1 << 63:
        raise ValueError("a score is beyond 64 bits: vectors as large as these can't be scored in integers of that width")
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, [len(s) for s, _ in kept]), pa.int64()), pa.array(np.concatenate([n for _, n in kept]), pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", queries_per_round: int = 8192, block_rows: int = 4096, held_rows: int = 1 << 18) -> DataFrame:
    """The k rows of vectors with the highest integer inner product, for every row of queries.

    Components become floor(scale * x). Queries are written to the shared folder in blocks of about queries_per_round; one scan reads
    the vectors, and a task holds about held_rows of them at a time, reads the blocks one after the other and returns its k best
    a query, which a window merges. So neither the driver nor a task ever has all queries. Ties go to the smaller id, rows with
    the query's own id are no candidates, and a query with fewer than k candidates returns all of them.
    Null vectors or ids, and vectors with a null or non-finite component, take no part; vectors of
    different lengths meet in the terms they share. An id repeated among the queries is asked once, with
    the smallest of its vectors; repeated candidates stay separate rows. Among the best, a score beyond 64 bits is an error, since
    none of them can be returned. Empty tables give no rows. Returns query_id, rank (int, from 1), vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("x").alias("x"))
    blocks = -(-asked.count() // queries_per_round)
    path = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))).write.partitionBy("block").parquet(path)
    found = rows.mapInArrow(_search(QueryBlocks(path, blocks, scale), k, scale, block_rows, held_rows), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors, five best each."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
