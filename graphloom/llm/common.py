"""What the training-data operators share: table reading, cut lineage, byte-level word arithmetic."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, as it lies on disk."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/graphloom-intermediate"


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Sets the session's bound of bytes in an Arrow batch to most, unless it has one already: batches of long texts then stay small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(most))


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written once as Parquet in the shared folder and read again: lineage ends there, lost executors recompute nothing before it.

    What was shuffled for it is deleted once it is written, instead of when the driver happens to collect its garbage. The second value is the path, for forget()."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes what materialise() wrote, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered_rows(documents: DataFrame) -> tuple[DataFrame, str]:
    """(row, doc) of every row of documents, written once: a number that stays the same whoever reads it, ascending in the table's order, and all columns as a struct, whose names clash with nothing."""
    return materialise(documents.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")), "rows")


def text_bytes(name: str) -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds (null for a null doc_id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary Arrow array's bytes end to end, and the n + 1 offsets of its rows in them."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all of the input's (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(batch: pa.RecordBatch, name: str, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in runs of rows with about most bytes in the binary column name (a longer row stands alone), with flat() of each."""
    column = batch.column(name)
    _, offsets = flat(column)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        part = batch.slice(low, high - low)
        yield part, *flat(part.column(name))
        low = high


class Words:
    """All words of rows that lie end to end: runs of the bytes that ink marks.

    start, end: byte positions; row: each word's row; hashes: 64 bits, equal for equal words in every
    process (a polynomial in the bytes, mixed). A-Z is folded if lower. What takes 64 bits a byte is made for
    runs of words of about block bytes, so a long row takes little more room than its words do."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, ink: np.ndarray = ~_SPACE, lower: bool = True, block: int = 1 << 16):
        n, inked = len(raw), ink[raw]
        first, last = inked.copy(), inked.copy()
        first[1:] &= ~inked[:-1]
        last[:-1] &= ~inked[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = inked[edges]
        last[edges - 1] = inked[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.size = self.end - self.start
        self._raw, self._fold = raw, _LOWER if lower else np.arange(256, dtype=np.uint8)
        self.hashes = np.zeros(len(self.start), U64)
        if len(self.start):
            ends = np.cumsum(self.size)
            low = 0
            while low < len(ends):
                before = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + block, side="right")))
                self.hashes[low:high] = self._hashed(slice(low, high), inked)
                low = high

    def _hashed(self, part: slice, inked: np.ndarray) -> np.ndarray:
        low, high, size = self.start[part][0], self.end[part][-1], self.size[part]
        begin = np.cumsum(size) - size
        powers = np.full(int(size.max()), _ODD, U64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        body = self._fold[self._raw[low:high][inked[low:high]]]
        return self._mixed(np.add.reduceat((body.astype(U64) + U64(1)) * powers[within], begin), size)

    @staticmethod
    def _mixed(value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(value + size.astype(U64) * U64(0xD6E8FEB86659FD93))

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the words' first size bytes; a shorter word's is that of the whole word."""
        value, power = np.zeros(len(self.start), U64), 1
        for at in range(size):
            held = self.size > at
            byte = self._fold[self._raw[np.where(held, self.start + at, 0)]] if len(self._raw) else np.zeros(0, np.uint8)
            value += np.where(held, (byte.astype(U64) + U64(1)) * U64(power), U64(0))
            power = power * _ODD % (1 << 64)
        return self._mixed(value, np.minimum(self.size, size))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values (one a byte) over rows."""
    full = offsets[1:] > offsets[:-1]
    out = np.zeros(len(offsets) - 1, np.int64)
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """documents joined with their labels as column y: at most most rows for which learn holds.

    The labels are those with the smallest hash of doc_id, so the sample is a fixed, source-blind one; its
    ids are bounded by most and are broadcast. A doc_id labelled more than once has its smallest label; where a doc_id
    has several rows of documents, the rows too are bounded by most."""
    chosen = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = documents.join(F.broadcast(chosen), "doc_id")
    return sample if sample.select("doc_id").count() <= most else sample.limit(most)
