"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Words, fold, labelled_sample, row_sums, slices, table, text_bytes

WORD_BUCKETS = 1 << 14
BINS = 12
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b".,;:?", b"\n", bytes(range(128, 256))]
_MASKS = [np.isin(np.arange(256), list(c)) for c in _CLASSES]
#: statistics of structure, in the order in which _statistics() lists them; the last is the metadata column n_chars
FIELDS = ["upper", "digits", "symbols", "shouts", "stops", "lines", "high", "words", "word_size", "distinct", "repeated", "n_chars"]
SIZE = WORD_BUCKETS + BINS * len(FIELDS)


def _binned(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bin 0 for x <= 0, then BINS - 1 bins of equal width in the logarithm from low to high."""
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.floor((np.log(np.maximum(x, 1e-12)) - np.log(low)) / (np.log(high) - np.log(low)) * (BINS - 1))
    return np.where(x > 0, 1 + np.clip(at, 0, BINS - 2), 0).astype(np.int64)


def features(raw: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of every non-zero feature of rows that lie end to end, by row.

    Words: log(1 + count) of each bucket, scaled to length 1 a row. Statistics: the bin that holds them, value 1."""
    n, words = len(offsets) - 1, Words(raw, offsets)
    keys, counts = np.unique(words.row * WORD_BUCKETS + (words.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
    row, bucket, value = keys // WORD_BUCKETS, keys % WORD_BUCKETS, np.log1p(counts)
    value /= np.sqrt(np.maximum(np.bincount(row, weights=value**2, minlength=n), 1e-12))[row]
    bytes_, n_words = np.maximum(np.diff(offsets), 1), np.bincount(words.row, minlength=n)
    shares = [row_sums(m[raw], offsets) / bytes_ for m in _MASKS]
    distinct = np.bincount(row, minlength=n)
    most = np.maximum(n_words, 1)
    stats = [_binned(s, 1e-4, 1.0) for s in shares]
    stats += [_binned(n_words, 1, 1e5), _binned(np.bincount(words.row, weights=words.size, minlength=n) / most, 1, 30), _binned(distinct / most, 0.02, 1.0001), _binned((n_words - distinct) / most, 0.02, 1.0001), _binned(n_chars, 1, 1e6)]
    rows = np.concatenate([row] + [np.arange(n)] * len(stats))
    index = np.concatenate([bucket] + [WORD_BUCKETS + BINS * f + s for f, s in enumerate(stats)])
    values = np.concatenate([value, np.ones(n * len(stats))])
    order = np.argsort(rows, kind="stable")
    return rows[order], index[order], values[order]


@dataclass
class FactorisationMachine:
    """bias + w.x + sum over pairs <v_i, v_j> x_i x_j, the pairs by half of (sum v x)^2 - sum (v x)^2."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(row, weights=self.linear[index] * value, minlength=n)
        for f in range(self.factors.shape[1]):
            vx = self.factors[index, f] * value
            out += 0.5 * (np.bincount(row, weights=vx, minlength=n) ** 2 - np.bincount(row, weights=vx * vx, minlength=n))
        return out

    def score(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(row, index, value, n), -40, 40)))

    @classmethod
    def fitted(cls, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rank: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """By AdaGrad on the logistic loss; docs: (index, value) of each."""
        rng = np.random.default_rng(seed)
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        m = cls(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)))
        if not len(y) or y.min() == y.max():
            m.factors[:] = 0
            return m
        g_bias, g_linear, g_factors = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for low in range(0, len(order), batch):
                part = order[low : low + batch]
                row = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
                index, value = (np.concatenate([docs[i][k] for i in part]) for k in (0, 1))
                own, back = np.unique(index, return_inverse=True)
                vx = m.factors[index] * value[:, None]
                sums = np.add.reduceat(vx, np.flatnonzero(np.diff(row, prepend=-1)), axis=0)
                out = m.bias + np.bincount(row, weights=m.linear[index] * value) + 0.5 * ((sums**2).sum(1) - np.bincount(row, weights=(vx**2).sum(1)))
                error = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[part]) / len(part)
                e = error[row] * value
                d_linear = np.bincount(back, weights=e) + decay * m.linear[own]
                pull = e[:, None] * (sums[row] - vx)
                d_factors = np.stack([np.bincount(back, weights=pull[:, f]) for f in range(rank)], 1) + decay * m.factors[own]
                g_bias += error.sum() ** 2
                g_linear[own] += d_linear**2
                g_factors[own] += d_factors**2
                m.bias -= rate * error.sum() / np.sqrt(g_bias)
                m.linear[own] -= rate * d_linear / np.sqrt(g_linear[own])
                m.factors[own] -= rate * d_factors / np.sqrt(g_factors[own])
        return m


def _inputs(docs: DataFrame, *more: Column) -> DataFrame:
    size = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", *more, F.coalesce(size, F.lit(0.0)).alias("n_chars"), text_bytes("text").alias("text"))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, offsets in slices(batch, "text"):
            row, index, value = features(raw, offsets, np.asarray(part.column("n_chars")))
            cuts = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.ListArray.from_arrays(cuts, pa.array(index, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(value, pa.float64()))], names=["y", "index", "value"])


def train(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = 6000) -> FactorisationMachine:
    """A machine fitted to at most sample labelled documents for which learn holds (a bound on what reaches the driver: features only)."""
    rows = _inputs(labelled_sample(documents.select("doc_id", "text", *[c for c in ("n_chars",) if c in documents.columns]), labels.select("doc_id", "quality"), "quality", learn, sample), F.col("y"))
    found = rows.mapInArrow(_described, "y int, index array<int>, value array<double>").toArrow()
    docs = [(np.asarray(i.values), np.asarray(v.values)) for i, v in zip(found.column("index"), found.column("value"), strict=True)]
    hashed = [int(i[:50].sum()) * 31 + len(i) for i, _ in docs]  # the same order whatever the partitions were
    order = np.argsort(hashed, kind="stable")
    return FactorisationMachine.fitted([docs[i] for i in order], np.asarray(found.column("y"), dtype=float)[order])


def score_quality(documents: DataFrame, model: FactorisationMachine, limit: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= limit) of every document, one row for one.

    The whole text counts. A null text is an empty one, which has a score as well; a null n_chars counts
    as 0; rows with a null doc_id are scored and not held out; repeated rows are scored each; other columns
    are not read."""
    linear, factors = model.linear.astype(np.float32), model.factors.astype(np.float32)
    fixed = FactorisationMachine(model.bias, linear, factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, "text"):
                score = fixed.score(*features(raw, offsets, np.asarray(part.column("n_chars"))), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= limit).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return _inputs(documents, held_out).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; the fold crc32(doc_id) mod 5 = 0 is held out of learning."""
    documents = table(spark, sf_dir, "documents")
    return score_quality(documents, train(documents, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0))
