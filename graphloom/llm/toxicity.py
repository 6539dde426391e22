"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from graphloom.llm.common import U64, Words, fold, labelled_sample, slices, table

#: Words of abuse, each a lexicon voter.
LEXICON = ["idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "disgusting", "clown", "dumb", "imbecile", "vermin", "filth", "garbage", "ugly", "hate", "kill", "fool", "jerk", "crap", "damn", "bastard", "freak"]

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_PREFIXES = (4, 5, 6, 7)
#: kinds of what is looked for: a whole word, or the first bytes of a longer one
_SALTS = np.array([0, *(0x9E3779B97F4A7C15 * k % (1 << 64) for k in _PREFIXES)], dtype=U64)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every word (a run of letters) and of its first 4, 5, 6 and 7 bytes."""
    words = Words(raw, offsets, _LETTER)
    rows, keys = [words.row], [words.hashes]
    for size, salt in zip(_PREFIXES, _SALTS[1:], strict=True):
        longer = words.size > size
        rows.append(words.row[longer])
        keys.append(words.prefixes(size)[longer] ^ salt)
    return np.concatenate(rows), np.concatenate(keys)


def _lexicon() -> np.ndarray:
    raw = np.frombuffer(" ".join(LEXICON).encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), _LETTER).hashes


def distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, each once, by row and key."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[first], key[first]


class Lookup:
    """Places of keys in a small set, by a bitmap and then a search."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.map = keys, np.zeros(1 << 20, dtype=bool)
        self.map[(keys & U64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        """Rows x keys: whether the row has the key."""
        out = np.zeros((n, len(self.keys)), dtype=bool)
        if len(self.keys):
            near = self.map[(key & U64((1 << 20) - 1)).astype(np.int64)]
            row, key = row[near], key[near]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[at] == key
            out[row[same], at[same]] = True
        return out


@dataclass
class LabelModel:
    """P(voter fires | y) of voters that fire or abstain, with the weight that correlation leaves to each.

    Fitted by expectation maximisation under a given share of class 1: bias is set in each round so that
    the mean posterior is that share. Voters that still move together within a class (residual correlation
    above cut) share one voice: the log likelihood ratio of each is divided by one plus the sum of its
    correlations, at most by fewest."""

    bias: float
    rates: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.evidence(votes), -40, 40)))

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        return votes @ (np.log(self.rates[1] / self.rates[0]) * self.weight)

    @classmethod
    def fitted(cls, votes: np.ndarray, share: float, rounds: int = 30, cut: float = 0.15, fewest: float = 3.0) -> LabelModel:
        n, voters = votes.shape
        v = votes.astype(float)
        model = cls(float(np.log(share / (1 - share))), np.array([np.full(voters, 0.02), np.full(voters, 0.3)]), np.ones(voters))
        if not n or not voters:
            return model
        for at in range(rounds):
            x, low, high = model.evidence(votes), -60.0, 60.0
            for _ in range(50):
                model.bias = (low + high) / 2
                low, high = (low, model.bias) if model.posterior(votes).mean() > share else (model.bias, high)
            p = 1 / (1 + np.exp(-np.clip(model.bias + x, -40, 40)))
            mass = np.array([(1 - p).sum(), p.sum()]) + 1e-9
            model.rates = np.clip(np.stack([((1 - p) @ v + 0.3) / (mass[0] + 1), (p @ v + 0.3) / (mass[1] + 1)]), 1e-5, 1 - 1e-5)
            if at % 5 == 4:
                left = v - (1 - p)[:, None] * model.rates[0] - p[:, None] * model.rates[1]
                spread = np.sqrt((left**2).mean(0)) + 1e-9
                tied = np.clip((left.T @ left) / n / np.outer(spread, spread), 0, 1)
                np.fill_diagonal(tied, 0)
                model.weight = 1 / np.minimum(1 + np.where(tied > cut, tied, 0).sum(1), fewest)
        return model


def voters(row: np.ndarray, key: np.ndarray, y: np.ndarray, most: int = 600, least: int = 4, lift: float = 8.0) -> np.ndarray:
    """Keys of the voters, in order: the lexicon, and as patterns the words and prefixes that learning rows marked toxic hold at least lift times as often as the others."""
    keys, back = np.unique(key, return_inverse=True)
    in_bad, in_all = np.bincount(back, weights=y[row] == 1, minlength=len(keys)), np.bincount(back, minlength=len(keys))
    bad = max(int((y == 1).sum()), 1)
    gain = ((in_bad + 0.5) / (bad + 1)) / ((in_all - in_bad + 0.5) / (max(len(y) - bad, 1) + 1))
    good = np.flatnonzero((in_bad >= least) & (gain >= lift))
    good = good[np.lexsort((keys[good], -in_bad[good] * np.log(gain[good])))[:most]]
    return np.unique(np.concatenate([_lexicon(), keys[good]]))


@dataclass
class ToxicityModel:
    """A linear classifier: the logistic function of bias plus the weights of the keys that a text holds."""

    bias: float
    keys: np.ndarray
    weights: np.ndarray

    def score(self, lookup: Lookup, row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + lookup.hits(row, key, n) @ self.weights, -40, 40)))

    @classmethod
    def fitted(cls, docs: list[np.ndarray], y: np.ndarray, most: int = 2048, rounds: int = 600, ridge: float = 3e-5) -> ToxicityModel:
        """docs: each row's distinct keys; y: labels, used only to induce pattern voters. The classifier learns the label model's posteriors."""
        row, key = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate([*docs, np.zeros(0, U64)]).astype(U64)
        named = voters(row, key, y)
        p = LabelModel.fitted(votes := Lookup(named).hits(row, key, len(docs)), float(np.clip((y == 1).mean() if len(y) else 0.1, 0.005, 0.5))).posterior(votes)
        # features: the keys that lean most to the posteriors, by a chi-squared score of their document counts
        keys, back = np.unique(key, return_inverse=True)
        n = max(len(docs), 1)
        count, mass = np.bincount(back, minlength=len(keys)), np.bincount(back, weights=p[row], minlength=len(keys))
        lean = (mass - count * p.sum() / n) ** 2 / np.maximum(count, 1)
        lean[count < 3] = 0
        keys = np.unique(np.concatenate([named, keys[np.lexsort((keys, -lean))[:most]]]))
        x = Lookup(keys).hits(row, key, len(docs)).astype(float)
        mean = np.clip(p.mean() if len(p) else 0.1, 0.01, 0.99)
        w, bias, step = np.zeros(len(keys)), float(np.log(mean / (1 - mean))), np.full(len(keys) + 1, 1e-6)
        for _ in range(rounds if len(docs) else 0):
            error = (1 / (1 + np.exp(-np.clip(bias + x @ w, -40, 40))) - p) / n
            slope = np.append(x.T @ error + ridge * w, error.sum())
            step += slope**2
            move = 0.3 * slope / np.sqrt(step)
            w, bias = w - move[:-1], bias - move[-1]
        return cls(bias, keys, w)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, offsets in slices(batch, "text"):
            row, key = distinct(*tokens(raw, offsets))
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(key.view(np.int64)))], names=["y", "keys"])


def train(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = 8000) -> ToxicityModel:
    """A classifier fitted on at most sample labelled documents for which learn holds (the bound on what reaches the driver: keys only)."""
    rows = labelled_sample(documents.select("doc_id", "text"), labels.select("doc_id", "toxic"), "toxic", learn, sample)
    found = rows.select("y", F.lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary").alias("text")).mapInArrow(_described, "y int, keys array<long>").toArrow()
    docs = [np.asarray(k.values).view(U64) for k in found.column("keys")]
    order = np.argsort([int(d[:8].sum() % U64(1 << 62)) if len(d) else 0 for d in docs], kind="stable")  # whatever the partitions were
    return ToxicityModel.fitted([docs[i] for i in order], np.asarray(found.column("y"))[order])


def score_toxicity(documents: DataFrame, model: ToxicityModel, limit: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= limit) of every document, one row for one.

    The whole text counts. A null text is an empty one and has the score of no evidence; rows with a null
    doc_id are scored and not held out; repeated rows are scored each; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.keys)
        for batch in batches:
            for part, raw, offsets in slices(batch, "text"):
                score = model.score(lookup, *tokens(raw, offsets), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= limit).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", held_out, F.lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(documents: DataFrame, model: ToxicityModel, limit: float = 0.3) -> DataFrame:
    """documents, all columns, without the rows whose text scores limit or more.

    Only texts go to Python; other columns, whatever their names, stay where they are. A null text is an empty one and
    stays if no evidence scores under limit; repeated rows are judged alike; an empty table stays empty."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lookup = Lookup(model.keys)
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            scores = [model.score(lookup, *tokens(raw, offsets), part.num_rows) for part, raw, offsets in slices(batch, "text")]
            yield pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())

    score = F.arrow_udf(scored, "double", ArrowUDFType.SCALAR_ITER)
    return documents.filter(score(F.lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary")) < limit)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; the fold crc32(doc_id) mod 4 = 2 is held out of learning."""
    documents = table(spark, sf_dir, "documents")
    return score_toxicity(documents, train(documents, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2))
