"""Best-fit packing of token pieces by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import random
import zlib
from array import array
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import LibraryBpe, default_vocabulary, groups, loaded
from graphloom.llm.common import materialise, table

Bins = list[list[int]]  # items of each bin


class Rests:
    """Bins by the room that is left in them; the tightest that takes an item is found by one scan of a bitmap."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.room = capacity, [], []
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.map = 0

    def open(self, items: list[int], fill: int) -> None:
        self.bins.append(items)
        self.room.append(self.capacity - fill)
        self._note(len(self.bins) - 1)

    def _note(self, b: int) -> None:
        rest = self.room[b]
        self.at[rest].append(b)
        self.map |= 1 << rest

    def best_fit(self, item: int, size: int) -> None:
        left = self.map >> size
        if not left:
            self.open([item], size)
            return
        rest = size + (left & -left).bit_length() - 1
        b = self.at[rest].pop()
        if not self.at[rest]:
            self.map &= ~(1 << rest)
        self.bins[b].append(item)
        self.room[b] = rest - size
        self._note(b)


class GroupingGenetic:
    """A population of packings of the same items. Bins are the genes: a crossover injects whole, well-filled bins
    of one parent into the other, drops the other's bins that share an item with them, and best-fits the items
    that this displaces, in an order more or less by size; a mutation empties the least filled bins and some others and best-fits what they held."""

    def __init__(self, sizes: list[int], capacity: int, seed: int, population: int = 4):
        self.sizes, self.capacity, self.rng, self.most = sizes, capacity, random.Random(seed), population
        self.bound = -(-sum(sizes) // capacity)
        self.people: list[tuple[tuple, Bins]] = []

    def fill(self, items: list[int]) -> int:
        return sum(map(self.sizes.__getitem__, items))

    def worth(self, bins: Bins) -> tuple:
        """Fewer bins first; among as many, those whose fills differ more."""
        return -len(bins), sum(self.fill(b) ** 2 for b in bins)

    def admit(self, bins: Bins) -> None:
        self.people.append((self.worth(bins), bins))
        self.people.sort(key=lambda p: p[0], reverse=True)
        del self.people[self.most :]

    def fitted(self, kept: Bins, loose: list[int], noise: float = 0.0) -> Bins:
        rests = Rests(self.capacity)
        for b in kept:
            rests.open(list(b), self.fill(b))
        for i in sorted(loose, key=lambda i: (-self.sizes[i] * (1 + noise * self.rng.random()), i)):
            rests.best_fit(i, self.sizes[i])
        return rests.bins

    def seed_people(self) -> None:
        """Fills the population up: best fit in falling order of size, and in orders that stray from it more and more."""
        everything = list(range(len(self.sizes)))
        for k in range(self.most - len(self.people)):
            self.admit(self.fitted([], everything, 0.4 * k))

    def done(self) -> bool:
        return bool(self.people) and len(self.people[0][1]) <= self.bound

    def crossover(self, giver: Bins, taker: Bins) -> Bins:
        full = sorted(giver, key=self.fill, reverse=True)[: max(1, len(giver) // 2)]
        injected = self.rng.sample(full, max(1, len(full) // 3))
        inside = {i for b in injected for i in b}
        kept = [b for b in taker if inside.isdisjoint(b)]
        displaced = [i for b in taker if not inside.isdisjoint(b) for i in b if i not in inside]
        return self.fitted(injected + kept, displaced, self.rng.choice((0.0, 0.5, 1.0)))

    def mutated(self, bins: Bins) -> Bins:
        order = sorted(bins, key=self.fill)
        n = max(2, len(order) // 20)
        more = set(self.rng.sample(range(n, len(order)), min(n, len(order) - n))) if len(order) > n else set()
        emptied = [*range(min(n, len(order))), *more]
        return self.fitted([b for k, b in enumerate(order) if k >= n and k not in more], [i for k in emptied for i in order[k]], self.rng.choice((0.1, 0.5, 1.0)))

    def evolve(self, generations: int, least: int) -> Bins:
        """Up to generations children, at least least of them; beyond that until the lower bound of bins is reached."""
        for born in range(generations):
            if len(self.people) < 2 or born >= least and self.done():
                break
            a, b = self.rng.sample([p[1] for p in self.people], 2)
            child = self.crossover(a, b)
            self.admit(self.mutated(child) if self.rng.random() < 0.5 else child)
        return self.people[0][1] if self.people else []


_ELITE = "shard long, island int, items array<long>, sizes array<int>, bins array<int>, worth double"


def _row(shard: int, island: int, items: list[int], sizes: list[int], genetic: GroupingGenetic, bins: Bins, capacity: int) -> pd.DataFrame:
    where = [0] * len(items)
    for k, b in enumerate(bins):
        for i in b:
            where[i] = k
    worth = -len(bins) + genetic.worth(bins)[1] / (capacity**2 * (len(bins) + 1.0))
    return pd.DataFrame({"shard": [shard], "island": [island], "items": [items], "sizes": [sizes], "bins": [where], "worth": [worth]})


def _settle(capacity: int, generations: int, least: int):
    """The first epoch: (shard, island, item, size) rows to the island's elite."""

    def run(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        part = part.sort_values("item")
        items, sizes = part["item"].tolist(), part["size"].tolist()
        genetic = GroupingGenetic(sizes, capacity, seed=shard * 1009 + island)
        genetic.seed_people()
        return _row(shard, island, items, sizes, genetic, genetic.evolve(generations, least), capacity)

    return run


def _migrate(capacity: int, generations: int, least: int):
    """A later epoch: an island's own elite and its neighbour's found the population that goes on."""

    def run(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        items, sizes = [int(i) for i in part["items"].iloc[0]], [int(s) for s in part["sizes"].iloc[0]]
        genetic = GroupingGenetic(sizes, capacity, seed=shard * 1009 + island + 500_009)
        for where in part.sort_values("worth", ascending=False)["bins"]:
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(where):
                bins.setdefault(int(b), []).append(i)
            genetic.admit(list(bins.values()))
        genetic.seed_people()
        return _row(shard, island, items, sizes, genetic, genetic.evolve(generations, least), capacity)

    return run


def _placed(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for items, sizes, where in zip(frame["items"], frame["sizes"], frame["bins"], strict=True):
                out = pd.DataFrame({"item": items, "size": sizes, "bin": where}).sort_values(["bin", "item"])
                by = out.groupby("bin")
                out["sequence_id"], out["offset"] = by["item"].transform("min"), by["size"].cumsum() - out["size"]
                out["fill"] = by["size"].transform("sum")
                yield out[["item", "size", "sequence_id", "offset", "fill"]].astype("int64")

    return run


def pack(items: DataFrame, capacity: int = 4096, shard_items: int = 2048, islands: int = 2, generations: int = 12, least: int = 3, dissolve: float = 0.97, levels: int = 4) -> DataFrame:
    """(item, sequence_id, offset) of a packing of (item, size) rows, 1 <= size <= capacity, item unique.

    Items are dealt by hash to shards of about shard_items. Each shard lives on several islands, which evolve
    apart for least to generations children from unlike seeds; then each island's elite joins its neighbour's and both
    evolve on as long; the best island's packing counts.
    Bins filled less than the share dissolve are pooled over all shards and dealt out anew, level by level, until
    one shard takes the pool, so what shards waste at their edges is won back. Lengths alone move: a shard's
    memory is bounded by its items. sequence_id is the smallest item of its sequence."""
    spark, done, pool = items.sparkSession, [], items.select(F.col("item").cast("long"), F.col("size").cast("int"))
    alone = pool.filter(F.col("size") == capacity)
    done.append(alone.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    pool = pool.filter(F.col("size") < capacity)
    for level in range(levels):
        n = pool.count()
        if not n:
            break
        shards = -(-n // shard_items)
        spread = pool.select(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard"), "item", "size", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
        elites = spread.groupBy("shard", "island").applyInPandas(_settle(capacity, generations, least), _ELITE)
        visits = elites.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)))))
        elites = visits.groupBy("shard", "island").applyInPandas(_migrate(capacity, generations, least), _ELITE)
        best = elites.groupBy("shard").agg(F.max_by(F.struct("items", "sizes", "bins"), F.struct("worth", -F.col("island"))).alias("b")).select("b.*")
        placed, _ = materialise(best.mapInPandas(_placed(capacity), "item long, size long, sequence_id long, offset long, fill long"), f"packed-{level}")
        full = F.col("fill") >= dissolve * capacity
        last = shards == 1 or level == levels - 1
        done.append((placed if last else placed.filter(full)).select("item", "sequence_id", "offset"))
        if last:
            break
        pool = placed.filter(~full).select("item", F.col("size").cast("int"))
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out if done else spark.createDataFrame([], "item long, sequence_id long, offset long")


def token_pieces(documents: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item, doc_id, piece, start, length, ids_crc32): every document's ids and end_id, cut where longer than capacity.

    Null texts count as empty: their piece is end_id alone. item numbers the pieces; it is fixed once the rows are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary, LibraryBpe)
        end, step = array("I", [end_id]).tobytes(), 4 * capacity
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1).to_pylist()):
                ids_of, rows = bpe.packed().__getitem__, []
                for doc, text in enumerate(texts, at):
                    ids = b"".join(map(ids_of, bpe.chunks(text))) + end
                    for piece, low in enumerate(range(0, len(ids), step)):
                        part = ids[low : low + step]
                        rows.append((item, doc, piece, low // 4, len(part) // 4, zlib.crc32(part)))
                        item += 1
                items, docs, pieces, starts, sizes, sums = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), batch.column(0).take(pa.array(docs)), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["item", "doc_id", "piece", "start", "length", "ids_crc32"])
                at += len(texts)

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"item long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Whole texts; only documents of more than capacity ids are cut. Repeated rows and null ids are packed like
    any other; an empty table gives no rows; other columns are not read."""
    pieces, _ = materialise(token_pieces(documents, vocabulary, capacity, end_id), "pieces")
    placed = pack(pieces.select("item", F.col("length").alias("size")), capacity)
    return pieces.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), default_vocabulary())
