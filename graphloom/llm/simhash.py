"""SimHash near-duplicates, found through Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import U64, materialise, numbered_rows, table, text_bytes
from graphloom.llm.components import connected_components

# -- fingerprints


def shingle_hashes(text: bytes, size: int, seed: int) -> list[int]:
    """XXH64 of every run of size words (all words as one run if there are fewer; none of no word), A-Z folded."""
    words = text.lower().split()  # bytes: only ASCII letters and ASCII white space
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - size + 1, 1)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)]


def fingerprints(documents: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row: bit i of the 64 is 1 if over half of the text's shingle hashes have it. No word: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, hashes, counts = [], [], []

            def turn(out=out, hashes=hashes, counts=counts) -> None:
                n, found = np.array(counts), np.zeros(len(counts), U64)
                full = np.flatnonzero(n)
                if len(full):
                    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
                    found[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
                out.append(found)
                hashes.clear()
                counts.clear()

            for text in batch.column(1):
                own = shingle_hashes(text.as_py(), size, seed)
                hashes += own
                counts.append(len(own))
                if len(hashes) > 200_000:
                    turn()
            turn()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], names=["doc_id", "fp"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


# -- the perfect Golay code of 23 bits


class Golay:
    """Decoding of any 23-bit word to the one codeword within 3 bits, by its 12-bit index.

    Polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. The 2,048 error patterns of weight up to 3 have all different
    syndromes, so a table by syndrome, made here by rule, decodes everything."""

    POLYNOMIAL = 0b101011100011

    def __init__(self):
        low = np.array([self._rest(v) for v in range(1 << 12)], np.int32)
        high = np.array([self._rest(v << 12) for v in range(1 << 11)], np.int32)
        self._low, self._high = low, high
        self._error = np.zeros(1 << 11, np.int32)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                word = sum(1 << b for b in bits)
                self._error[self._rest(word)] = word

    def _rest(self, word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= self.POLYNOMIAL << (bit - 11)
        return word

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self._error[self._low[words & 4095] ^ self._high[words >> 12]]) >> 11

    def keys(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, index): the indices of a word and of all words one bit away, each once.

        One if the word lies within 2 bits of its codeword, else about six. Two words that differ in up to 2 bits
        have a word between them, one bit from both, and so share the index that it decodes to."""
        near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(bits))[None, :]], axis=1)
        found = np.sort(self.index(near), axis=1)
        new = np.ones(found.shape, dtype=bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        place, at = np.nonzero(new)
        return place, found[place, at]


#: (shift, bits) of the three segments, and of the two halves of each
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
HALVES = [[(0, 11), (11, 11)], [(22, 10), (32, 11)], [(43, 10), (53, 11)]]


def _cut(fp: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    return (fp >> U64(part[0])).astype(np.int64) & ((1 << part[1]) - 1)


def fuzzy_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) such that any two fingerprints that differ in at most 4 bits share a key.

    Of three segments, if one is without error then another has at most 2: its exact bits go with the other's
    Golay indices (six ordered pairs). Otherwise all have errors, and with 4 in all two segments have just one,
    so that each has a clean half, and the third at most 2: two halves go with the third's indices (twelve choices).
    Keys hold these bits themselves and the number of the choice, in 39 bits."""
    coded = [golay.keys(_cut(fp, s).astype(np.int32), s[1]) for s in SEGMENTS]
    keys, places, choice = [], [], 0
    for i, j in permutations(range(3), 2):
        place, index = coded[j]
        keys.append(choice << 34 | _cut(fp, SEGMENTS[i])[place] << 12 | index)
        places.append(place)
        choice += 1
    for i, j in combinations(range(3), 2):
        place, index = coded[3 - i - j]
        for a in HALVES[i]:
            for b in HALVES[j]:
                keys.append(choice << 34 | (_cut(fp, a) << 11 | _cut(fp, b))[place] << 12 | index)
                places.append(place)
                choice += 1
    return np.concatenate(keys), np.concatenate(places)


# -- links


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        fp = np.asarray(batch.column(0)).view(U64)
        for low in range(0, len(fp), 4096):
            part = fp[low : low + 4096]
            key, place = fuzzy_keys(part, golay)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[place].view(np.int64))], names=["key", "fp"])


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what lies within distance, directly or by steps, and no more of them than that takes."""
    left, out, edge = fp, [], []
    while len(left):
        if not edge:
            edge, left = [left[0]], left[1:]
        node = edge.pop()
        near = np.bitwise_count(left ^ node) <= distance
        if near.any():
            out += [(int(node), int(x)) for x in left[near]]
            edge += list(left[near])
            left = left[~near]
    return out


def _buckets(distance: int, most: int):
    """Partitions sorted by key to links within each key's bucket; fingerprints of a bucket with over most come back with b null."""

    def rows(pairs: np.ndarray, large: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(pairs, axis=0)
        loose = np.unique(np.concatenate(large)) if large else np.zeros(0, np.int64)
        b = pa.array(np.concatenate([pairs[:, 1], loose]), mask=np.arange(len(pairs) + len(loose)) >= len(pairs))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], loose])), b], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, swollen, size, pairs, large = None, [], False, 0, [np.zeros((0, 2), np.int64)], []

        def close() -> None:
            if swollen:
                large.extend(held)
            elif size > 1:
                links = forest(np.concatenate(held).view(U64), distance)
                pairs.append(np.array(links, dtype=U64).view(np.int64).reshape(-1, 2))

        for batch in batches:
            key, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(key):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            sizes = np.diff(cuts)
            # pairs within small buckets that lie wholly inside the batch, by their distance in the row order
            whole = np.ones(len(sizes), dtype=bool)
            whole[-1] = False
            whole[0] &= held_key is None or key[0] != held_key
            small = np.repeat(whole & (sizes > 1) & (sizes <= 12), sizes)
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(small)
            for step in range(1, 12):
                at = at[at + step < len(key)]
                at = at[bucket[at] == bucket[at + step]]
                if not len(at):
                    break
                x, y = fp[at], fp[at + step]
                near = np.bitwise_count((x ^ y).view(U64)) <= distance
                pairs.append(np.stack([x[near], y[near]], axis=1))
            for k in np.flatnonzero(~whole | (sizes > 12)):
                part = fp[cuts[k] : cuts[k + 1]]
                if held_key is None or key[cuts[k]] != held_key:
                    close()
                    held_key, held, swollen, size = key[cuts[k]], [], False, 0
                held.append(part)
                size += len(part)
                swollen = swollen or size > most
                if swollen and size > 4 * most:  # a bucket beyond the bound leaves memory as it comes
                    large.extend(held)
                    held.clear()
                    size = most + 1
            if sum(map(len, pairs)) + sum(map(len, large)) > 200_000:
                yield rows(np.concatenate(pairs), large)
                pairs, large = [np.zeros((0, 2), np.int64)], []
        close()
        yield rows(np.concatenate(pairs), large)

    return run


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.array([0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)], dtype=U64)
    for batch in batches:
        fp = np.asarray(batch.column(0)).view(U64)
        for low in range(0, len(fp), 16):
            part = fp[low : low + 16]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["key", "fp"])


def near_links(distinct_fp: DataFrame, most: int = 2048) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fp that differ in at most 4 bits.

    Fingerprints, each once, are dealt by fuzzy keys; every bucket is verified exactly and gives no more links
    than join what is near. A bucket of over most fingerprints, which only thousands of unequal near copies
    make, is left to an exact way whose work is linear in it: each of its fingerprints goes to all 2,081 words
    within 2 bits; two are within 4 bits just if they meet at such a word, and those that meet at one are
    linked to the smallest of them."""
    spread = distinct_fp.select("fp").mapInArrow(_spread, "key long, fp long")
    parts = spread.repartition("key").sortWithinPartitions("key")
    found, _ = materialise(parts.mapInArrow(_buckets(4, most), "a long, b long"), "near")
    links = found.filter(F.col("b").isNotNull())
    large = found.filter(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    if not found.filter(F.col("b").isNull()).isEmpty():
        balls = large.mapInArrow(_balls, "key long, fp long")
        hubs = balls.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
        links = links.unionAll(balls.join(hubs, "key").select(F.col("fp").alias("a"), "b").filter("a <> b").distinct())
    return links


def fingerprint_roots(distinct_fp: DataFrame) -> DataFrame:
    """(fp, root) of every fp, each once in distinct_fp: the smallest fingerprint of its component."""
    roots = connected_components(near_links(distinct_fp)).select(F.col("node").alias("fp"), "root")
    return distinct_fp.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def salted_join(rows: DataFrame, few: DataFrame, key: str, hot: int = 50_000, most: int = 10_000) -> DataFrame:
    """rows joined with few, which holds each key once, so that no key's rows meet in one task.

    Keys of over hot rows, of which there are fewer than rows over hot, are counted first; where most of them do at most,
    their rows of few are broadcast, and the rest is joined by key."""
    frequent = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).orderBy(F.desc("_n"), key).limit(most).select(key)
    frequent, path = materialise(frequent, "hot")
    if frequent.isEmpty():
        return rows.join(few, key)
    named = F.broadcast(frequent)
    return rows.join(named, key, "left_anti").join(few, key).unionByName(rows.join(named, key, "left_semi").join(F.broadcast(few.join(named, key, "left_semi")), key))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 50_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links of at most 4 bits) of every row.

    Whole texts count; a null text is an empty one, with fingerprint zero, which links like any other. Equal
    fingerprints are compared once, whatever their number, and those of over hot rows are joined by broadcast.
    Repeated rows stay; a null doc_id is nobody's component_id unless its component has no other. Other columns are
    not read; an empty table gives no rows."""
    marks, _ = materialise(fingerprints(documents, id_col=id_col, text_col=text_col), "marks")
    first = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted, _ = materialise(first.join(fingerprint_roots(first.select("fp")), "fp"), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    owners = salted_join(rooted, smallest, "root", hot).select("fp", "component_id")
    return salted_join(marks, owners, "fp", hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(documents: DataFrame) -> DataFrame:
    """documents, all columns, with one row of each component: that with the smallest doc_id, of several the first in the table.

    Rows are told apart by their place, so repeated rows are one component and leave one row, rows of one doc_id with
    different texts are judged each, and a null doc_id comes after all others. Null and empty texts are one component.
    Nothing else is dropped; an empty table stays empty."""
    rows, _ = numbered_rows(documents)
    marks, _ = materialise(fingerprints(rows.select("row", F.col("doc.text").alias("text")), id_col="row"), "marks")
    names = rows.select(F.col("row").alias("doc_id"), F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").alias("name"), "row").alias("first"))
    first, _ = materialise(marks.join(names, "doc_id").groupBy("fp").agg(F.min("first").alias("first")), "firsts")
    kept = first.join(fingerprint_roots(first.select("fp")), "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    kept, _ = materialise(kept, "kept")
    return rows.join(kept.hint("shuffle_hash"), "row", "left_semi").select("doc.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
