"""Operators held against brute force."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, components, packing, passages, simhash, topk

U64 = np.uint64


def test_bpe_equals_the_library():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_vocabulary())
    own, rng = bpe.WordBpe(bpe.default_vocabulary()), random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("abcdeehinorst'  .,!0123ABCéÉñß́İΣ中文\n\t\x1c<|>") for _ in range(rng.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    assert own.encode_words(set(words)) == bpe.LibraryBpe(bpe.default_vocabulary()).encode_words(set(words))


def test_ways_by_suffixes_are_walked_once(monkeypatch):
    """F2, op2_bpe_round_trip: where the automaton goes by way of suffixes is found once, not for each word, and what is kept of it is bounded."""
    own, steps, step = bpe.WordBpe(bpe.default_vocabulary()), [], bpe.WordBpe._step
    own.encode_words(["the"])
    monkeypatch.setattr(bpe.WordBpe, "_step", lambda self, state, c: steps.append(1) or step(self, state, c))
    words = ["xqzvkw" * n + end for n in (2, 3) for end in ("", "jq")]
    first = own.encode_words(words)
    met = len(steps)
    assert met and own.encode_words(words) == first and len(steps) == met
    monkeypatch.setattr(bpe.WordBpe, "MOST_FAR", 0)
    assert own.encode_words(words) == first and len(own._far) == met
    library = bpe.LibraryBpe(bpe.default_vocabulary())
    assert library.encode_words(words) == first


def test_fuzzy_keys_meet_within_four_bits():
    rng, golay = np.random.default_rng(1), simhash.Golay()
    a = rng.integers(0, 1 << 63, 2000, dtype=np.int64).astype(U64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= U64(1 << int(bit))
    sets = []
    for x in (a, b):
        held = defaultdict(set)
        for k, p in zip(*simhash.fuzzy_keys(x, golay), strict=True):
            held[int(p)].add(int(k))
        sets.append(held)
    assert all(sets[0][i] & sets[1][i] for i in range(len(a)))


@pytest.mark.parametrize("most", [2048, 2])
def test_links_give_all_components(spark, most):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    for _ in range(200):
        x = fps[int(rng.integers(len(fps)))]
        for bit in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            x ^= 1 << int(bit)
        fps.append(x)
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in fps})
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), most)
    root = {x: x for x in fps} | {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin((x ^ y) & (1 << 64) - 1).count("1") <= 4:
                parent[find(x)] = find(y)
    groups = [defaultdict(set), defaultdict(set)]
    for x in fps:
        groups[0][root[x]].add(x)
        groups[1][find(x)].add(x)
    assert {frozenset(g) for g in groups[0].values()} == {frozenset(g) for g in groups[1].values()}


def test_fingerprint_bits(spark):
    text = "A b  c d\ne É f g h b c d e"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert simhash.near_duplicates(rows).first()["fingerprint"] == f"{want:016x}"


def test_compact_windows():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 300):
        x = rng.integers(0, 40, n).astype(U64)
        got = {tuple(map(int, w)) for w in zip(*passages.compact_windows(x, 7), strict=True)}
        want = set()

        def walk(low, high, x=x, want=want):
            stack = [(low, high)]
            while stack:
                low, high = stack.pop()
                if high - low < 7:
                    continue
                c = low + int(np.argmin(x[low:high]))
                if x[c] > 0:
                    want.add((c, low, high - 1))
                stack += [(low, c), (c + 1, high)]

        walk(0, n)
        assert got == {w for w in want}


def test_repeated_passages(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 999)) for _ in range(n)]
    passage, docs = words(60), {}
    for i in range(8):
        docs[i] = words(40) + (passage if i % 2 else []) + words(70)
    near = list(passage)
    near[30] = "changed"
    docs[8] = words(30) + near + words(30)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = passages.repeated_passages(rows).collect()
    assert {r["doc_id"] for r in got} == {1, 3, 5, 7, 8}
    assert {r["doc_id"] for r in got if r["extra"]} == {3, 5, 7, 8}
    assert all(40 <= r["start_word"] <= 41 and 99 <= r["end_word"] <= 101 for r in got if r["doc_id"] in (3, 5, 7) and r["similarity"] == 1.0)
    cut = {r["doc_id"]: r["text"].split() for r in passages.drop_repeats(rows).collect()}
    assert cut[1] == docs[1] and cut[0] == docs[0]
    assert cut[3] == docs[3][:40] + docs[3][100:]


def _unlike(rng):
    return lambda n: [f"{rng.choice('abcdefghij')}{rng.randint(0, 10**9)}" for _ in range(n)]


def test_near_passages_are_candidates(spark):
    words, docs = _unlike(random.Random(7)), []
    for i in range(400):  # one word changed in 50: 41 of 46 shingles, similarity 0.8
        passage = words(50)
        docs += [(2 * i, words(80) + passage + words(80)), (2 * i + 1, words(80) + [*passage[:25], "changed", *passage[26:]] + words(80))]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    found = {(r["doc_id"], r["partner_id"]) for r in passages.repeated_passages(rows).collect()}
    assert len([i for i in range(400) if (2 * i, 2 * i + 1) in found]) >= 396
    assert all(a // 2 == b // 2 for a, b in found)


def test_middle_documents_of_a_group_meet(spark):
    words, docs = _unlike(random.Random(8)), []
    for i in range(100):
        start, rest = words(45), words(10)
        docs += [start + (rest if j in (1, 2) else []) + words(80) for j in range(4)]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    found = {(r["doc_id"], r["partner_id"]) for r in passages.repeated_passages(rows).collect() if r["similarity"] == 1.0}
    assert {(4 * i + 1, 4 * i + 2) for i in range(100)} <= found


def test_spans_of_a_group_are_linked():
    rng = np.random.default_rng(9)
    for size in (5, 14, 40):
        for _ in range(20):
            roots = rng.integers(1, 1 << 15, (3, 91)).astype(np.uint16)
            near = roots[rng.integers(0, 3, size)]
            for row in near:
                row[: rng.integers(0, 46)] = row[rng.integers(46, 92) :] = rng.integers(1, 1 << 15)
            near[:, 45] = 7
            low, high = passages._equal_run((near[:, None, :] == near[None, :, :]).reshape(size * size, 91))
            like = {(i // size, i % size) for i in np.flatnonzero(high - low + 1 >= 46).tolist() if i // size < i % size}
            a, b, low_a, high_a, low_b, high_b, s = passages._pairs(near, np.arange(size), np.array([0]), 46, 0.8)
            assert all((near[x, i : j + 1] == near[y, p : q + 1]).all() for x, y, i, j, p, q, t in zip(a, b, low_a, high_a, low_b, high_b, s, strict=True) if t == 1)
            owner = list(range(size))
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                owner = [owner[i] if o == owner[j] else o for o in owner]
            assert all(owner[i] == owner[j] for i, j in like)
            assert {j for _, j in like} <= set(b.tolist()) | set(a.tolist())


def test_runs_with_words_changed_put_in_or_left_out():
    rng = np.random.default_rng(10)
    for change in ("none", "changed", "put in", "left out"):
        near = np.zeros((400, 91), np.uint16)
        for i in range(0, 400, 2):
            near[i] = rng.integers(1, 1 << 15, 91)
            at = int(rng.integers(62, 85))  # far enough from the middle
            other = rng.integers(1, 1 << 15, 5 if change == "changed" else 4)
            tail = {"none": near[i, at:], "changed": near[i, at + 5 :], "put in": near[i, at + 4 - 4 :], "left out": near[i, at + 5 :]}[change]
            moved = np.concatenate([near[i, :at], [] if change == "none" else other, tail])
            near[i + 1] = np.resize(np.concatenate([moved, rng.integers(1, 1 << 15, 91)]), 91)
        a = np.arange(0, 400, 2)
        x, y, low_a, high_a, low_b, high_b, s = passages._matched(near, a, a + 1, 46, 0.8)
        assert set(x.tolist()) == set(a.tolist())
        assert ((s >= 0.8) & (high_a - low_a >= 45) & (high_b - low_b >= 45)).all()


def test_recall_of_one_word_changed_put_in_or_left_out(spark):
    """End to end: passages of 52 words and more, the word anywhere but in the outer eight, one pair a passage and families of twenty variants."""
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]

    def edited(p, kind):
        q, at = list(p), rng.randrange(8, len(p) - 8)
        return q[:at] + ([] if kind == "left out" else words(1)) + q[at + (kind != "put in") :]

    rows, pairs, family = [], {}, {}
    for size in (52, 55, 60, 100):
        for kind in ("changed", "put in", "left out"):
            for _ in range(40):
                p = words(size)
                pairs[len(rows)] = (kind, size)
                rows += [words(30) + p + words(30), words(30) + edited(p, kind) + words(30)]
    for f in range(6):
        p = words(80)
        for i in range(20):
            family[len(rows)] = f
            rows.append(words(20) + (p if i == 0 else edited(p, rng.choice(["changed", "put in", "left out"]))) + words(20))
    frame = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "row long, text string")
    got = {(r["a"], r["b"]) for r in passages.passage_links(frame).collect()}
    for kind in ("changed", "put in", "left out"):
        for size in (52, 55, 60, 100):
            mine = [i for i, k in pairs.items() if k == (kind, size)]
            assert sum((i, i + 1) in got for i in mine) >= 0.9 * len(mine), (kind, size)
    assert sum((i, i + 1) in got for i in pairs) >= 0.97 * len(pairs)
    owner = {i: i for i in family}
    for a, b in got:
        if a in owner and b in owner:
            owner = {k: owner[a] if v == owner[b] else v for k, v in owner.items()}
    assert all(len({owner[i] for i, g in family.items() if g == f}) == 1 for f in range(6))
    assert not any(a in pairs and b != a + 1 for a, b in got)


def _shared_words(texts, least):
    """Of each text, its runs of least words that an earlier text has too, and the texts that share any with another."""
    first, extra, sharing = {}, defaultdict(set), set()
    for doc, words in texts.items():
        for i in range(len(words) - least + 1):
            other = first.setdefault(tuple(words[i : i + least]), doc)
            if other != doc:
                extra[doc] |= set(range(i, i + least))
                sharing |= {doc, other}
    return extra, sharing


def _mixed_corpus(rng, n=300):
    """Texts with shared lines, shared passages, copies, texts with parts that recur, and hot passages."""
    words = _unlike(rng)
    lines, pool, common = [words(rng.randint(6, 14)) for _ in range(12)], [words(rng.randint(50, 120)) for _ in range(15)], words(60)
    out = {}
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            parts += rng.choice(lines) if kind < 0.4 else rng.choice(pool) if kind < 0.6 else words(rng.randint(5, 60))
        if i % 3 == 0:
            parts += common + words(20)
        out[i] = out[rng.randrange(i)] if i and rng.random() < 0.2 else parts
    return out


@pytest.mark.parametrize("large", [20_000, 3])
def test_exact_passages_equal_brute_force(spark, large):
    docs = _mixed_corpus(random.Random(11))
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "row long, text string").repartition(3)
    extra, sharing = _shared_words(docs, 50)
    links = passages.window_links(rows, large=large, most=200_000 if large > 3 else 50).collect()
    covered = defaultdict(set)
    for r in links:
        assert r["a"] < r["b"]
        covered[r["b"]] |= set(range(r["b_start"], r["b_end"] + 4))
        if r["similarity"] == 1:
            assert docs[r["a"]][r["a_start"] : r["a_end"] + 4] == docs[r["b"]][r["b_start"] : r["b_end"] + 4]
    assert {x for r in links for x in (r["a"], r["b"])} >= sharing
    assert all(extra[d] <= covered[d] for d in extra)


def test_cut_texts_hold_no_passage_twice(spark):
    docs = _mixed_corpus(random.Random(12))
    rows = spark.createDataFrame([(i, " ".join(w), len(" ".join(w))) for i, w in docs.items()], "doc_id long, text string, n_chars long").coalesce(1)
    got = {r["doc_id"]: r["text"].split() for r in passages.drop_repeats(rows).collect()}
    assert not _shared_words(got, 60)[1]  # where a cut joins two sides, 50 words may recur by chance of the same cut
    extra, _ = _shared_words(docs, 50)
    everything = {w for words in docs.values() for w in words}
    lost = everything - {w for words in got.values() for w in words}
    assert len(lost) < 0.005 * len(everything)  # only a changed word within a passage that is similar enough goes everywhere
    assert all(got[d] == docs[d] for d in docs if d not in extra and d in got and len(got[d]) == len(docs[d]))


def test_repeated_rows_are_cut_by_row(spark):
    words = _unlike(random.Random(13))
    passage, short, long = words(60), words(30), words(304)
    texts = [(7, passage + words(10)), (7, short), (7, long), (None, passage), (None, None), (7, long), (3, short + passage)]
    rows = spark.createDataFrame([(d, None if w is None else " ".join(w), "x", i) for i, (d, w) in enumerate(texts)], "doc_id long, text string, gone string, row int").coalesce(1)
    got = {r["row"]: r["text"] for r in passages.drop_repeats(rows).collect()}
    assert set(got) == {0, 1, 2, 4, 6} and got[4] is None
    assert (got[2].split(), got[6].split(), got[0].split()) == (long, short, texts[0][1])


def test_packing_reaches_the_bound(spark):
    rng = random.Random(6)
    sizes = [rng.randint(1, 900) for _ in range(5000)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "item long, size int")
    got = packing.pack(rows, 1000, shard_items=500).collect()
    assert len(got) == len(sizes) == len({r["item"] for r in got})
    fill = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += sizes[r["item"]]
    assert max(fill.values()) <= 1000
    assert len(fill) <= 1.02 * -(-sum(sizes) // 1000)


def test_evolution_beats_best_fit():
    sizes = [4] * 60 + [3] * 120  # sixty bins of 4 + 3 + 3; best fit in falling order pairs the fours
    alone = packing.GroupingGenetic(sizes, 10, seed=1).fitted([], list(range(180)))
    genetic = packing.GroupingGenetic(sizes, 10, seed=1)
    genetic.seed_people()
    seeds = len(genetic.people[0][1])
    found = genetic.evolve(400, 3)
    assert len(alone) == 70 and len(found) < seeds <= 70
    assert sorted(i for b in found for i in b) == list(range(180))
    assert all(sum(sizes[i] for i in b) <= 10 for b in found)


def test_evolution_runs_where_the_seeds_reach_the_bound(monkeypatch):
    born = []
    crossover = packing.GroupingGenetic.crossover
    monkeypatch.setattr(packing.GroupingGenetic, "crossover", lambda self, a, b: born.append(1) or crossover(self, a, b))
    genetic = packing.GroupingGenetic([1] * 100, 10, seed=1)
    genetic.seed_people()
    assert genetic.done() and len(genetic.evolve(12, 3)) == 10 and len(born) == 3


def test_pieces_equal_the_library(spark):
    import zlib

    tokenizers, data = pytest.importorskip("tokenizers"), "/root/testdata/sf0.001"
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 70_000), (-4, "ÉTÉ 'S <|endoftext|> Σ 日本語 a\x1cb. 12,5! don't"), (-5, "word " * 9000)], "doc_id long, text string")
    got = defaultdict(list)
    for r in packing.token_pieces(docs.unionAll(odd), bpe.default_vocabulary()).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for r in docs.unionAll(odd).collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        parts = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
        assert sorted(got[r["doc_id"]]) == [(k, 4096 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(parts)]


def test_topk_in_rounds(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(400, 8)).astype(np.float32)
    data[rng.random((400, 8)) < 0.7] = 0  # sparse: scattered postings
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(data)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.exact_topk(rows, rows.filter("vec_id % 50 = 0"), queries_per_round=3, block_rows=37, held_rows=90).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ints = np.floor(data.astype(np.float64) * 256).astype(np.int64)
    for q in range(0, 400, 50):
        scores = ints @ ints[q]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:5]
        assert got[q] == [(i, int(scores[i])) for i in order]
    huge = topk.accumulate(topk.quantised(__import__("pyarrow").array([[1e9, 3.0]]), 256.0), topk.quantised(__import__("pyarrow").array([[1e8, 1.0]]), 256.0))
    assert huge[0][0] == 256 * 10**9 * 256 * 10**8 + 768 * 256


def test_randomness_battery(spark):
    from graphloom.llm import secrets

    rng = random.Random(8)
    alnum, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    syllables = ["the", "and", "ing", "tion", "er", "on", "re", "st", "en", "ha", "ly", "ea"]
    ordinary = ["".join(rng.choice(syllables) for _ in range(rng.randint(8, 20))) for _ in range(3000)]
    ordinary += ["-".join(rng.choice(syllables) for _ in range(rng.randint(8, 14))) for _ in range(500)] + ["=" * 40, "a" * 64, "12345678901234567890123456", "abcdefghijklmnopqrstuvwxyz"]
    secret = ["".join(rng.choice(alnum) for _ in range(n)) for n in [24, 32, 40, 64, 100] * 20] + ["".join(rng.choice(hexa) for _ in range(n)) for n in [40, 64, 128] * 20]
    rows = spark.createDataFrame([(x,) for x in ordinary + secret if len(x) >= 20], "x string")
    found = {r["x"] for r in secrets.discoveries(rows).collect()}
    assert len(found & set(ordinary)) <= 2
    assert len(found & set(secret)) >= 0.9 * len(secret)


def _all_matches(near, rows):
    """Pairs of rows, by _matched() over every pair of spans."""
    a, b = np.triu_indices(len(near), 1)
    a, b = a[rows[a] != rows[b]], b[rows[a] != rows[b]]
    return {(x, y) for x, y in zip(*(c.tolist() for c in passages._matched(near, a, b, 46, 0.8)[:2]), strict=True)}


@pytest.mark.parametrize("size", [14, 90])
def test_spans_tied_to_others_meet(size):
    """in a group of many spans, those that are tied to one span are compared with all others too."""
    rng = np.random.default_rng(14)
    for _ in range(5):
        roots = rng.integers(1, 1 << 15, (3, 91)).astype(np.uint16)
        near = roots[rng.integers(0, 3, size)]
        for row in near:
            at = rng.integers(0, 86)
            row[at : at + 5] = rng.integers(1, 1 << 15, 5)  # a changed word
            row[: rng.integers(0, 30)] = row[rng.integers(62, 92) :] = 0
        near[:, 45] = 7
        a, b, *_ = passages._pairs(near, np.arange(size), np.array([0]), 46, 0.8)
        assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == _all_matches(near, np.arange(size))


def test_runs_with_changed_words_agree_in_a_stretch():
    """windows that share a run but no long one about the middle meet too."""
    rng, near = np.random.default_rng(15), []
    for _ in range(4000):  # a run of 46 places or more with a word or two changed, anywhere about the middle
        x = rng.integers(1, 1 << 15, 91).astype(np.uint16)
        y = rng.integers(1, 1 << 15, 91).astype(np.uint16)
        low, high = (rng.integers(0, 46), rng.integers(46, 92)) if rng.random() < 0.8 else (0, 91)
        y[low:high] = x[low:high]
        for at in rng.integers(36, 51, 1 + (high - low >= 90)) if rng.random() < 0.8 else rng.integers(0, 86, 2):
            if not at <= 45 < at + 5:
                y[at : at + 5] = rng.integers(1, 1 << 15, 5)
        near += [x, y]
    near, a = np.array(near), np.arange(0, 8000, 2)
    pair = passages._matched(near, a, a + 1, 46, 0.8)[0]
    agree = [(near[pair, 45 + p : 46 + q] == near[pair + 1, 45 + p : 46 + q]).all(axis=1) for p, q in passages._stretches(46)]
    assert len(pair) > 500 and np.logical_or.reduce(agree).all()
    assert not (agree[0] | agree[1]).all()  # the far stretches are needed


@pytest.mark.parametrize("most, large", [(200_000, 300), (20, 3)])
def test_row_passages_hold_all_that_rows_share(spark, most, large):
    """exact passages word for word against brute force, and families of near variants whole, also where keys are hot and dealt in parts."""
    rng = random.Random(16)
    docs = _mixed_corpus(rng, 200)
    words, changed = _unlike(rng), {}
    for f in range(4):
        p = words(70)
        for i in range(30):
            at = rng.randrange(12, 58)
            changed[len(docs)] = f
            docs[len(docs)] = words(20) + p[:at] + words(1) + p[at + 1 :] + words(20)
    p = words(60)
    docs[len(docs)] = p + words(30) + p[:30] + words(1) + p[31:]  # both in one row, one of them in the next row too
    docs[len(docs)] = words(9) + p + words(9)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "row long, text string").repartition(3)
    got = passages.row_passages(rows, most=most, large=large).collect()
    first, shared = {}, defaultdict(set)
    extra, sharing = _shared_words(docs, 50)
    for doc, w in docs.items():
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), set()).add((doc, i))
    for places in first.values():
        for doc, i in places if len({d for d, _ in places}) > 1 else ():
            shared[doc] |= set(range(i, i + 50))
    held, gone = defaultdict(set), defaultdict(set)
    for r in got:
        held[r["row"]] |= set(range(r["start"], r["end"]))
        gone[r["row"]] |= set(range(r["start"], r["end"])) if r["extra"] else set()
    assert all(shared[d] <= held[d] for d in shared) and all(extra[d] <= gone[d] for d in extra)
    links = {r["row"]: set(r["ties"]) for r in got if r["ties"]}
    owner = {r["row"]: r["row"] for r in got}
    for a, bs in links.items():
        for b in bs:
            owner = {k: owner[b] if v == owner[a] else v for k, v in owner.items()}
    for f in range(4):
        family = [d for d, g in changed.items() if g == f]
        assert len({owner[d] for d in family}) == 1
        assert all(len(held[d]) >= 68 for d in family)
        assert all(len(gone[d]) >= 68 for d in family[4:])
    last = len(docs) - 2
    assert set(range(90, 150)) - set(range(118, 125)) <= held[last]  # like the next row's, which is equal to the row's own other one


def test_shared_passages_have_classes(spark):
    words = _unlike(random.Random(17))
    p, q = words(60), words(60)
    texts = [(7, words(30)), (5, words(9) + p), (3, p + words(9) + q), (3, q + words(4)), (None, words(80)), (1, words(80))]
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in texts], "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["class_id"], r["extra"]) for r in passages.shared_passages(rows).collect()}
    assert got == {(5, 9, 69, 5, False), (3, 0, 60, 5, True), (3, 69, 129, 5, False), (3, 0, 60, 5, True)}
    assert passages.shared_passages(rows.limit(0)).count() == 0


def test_packing_keeps_few_chunks():
    """pipeline: what a worker keeps of chunks and words stays small beside an executor's memory."""
    held = bpe.LibraryBpe(bpe.default_vocabulary())
    for i in range(8):
        of = held.packed()
        for j in range(50_000):
            of[f"a{i}b{j}"]
    assert len(held._held) <= 200_000 and len(held._of_word) <= 200_000
    assert held.packed()["a1b2"] == bpe.LibraryBpe(bpe.default_vocabulary()).packed()["a1b2"]


def _slow_match(x, y, least, similarity):
    """Whether two spans share a passage, by every run and shift: words changed, or put in or left out at one place."""
    mid, share = len(x) // 2, 2 * similarity / (1 + similarity)
    same = (x == y) & (x > 0)

    def runs(equal):
        for low in range(mid + 1):
            for high in range(max(mid, low + least - 1), len(x)):
                if equal[low] and equal[high]:
                    yield low, high, int(equal[low : high + 1].sum())

    if any(n >= share * (high - low + 1) - 1e-9 for low, high, n in runs(same)):
        return True
    if not same[mid - 8 : mid + 9].all() or passages._equal_run(same[None])[1][0] - passages._equal_run(same[None])[0][0] + 1 < passages.AHEAD:
        return False
    for off in range(-passages.SHIFT, passages.SHIFT + 1):
        shifted = np.array([x[p] > 0 and 0 <= p + off < len(x) and x[p] == y[p + off] for p in range(len(x))])
        if off and (shifted & ~same).any():
            for low, high, n in runs(same | shifted):
                size = high - low + 1
                other = size + (0 if same[high] else off) - (0 if same[low] else off)
                if min(size, other) >= least and n >= share / 2 * (size + other) + 1e-6 and (same[low] or same[high]):
                    return True
    return False


def test_filters_before_shifts_lose_no_pair():
    """op3_substring_dedup: pairs that the cheap tests leave out share nothing by a plain search either."""
    rng, near = np.random.default_rng(19), []
    for _ in range(300):
        x = rng.integers(1, 1 << 15, 91).astype(np.uint16)
        x[: rng.integers(0, 25)] = x[rng.integers(70, 92) :] = 0
        at, by = int(rng.integers(54, 80)), int(rng.integers(-6, 7))
        y = np.concatenate([x[:at], rng.integers(1, 1 << 15, max(4, 4 + by)), x[at + max(4, 4 - by) :], rng.integers(1, 1 << 15, 91)])[:91].astype(np.uint16)
        cut = int(rng.integers(0, 40))
        y[:cut] = rng.integers(1, 1 << 15, cut)
        near += [x, y] if rng.random() < 0.5 else [x[::-1], y[::-1]]
    near, a = np.array(near), np.arange(0, 600, 2)
    got = set(passages._matched(near, a, a + 1, 46, 0.8)[0].tolist())
    want = {i for i in a.tolist() if _slow_match(near[i], near[i + 1], 46, 0.8)}
    assert 50 < len(want) < 250 and want <= got


def test_spans_with_lines_in_other_order_are_not_shifted(monkeypatch):
    """op3_substring_dedup: a shared line and other lines elsewhere are no passage, and don't reach the costly test of shifts."""
    rng, seen, moved = np.random.default_rng(20), [], passages._moved
    monkeypatch.setattr(passages, "_moved", lambda x, *rest: seen.append(x) or moved(x, *rest))
    lines = [rng.integers(1, 1 << 15, 12).astype(np.uint16) for _ in range(6)]
    near = rng.integers(1, 1 << 15, (60, 91)).astype(np.uint16)
    near[:, 35:55] = rng.integers(1, 1 << 15, 20)
    for row in near:
        for start, line in zip((0, 17, 60, 76), rng.permutation(6)[:4], strict=True):
            row[start : start + 12] = lines[line]
    near |= 1
    assert not len(passages._pairs(near, np.arange(60), np.array([0]), 46, 0.8)[0])
    assert not seen


def _alike_spans(rng, size):
    """Spans with a common beginning, often one word again and again, of any length; some are a near copy of an earlier one, with a word changed, put in or left out."""
    common, near = rng.integers(1, 1 << 15, 91).astype(np.uint16), []
    common[45 : 45 + rng.integers(1, 46)] = common[45]
    for i in range(size):
        row = rng.integers(1, 1 << 15, 91).astype(np.uint16)
        low, high = 45 - rng.integers(0, 20), 46 + int(rng.integers(0, 46))
        row[low:high] = common[low:high]
        if i and rng.random() < 0.3:
            row, at, by = near[int(rng.integers(0, i))].copy(), int(rng.integers(50, 88)), int(rng.integers(-6, 7))
            fresh = rng.integers(1, 1 << 15, max(4, 4 + by) if by else 5).astype(np.uint16)
            row = np.concatenate([row[:at], fresh, row[at + (max(4, 4 - by) if by else 5) :], rng.integers(1, 1 << 15, 12).astype(np.uint16)])[:91]
        row[45] = common[45]
        near.append(row)
    near = np.array(near)[:, :: rng.choice([-1, 1])].copy()
    for row in near:
        row[: rng.choice([0, rng.integers(0, 45), 45])] = 0
        first = int((row > 0).argmax())
        row[rng.integers(max(first + 46, 46), 92) :] = 0
    return near


@pytest.mark.parametrize("block", [1 << 13, 64])
def test_spans_meet_by_the_ends_of_their_passages(block, monkeypatch):
    """F1, op3_substring_dedup: sorting finds all pairs that looking at every pair finds."""
    rng, found = np.random.default_rng(21), 0
    whole = passages._candidates
    monkeypatch.setattr(passages, "_candidates", lambda *args: whole(*args, few=3, block=block))
    for _ in range(30):
        groups = [_alike_spans(rng, int(n)) for n in rng.integers(5, 90, 3)]
        near, starts = np.concatenate(groups), np.cumsum([0, *(len(g) for g in groups[:-1])])
        a, b, *_ = passages._pairs(near, np.arange(len(near)), starts, 46, 0.8)
        want = {(x + s, y + s) for g, s in zip(groups, starts.tolist(), strict=True) for x, y in _all_matches(g, np.arange(len(g)))}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
        pairs = np.concatenate([np.stack(c) for c in passages._candidates(near, starts, 46, 0.8)], axis=1)
        assert len(np.unique(pairs, axis=1).T) == len(pairs.T)  # each once
        found += len(want)
    assert found > 500


def test_spans_that_only_begin_alike_are_not_compared():
    """F1, op3_substring_dedup: of spans that begin alike and share no passage few pairs are looked at, however many they are."""
    rng = np.random.default_rng(22)
    near = rng.integers(1, 1 << 15, (3000, 91)).astype(np.uint16) | 1
    for row, n in zip(near, rng.integers(1, 40, 3000), strict=True):
        row[45 : 45 + n] = 7
    near[:, :45] = 0
    near[2000:2010, 45:] = near[1000:1010, 45:]
    met = [p for a, b in passages._candidates(near, np.array([0]), 46, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert {(i, i + 1000) for i in range(1000, 1010)} <= set(met) and len(met) < 3000 * 2999 / 2 / 50


def test_written_tables_leave_no_shuffle_files(spark):
    """pipeline, op3_substring_dedup: what a step shuffled doesn't stay on disk beside what it wrote."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    kept, path = common.materialise(spark.range(5000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert sorted(r["k"] for r in kept.collect()) == list(range(7))
    common.forget(spark, path)
