"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns: a defined result each."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, hosts, lines, packing, passages, quality, secrets, simhash, topk, toxicity
from graphloom.llm.common import fold


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 1), (6, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def by_id(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_quality(odd, empty, labels):
    model = quality.train(odd, labels, fold(F.col("doc_id"), 5) != 0)
    got = by_id(quality.score_quality(odd, model))
    assert {k: len(v) for k, v in got.items()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 1}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for v in got.values() for r in v)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in got.items() if k is not None for r in v)
    assert quality.score_quality(empty, model).count() == 0
    assert quality.train(empty, labels, F.lit(True)).margin(*quality.features(np.zeros(0, np.uint8), np.array([0, 0]), np.zeros(1)), 1).shape == (1,)


def test_toxicity(odd, empty, labels):
    model = toxicity.train(odd, labels, fold(F.col("doc_id"), 4) != 2)
    got = by_id(toxicity.score_toxicity(odd, model))
    assert sum(map(len, got.values())) == 8
    assert all(0 <= r["score"] <= 1 for v in got.values() for r in v)
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.drop_toxic(odd, model, 2.0).columns == odd.columns
    assert toxicity.drop_toxic(odd, model, 2.0).count() == 8


def test_bpe(odd, empty):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_vocabulary())
    rows = {r["doc_id"]: r for r in bpe.round_trip_digests(odd, bpe.default_vocabulary()).collect()}
    import hashlib

    for doc, text in {(r["doc_id"], r["text"]) for r in odd.collect()}:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[doc]["n_tokens"] == len(ids)
        assert rows[doc]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(empty, bpe.default_vocabulary()).count() == 0
    back = bpe.decoded(bpe.encoded(odd.select("doc_id", "text"), bpe.default_vocabulary()), bpe.default_vocabulary(), into="out").collect()
    assert all(r["out"] == library.decode(r["ids"], skip_special_tokens=False) for r in back)


def test_passages(spark, odd, empty):
    assert passages.repeated_passages(odd).count() == 0  # the repeated row is too short
    assert passages.repeated_passages(empty).count() == 0
    assert passages.drop_repeats(odd).columns == odd.columns
    assert passages.drop_repeats(odd).count() == 8


def test_simhash(odd, empty):
    got = by_id(simhash.near_duplicates(odd))
    assert len(got[1]) == 2 and {r["component_id"] for r in got[1]} == {1}
    assert {got[k][0]["fingerprint"] for k in (2, 3, 4)} == {"0" * 16}
    assert {got[k][0]["component_id"] for k in (2, 3, 4)} == {2}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5", "6", "None"]  # one row a component
    assert simhash.first_of_each(empty).count() == 0
    hot = by_id(simhash.near_duplicates(odd, hot=1))
    assert {k: [tuple(r) for r in v] for k, v in hot.items()} == {k: [tuple(r) for r in v] for k, v in got.items()}


def test_simhash_keeps_unlike_rows_of_one_number(spark):
    import random

    words = lambda k: " ".join(str(random.Random(k).random()) for k in range(k, k + 200))
    rows = spark.createDataFrame([(1, words(0)), (2, words(0)), (2, words(1000)), (None, words(1000)), (None, words(5000)), (None, words(5000))], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.first_of_each(rows).collect())
    assert got == sorted([("1", words(0)), ("2", words(1000)), ("None", words(5000))])


def test_lines(odd, empty):
    got = by_id(lines.line_rules(odd))
    assert (got[1][0]["n_words"], got[1][0]["kept"]) == (12, True)
    assert all(got[k][0]["n_words"] == 0 and got[k][0]["base_failed"] and not got[k][0]["kept"] for k in (2, 3, 4))
    assert got[5][0]["n_words"] == 30_000
    assert lines.line_rules(empty).count() == 0


def test_common_lines_of_small_and_large_hosts(spark):
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(14))
    rows = [(i, f"{own(i)}\nShare  this PAGE", "small") for i in range(20)] + [(100 + i, f"{own(100 + i)}\nshare this page" if i < 3 else own(100 + i), "large") for i in range(400)]
    rows += [(600 + i, "these ten words or so stand on each page of it\n" + " ".join(own(600 + i).split()[:4]), "bare") for i in range(30)]
    got = {r["doc_id"]: r for r in lines.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["removed_words"] == 3 and got[i]["kept"] for i in range(20))  # a host of under 100 documents
    assert all(got[100 + i]["removed_words"] == 0 for i in range(400))  # three of 400 are too few
    assert all(got[600 + i]["removed_words"] == 11 and not got[600 + i]["base_failed"] and not got[600 + i]["kept"] for i in range(30))  # depleted


def test_reputation_blocks_hosts_of_a_bad_trade(spark):
    urls = [f"https://good{i % 8}.example.com/en/{i}" for i in range(400)] + [f"https://m.casino-win.example.com/en/{i}" for i in range(30)] + ["https://good1.example.com/en/casino/1", "https://new.example.com/", "https://poker.example.org/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in hosts.judge_urls(pages, hosts.url_outcomes(pages)).collect()}
    assert {got[i] for i in range(400, 430)} == {"block"}
    assert {got[i] for i in range(400)} | {got[430], got[431]} == {"allow"}


def test_hosts(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.net/en/x?q#f", None), (2, None, None), (None, "no scheme", None), (3, "https://b.net", None), (3, "https://b.net", None), (4, "x://u@h.co.uk:80/fr/", None), (5, "http://c.org/fr/a", None), (6, "http://xnet/", None)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(1, 0), (6, 1), (None, 1), (3, None)], "page_id long, bad int")
    got = {}
    for r in hosts.judge_urls(pages, outcomes).collect():
        got.setdefault(r["page_id"], []).append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[1] == [("a.example.net", "/en/x", "example.net/en/", "allow")]
    assert got[2][0][:3] == ("", "", None) == got[None][0][:3]
    assert len(got[3]) == 2 and got[3][0][:3] == ("b.net", "", None)
    assert got[4][0][:3] == ("u@h.co.uk:80", "/fr/", None)
    assert got[5][0] == ("c.org", "/fr/a", "org/fr/", "allow")
    assert got[6][0][:3] == ("xnet", "/", None)
    assert hosts.judge_urls(pages.limit(0), outcomes).count() == 0
    named = {r["h"]: (r["d"], r["s"]) for r in spark.createDataFrame([("u@h.co.uk:80",), ("a.b.example.com",), ("localhost",), ("10.0.0.1",), ("",)], "h string").select("h", hosts.domain_and_suffix(F.col("h"))[0].alias("d"), hosts.domain_and_suffix(F.col("h"))[1].alias("s")).collect()}
    assert named == {"u@h.co.uk:80": ("h.co.uk", "co.uk"), "a.b.example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "": ("", "")}


def test_packing(odd, empty):
    got = packing.pack_documents(odd, bpe.default_vocabulary()).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, None}
    assert sum(r["doc_id"] == 1 for r in got) == 2
    assert [r["length"] for r in got if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for runs in places.values():
        end = 0
        for offset, length in sorted(runs):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack_documents(empty, bpe.default_vocabulary()).count() == 0


def test_secrets(spark, odd, empty):
    assert all(r["spans"] == "" for r in secrets.find_secrets(odd).collect() if r["doc_id"] != 5)
    assert secrets.find_secrets(empty).count() == 0
    texts = ["x password = 'abcdefgh12' y", "password: secret: abcdefgh123", "AKIA0123456789AB and é " + "0a" * 16, "token=short API_KEY:longenough1 akia"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.find_secrets(rows).collect()}
    want = {}
    for doc, text in enumerate(texts):
        spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        want[doc] = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    assert {k: v["spans"] for k, v in got.items()} == want
    assert [r["text"] for r in secrets.redact(rows).orderBy("doc_id").collect()][0] == "x [SECRET]' y"
    assert secrets.redact(odd).columns == odd.columns


def test_topk(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 1), (50, None, 1), (100, [1.0, None], 1), (1, [0.5, 0.5], 1), (2, [0.5, float("nan")], 1), (3, [0.5, -3.0], 1), (4, [0.5], 1), (None, [9.0, 9.0], 1), (5, [], 1), (0, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, query_id int")
    got = [tuple(r) for r in topk.exact_topk(rows, rows.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 256 * 128), (0, 2, 3, 256 * 128), (0, 3, 4, 256 * 128), (0, 4, 5, 0)]
    assert topk.exact_topk(rows.limit(0), rows.limit(0)).count() == 0
    large = spark.createDataFrame([(0, [1e15, 0.0]), (1, [1e15, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.exact_topk(large, large).count()
