"""Change points, the Merkle manifest and WARC archives: brute force, round trips, odd rows."""

import gzip
import hashlib
import math
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import changepoints, manifest, warc

# -- change points


def plain(values, least, penalty):
    """All cuts weighed one by one: (cost, segments, starts from the last backwards)."""
    n = len(values)
    sums, squares = [0], [0]
    for x in values:
        sums.append(sums[-1] + x)
        squares.append(squares[-1] + x * x)

    def cost(a, b):
        k, s, q = b - a, sums[b] - sums[a], squares[b] - squares[a]
        return k * math.floor(1000 * math.log(1 + (k * q - s * s) // (k * k)))

    if n < least:
        return cost(0, n), 1, (0,)
    best = {0: (0, 0, ())}
    for end in range(least, n + 1):
        found = []
        for start in [0, *range(least, end - least + 1)]:
            if end - start >= least and start in best:
                c, k, starts = best[start]
                found.append((c + cost(start, end) + penalty * (start > 0), k + 1, (start, *starts)))
        best[end] = min(found)
    return best[n]


@pytest.mark.parametrize("least", [1, 2, 5, 14])
def test_series_equal_brute_force(least):
    rng = random.Random(least)
    for penalty in (0, 300, 40_000):
        for n in (1, least, least + 1, 2 * least, 3 * least + 1, 47):
            for kind in range(3):
                level = [rng.choice([0, 3, 50, 4000]) for _ in range(n)] if kind == 0 else [rng.randint(0, 3) for _ in range(n)] if kind == 1 else [7] * n
                values = [x + (100 if i > n // 2 else 0) for i, x in enumerate(level)]
                series = changepoints.Series(least, penalty)
                for i, x in enumerate(values):
                    series.add(i, x)
                got = series.segments()
                best, count, starts = plain(values, least, penalty)
                assert (got[0][7], got[0][6]) == (best, count)
                assert tuple(x[1] for x in reversed(got)) == starts
                assert sum(x[3] for x in got) == sum(values)


def test_series_of_large_numbers_stays_exact():
    rng = random.Random(3)
    values = [rng.randint(-(10**14), 10**14) for _ in range(60)]
    series = changepoints.Series(14, 40_000)
    for i, x in enumerate(values):
        series.add(i, x)
    got = series.segments()
    assert (got[0][7], tuple(x[1] for x in reversed(got))) == (plain(values, 14, 40_000)[0], plain(values, 14, 40_000)[2])


def test_log_steps_near_whole_numbers():
    v = np.arange(1, 200_000)
    assert changepoints.log_steps(v).tolist() == [math.floor(1000 * math.log(x)) for x in v.tolist()]


def test_change_points_of_odd_rows(spark):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d, hours=5)
    rows = [(1, day(0), 5), (1, day(0), 5), (1, day(3), 2), (2, None, 4), (3, day(1), None), (None, day(2), 9), (None, day(40), 9), (4, day(7), -3)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vendor_id long, shipped_at timestamp, quantity int, key string, total int")
    got = {(r["vendor_id"], r["segment_no"]): r for r in changepoints.change_points(frame).collect()}
    first = (datetime(2024, 1, 1) - datetime(1970, 1, 1)).days
    assert {k for k, _ in got} == {1, None, 4}
    assert (got[1, 1]["first_day"], got[1, 1]["n_days"], got[1, 1]["total"]) == (first, 4, 12)
    assert sum(r["n_days"] for (k, _), r in got.items() if k is None) == 39
    assert (got[4, 1]["n_days"], got[4, 1]["total"], got[4, 1]["spread"], got[4, 1]["cost"]) == (1, -3, 1, 0)
    assert changepoints.change_points(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        changepoints.change_points(frame.withColumn("quantity", F.col("quantity").cast("double")))


def test_change_points_of_many_keys_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(v, datetime(2024, 1, 1) + timedelta(days=d), rng.randint(0, 9) + 90 * (v % 3 == 1 and d > 60)) for v in range(12) for d in range(100) for _ in range(rng.randint(0, 3))]
    got = {}
    for r in changepoints.change_points(spark.createDataFrame(rows, "vendor_id long, shipped_at timestamp, quantity int").repartition(7)).collect():
        got.setdefault(r["vendor_id"], []).append(r)
    for v in range(12):
        days = {}
        for w, t, q in rows:
            if w == v:
                days[t] = days.get(t, 0) + q
        span = (max(days) - min(days)).days + 1
        best, count, starts = plain([days.get(min(days) + timedelta(days=i), 0) for i in range(span)], 14, 40_000)
        mine = sorted(got[v], key=lambda r: r["segment_no"])
        assert (mine[0]["best_cost"], mine[0]["n_segments"]) == (best, count)
        assert tuple(r["first_day"] - mine[0]["first_day"] for r in reversed(mine)) == starts


# -- the manifest


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def manifest_of(rows, fanout, changed):
    """{row: (leaf, subroot, root, proof, folded, verified)} in plain Python; rows: (id, group, text)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest("".join(map(part, r)))
    order = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (order(r[0]), leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], fanout)
    top, out = tree([trees[g][-1][0] for g in names], fanout), []
    for g in names:
        for i, r in enumerate(groups[g]):
            cur, beside = leaf(changed(r)), ""
            for levels, at in ((trees[g], i), (top, names.index(g))):
                for level in levels[:-1]:
                    low = at // fanout * fanout
                    before, after = "".join(level[low:at]), "".join(level[at + 1 : low + fanout])
                    beside, cur, at = beside + before + after, digest(before + cur + after), at // fanout
            out.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], digest(beside), cur, cur == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "levels"), [(8, 4), (2, 2), (8, 1)])
@pytest.mark.parametrize("n", [0, 1, 2, 9, 65, 140])
def test_manifest_equals_brute_force(spark, fanout, levels, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "", "de", "é", "zh"]) if n > 2 else "de", rng.choice([None, "", "AbÉ", "long " * 3000, f"t{i}"])) for i in range(n)]
    rows += rows[: n // 4]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, lang string, text string, leaf string, n long")
    got = manifest.merkle_manifest(frame, ["doc_id", "lang", "text"], "doc_id", "lang", {"text": F.lower("text")}, F.col("doc_id") % 2 == 0, fanout, levels).collect()
    expected = manifest_of(rows, fanout, lambda r: (r[0], r[1], r[2].lower()) if r[0] is not None and r[0] % 2 == 0 and r[2] is not None else r)
    assert sorted(map(tuple, got), key=str) == expected


def test_manifest_of_blocks_of_one_group(spark):
    rows = [(i, "en", f"T{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    got = manifest.merkle_manifest(frame, ["doc_id", "lang", "text"], "doc_id", "lang", {"text": F.lower("text")}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, 8, 2)
    expected = manifest_of(rows, 8, lambda r: (r[0], r[1], r[2].lower()) if zlib.crc32(str(r[0]).encode()) % 3 == 0 else r)
    assert sorted(map(tuple, got.collect()), key=str) == expected


# -- archives

PAGES = "page_id long, url string, html string, digest string, offset long, payload binary"


@pytest.fixture
def pages(spark):
    long, other = "<p>äöü</p>" * 30, "y" * 99
    rows = [(5, "http://a/5", long), (3, "http://a/3", long), (9, "http://a/9\r\nWARC-Type: revisit", long), (1, None, other), (2, "http://b", other), (4, "u", None), (6, "u", ""), (7, "u", "z" * 100), (7, "u", "z" * 100), (7, "t", "z" * 100), (None, "n", long), (8, "v", "x" * 300_000), (10, "é", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    return spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES).repartition(3)


def test_archives_round_trip(spark, pages, tmp_path):
    index = warc.write_archives(pages, f"file://{tmp_path}/a", roll=2_000)
    kept = warc.read_records(index, f"file://{tmp_path}/a")
    back = warc.resolved(kept).collect()
    given = pages.collect()
    assert sorted((str(r["page_id"]), (r["html"] or "").encode()) for r in given) == sorted((str(r["page"] and int(r["page"])), bytes(r["payload"])) for r in back)
    assert all(r["intact"] and r["payload_bytes"] == len(r["payload"]) and r["digest"] == hashlib.sha256(r["payload"]).hexdigest() for r in back)
    assert sorted((r["page"], r["refers_page"]) for r in back if r["record_type"] == "revisit" and r["page"]) == [("5", "3"), ("7", "7"), ("7", "7"), ("9", "3")]
    assert [r["refers_page"] for r in back if r["page"] is None] == ["3"]
    assert next(r["url"] for r in back if r["page"] == "7" and r["record_type"] == "response") == "t"
    assert kept.filter("record_type = 'revisit' and payload is not null").count() == 0
    assert {r["url"] for r in back if r["page"] == "9"} == {"http://a/9%0D%0AWARC-Type: revisit"}
    assert warc.orphans(spark, f"file://{tmp_path}/a").count() == 0
    assert not (tmp_path / "a" / "spool").exists()


def test_archives_are_plain_warc(spark, pages, tmp_path):
    index = warc.write_archives(pages, str(tmp_path / "b"))
    files = list((tmp_path / "b" / "data").glob("*.warc.gz"))
    records = sum(gzip.decompress(f.read_bytes()).count(b"\r\nWARC-Record-ID: ") for f in files)
    assert records == len(files) + pages.count()
    for r in index.collect():
        member = (tmp_path / "b" / "data" / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert f"WARC-Record-ID: <{r['record_id']}>".encode() in gzip.decompress(member)
    (tmp_path / "b" / "data" / "pages-lost.warc.gz").write_bytes(b"half a rec")
    assert [r["file"] for r in warc.orphans(spark, str(tmp_path / "b")).collect()] == ["pages-lost.warc.gz"]


def test_selected_records_come_by_coalesced_ranges(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"u{i}", f"{i} " * 200) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(frame, str(tmp_path / "c"))
    some = index.filter(F.col("page").cast("int") % 10 == 3)
    assert sorted(int(r["page"]) for r in warc.read_records(some, str(tmp_path / "c")).collect()) == list(range(3, 200, 10))
    rows = [r.asDict() for r in index.orderBy("file", "offset").collect()]
    import pyarrow as pa

    runs = lambda gap, most, rows=rows: [(a, b, len(x)) for _, a, b, x in warc._ranges(iter([pa.RecordBatch.from_pylist(rows)]), gap, most)]
    assert len(runs(0, 1 << 30)) == 1
    assert len(runs(0, 1)) == 200
    apart = rows[::2]
    assert len(runs(0, 1 << 30, apart)) == 100
    assert len(runs(1 << 16, 1 << 30, apart)) == 1
    with pytest.raises(Exception, match="no WARC record|incorrect|Error"):
        warc.read_records(index.withColumn("offset", F.col("offset") + 7), str(tmp_path / "c")).count()


def test_no_pages(spark, pages, tmp_path):
    index = warc.write_archives(pages.limit(0), str(tmp_path / "d"))
    assert index.count() == 0
    assert warc.read_records(index, str(tmp_path / "d")).count() == 0


def test_copies_of_a_hot_payload(spark, tmp_path):
    frame = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("h" * 200)).otherwise(F.concat(F.lit("k" * 200), (F.col("id") % 20).cast("string"))).alias("html"))
    spool = spark.createDataFrame([(f"f{i}", i, 1, f"r{i}", "response", "u", "hot" if i % 3 == 0 else f"d{i % 20}", 200, str(i), None) for i in range(60)], warc.INDEX)
    for hot in (5, 50_000):
        got = {r["record_id"]: r["original"] for r in warc.originals(spool.withColumn("_order", F.col("page").cast("long")), 100, "_order", hot=hot).collect()}
        assert all(got[f"r{i}"] == (None if i == 0 else "r0") for i in range(0, 60, 3))
        assert len(got) == 60
    assert warc.write_archives(frame, str(tmp_path / "e")).filter("record_type = 'response'").count() == 1 + len({i % 20 for i in range(60) if i % 3})


def test_unchanged_rows_are_folded_from_their_leaves():
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = [digest(str(i)) for i in range(3)]
    held = pa.table({"id": [0, 1, 2], "pos": [0, 1, 2], "n": [3] * 3, "leaf": [bytes.fromhex(x) for x in leaves], "other": pa.nulls(3, pa.binary())})
    root = digest("".join(leaves))
    for named, verified in ((root, True), (digest("another root"), False)):
        outer = pa.table({"subroot": [root], "root": [named], "ways": pa.array([[]], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))})
        got = manifest._block_proofs(8, 4)((), held, outer)
        assert got.column("folded_root").to_pylist() == [root] * 3
        assert got.column("verified").to_pylist() == [verified] * 3
