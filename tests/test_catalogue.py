"""Every query with SQL gives the SQL's rows on the smallest tables."""

import json
import os

import pandas as pd
import pytest

from graphloom.operators import community
from graphloom.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple("null" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, name):
    ours, theirs = catalogue.QUERIES[name](spark, DATA).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_the_rest_has_tests_of_its_own():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"louvain_partition", "louvain_modularity", "json_salvage", "hybrid_context", "baseline_context"}


def test_louvain_queries(spark):
    nodes, edges = catalogue._nodes(spark, DATA), catalogue._edges(spark, DATA)
    pairs = community.projection(nodes, edges)
    part = {r["node"]: r["community"] for r in catalogue.louvain_partition(spark, DATA).collect()}
    assert set(part) == {r["id"] for r in nodes.filter("label <> 'Chunk'").collect()}
    near, mass, links = {}, {}, [(r["a"], r["b"]) for r in pairs.collect()]
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    m = len(links)
    for n, others in near.items():
        mass[part[n]] = mass.get(part[n], 0) + len(others)
    for n, others in near.items():
        worth = {c: sum(part[o] == c for o in others) - len(others) * (mass[c] - (len(others) if c == part[n] else 0)) / (2 * m) for c in {part[n], *(part[o] for o in others)}}
        assert worth[part[n]] >= max(worth.values()) - 1e-6
    q = sum(sum(part[a] == part[b] == c for a, b in links) / m - (d / (2 * m)) ** 2 for c, d in mass.items())
    assert catalogue.louvain_modularity(spark, DATA).first()["q"] == pytest.approx(q, abs=2e-6)


def test_json_salvage(spark):
    props = {r["event_id"]: json.loads(r["props"]) for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "props").collect()}
    got = {r["event_id"]: json.loads(r["document"]) for r in catalogue.json_salvage(spark, DATA).collect()}
    assert set(got) == set(props)
    assert all(got[i] == {"relationships": [p]} for i, p in props.items())


def test_contexts(spark):
    asked = spark.read.parquet(f"{DATA}/nation.parquet").count()
    hybrid, plain = catalogue.hybrid_context(spark, DATA).collect(), catalogue.baseline_context(spark, DATA).collect()
    assert len(hybrid) == len(plain) == asked
    for r in hybrid:
        assert r["context"].startswith("=== GRAPH CONTEXT ===\n[")
        assert len(r["entities"]) == min(8, r["entities_found"]) > 0
        lines = r["context"].split("\n")
        graph = lines[1 : next(i for i, x in enumerate(lines) if x.startswith("=== REL") or x.startswith("... (graph"))]
        assert [x.split("] ")[1].split(":")[0] for x in graph if x][: len(r["entities"])] == r["entities"][: len(graph)]
    for r in plain:
        assert (r["entities"], r["entities_found"]) == ([], 0)
        assert "=== GRAPH CONTEXT ===" not in r["context"]
        assert len(r["contexts"]) <= 5
        assert r["context"].count("score:") >= min(1, len(r["contexts"]))
