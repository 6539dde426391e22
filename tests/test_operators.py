import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import jsons
from graphloom.operators import chunking, community, encoding, extraction, graph, ranking, reports, resolution, retrieval, search, sections, store
from graphloom.sources import documents, tables
from graphloom.sources.versions import VersionedTables
from graphloom.streaming import progress


@pytest.mark.parametrize(("n", "sizes"), [(512, [512, 100]), (480, [480]), (79, []), (0, []), (925, [512, 512, 101])])
def test_chunk_windows(spark, n, sizes):
    rows = spark.createDataFrame([("SEC-0001", " ".join(f"w{i}" for i in range(n)))], "section_id string, text string")
    got = chunking.chunk_windows(rows).orderBy("chunk_seq").collect()
    assert [r["word_count"] for r in got] == sizes
    assert [r["chunk_id"] for r in got] == [f"SEC-0001-C{i + 1:03d}" for i in range(len(sizes))]


def test_pages_to_sections(spark):
    sections = spark.createDataFrame([(0, 1, 0, 5), (1, 2, 1, 3), (2, 2, 2, 4)], "idx int, level int, page_start int, page_end int")
    pages = spark.createDataFrame([(2,), (0,), (9,)], "page_idx int")
    assert {r["page_idx"]: r["section_idx"] for r in chunking.pages_to_sections(pages, sections).collect()} == {2: 1, 0: 0, 9: 0}


def test_toc_ends_at_any_level(spark):
    toc = spark.createDataFrame([(0, 11, 1), (1, 11, 5), (2, 0, 9), (3, 11, 20)], "idx int, level int, page_1 long")
    got = {r["idx"]: (r["id"], r["page_start"], r["page_end"]) for r in chunking.toc_ends(toc, 99).collect()}
    assert got == {0: ("SEC-0001", 0, 3), 1: ("SEC-0002", 4, 7), 2: ("SEC-0003", 8, 99), 3: ("SEC-0004", 19, 99)}
    assert chunking.toc_ends(toc.limit(0), 99).count() == 0


def test_adjacency_crosses_sections(spark):
    rows = spark.createDataFrame([(i, f"c{i:03d}", i // 7) for i in range(100)], "global_seq long, chunk_id string, s int").repartition(5)
    got = sorted((r["src"], r["dst"]) for r in chunking.adjacent(rows, "global_seq").collect())
    assert got == [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(99)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"relationships":[{"from":"a","to":"b"}],"entities":[{"id":"x"},{"id":', {"relationships": [{"from": "a", "to": "b"}]}),
        ('```json\n{"a": [1, "}]"]}\n```', {"a": [1, "}]"]}),
        ('{"a": ["x\\"]}", "y"], "b": {"c": 1}, "d', {"a": ['x"]}', "y"], "b": {"c": 1}}),
        ('{"a', None),
        ("no object", None),
        (None, None),
    ],
)
def test_salvage(raw, want):
    got = jsons.salvaged(raw)
    assert (None if got is None else json.loads(got)) == want


def test_judges_that_fail_score_nothing(spark):
    rows = spark.createDataFrame([(1, "q", "a", ["c"]), (2, "q", "", [])], "id int, query string, answer string, contexts array<string>")
    got = {r["id"]: r["faithfulness"] for r in reports.judged(rows, {"faithfulness": lambda q, a, c: 1.0 / len(c)}).collect()}
    assert got == {1: 1.0, 2: None}
    plain = {r["id"]: (r["faithfulness"], r["context_precision"]) for r in reports.judged(rows).collect()}
    assert plain == {1: (0.0, 0.0), 2: (None, None)}


def _corpus(spark):
    chunks = spark.createDataFrame([("c1", "s1", "One", "71", 1, "oil filter", 0), ("c2", "s1", "Other", "72", 2, "", 1), ("c3", None, None, None, None, "t", 2)], "chunk_id string, section_id string, section_title string, ata string, level int, text string, global_seq long")
    things = spark.createDataFrame([("E1", "Tool", "Wrench", "71", "c1,zz", None, 0), (" E1 ", "Tool", "Spanner", None, "c1", "for filters", 1), ("", "Tool", "none", "71", "c1", None, 2), ("E2", "Gadget", None, "", None, None, 3)], "id string, type string, name string, ata string, source_chunks string, description string, ord int")
    rels = spark.createDataFrame([("E1", "c2", "used-in"), (" E1", "c2", "USED IN"), ("E1", "nowhere", "USED_IN"), ("E2", "E1", None)], "source string, target string, type string")
    vectors = spark.createDataFrame([("c1", [1.0]), ("c1", [2.0])], "id string, embedding array<float>")
    return chunks, things, rels, vectors


def test_built_graph_keeps_all_properties_and_the_last_value(spark):
    nodes, edges = sections.build_graph(*_corpus(spark))
    got = {(r["label"], r["id"]): r for r in nodes.collect()}
    assert set(got) == {("Chunk", "c1"), ("Chunk", "c2"), ("Chunk", "c3"), ("DocumentSection", "s1"), ("Tool", "E1"), ("Entity", "E2")}
    assert (got["Tool", "E1"]["name"], got["Tool", "E1"]["ata"], got["Tool", "E1"]["description"], got["Tool", "E1"]["source_chunks"]) == ("Spanner", "71", "for filters", "c1")
    assert (got["Chunk", "c1"]["text"], got["Chunk", "c2"]["text"], got["Chunk", "c1"]["section_id"], got["DocumentSection", "s1"]["title"]) == ("oil filter", None, "s1", "One")
    assert got["Chunk", "c1"]["embedding"] is not None
    assert got["Chunk", "c2"]["embedding"] is None
    assert {(r["src"], r["type"], r["dst"]) for r in edges.collect()} == {("c1", "ADJACENT_TO", "c2"), ("c2", "ADJACENT_TO", "c3"), ("c1", "PART_OF_SECTION", "s1"), ("c2", "PART_OF_SECTION", "s1"), ("c1", "CONTAINS", "E1"), ("E1", "USED_IN", "c2"), ("E2", "CONNECTED_TO", "E1")}


def test_stored_graph_changes_bucket_by_bucket(spark, tmp_path):
    chunks, things, rels, vectors = _corpus(spark)
    nodes, edges = sections.build_graph(chunks, things, rels, vectors)
    path = str(tmp_path / "g")
    store.store_graph(nodes, edges, path, buckets=8)
    first = VersionedTables(spark, path).snapshot()
    assert store.store_graph(nodes, edges.repartition(3), path) == {"nodes": [], "edges": []}
    assert VersionedTables(spark, path).versions() == [1]
    changed = nodes.withColumn("name", F.when(F.col("id") == "E1", "Driver").otherwise(F.col("name")))
    touched = store.store_graph(changed, edges, path)
    second = VersionedTables(spark, path).snapshot()
    assert (len(touched["nodes"]), touched["edges"]) == (1, [])
    assert {b for b, v in second.tables["nodes"].items() if v != first.tables["nodes"].get(b)} == {str(touched["nodes"][0])}
    assert second.tables["edges"] == first.tables["edges"]
    assert [r["name"] for r in store.nodes_by_id(spark, path, ["E1"]).collect()] == ["Driver"]
    assert store.open_graph(spark, path, 1)[0].filter("id = 'E1'").first()["name"] == "Spanner"
    # nodes are written, then edges fail: readers keep the version before
    boom = F.udf(lambda s: 1 // 0 and s, "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        store.store_graph(nodes, edges.withColumn("dst", boom("dst")), path)
    assert [r["name"] for r in store.nodes_by_id(spark, path, ["E1"]).collect()] == ["Driver"]
    more = spark.createDataFrame([("Tool", "E1", None, "x", 0), ("Tool", "E9", "Nine", None, 1)], "label string, id string, name string, maker string, ord long")
    ways = spark.createDataFrame([("E9", "E1", "PART_OF"), ("E9", "gone", "PART_OF")], "src string, dst string, type string")
    store.upsert_graph(path, more, ways)
    now, links = store.open_graph(spark, path)
    assert {(r["id"], r["name"], r["maker"]) for r in now.filter("label = 'Tool'").collect()} == {("E1", "Driver", "x"), ("E9", "Nine", None)}
    assert links.count() == edges.count() + 1
    assert store.upsert_graph(path, more.limit(0).select("label", "id", "name", "ord"), ways.limit(0)) == {"nodes": [], "edges": []}


def test_clean_properties(spark):
    rows = spark.createDataFrame([("", ["a", None], [(1, "x")], {"k": "v"}, 0)], "s string, l array<string>, d array<struct<a:int,b:string>>, m map<string,string>, n int")
    got = graph.clean_properties(rows).first()
    assert tuple(got) == (None, ["a", ""], ['{"a":1,"b":"x"}'], '{"k":"v"}', 0)


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ranking.numbered(rows, "k", into="n").collect()
    assert all(r["k"] == r["n"] for r in got)


def test_resolution(spark):
    entities = spark.createDataFrame([("A", "Component", "Oil Filter", "", "c1", 0), ("B", "Component", "oil-filter", "x", "c2", 1), ("", "Component", "no id", "y", "c3", 2), ("C", None, None, None, "c1", 3)], "id string, type string, name string, description string, chunk string, ord int")
    got = {r["id"]: r for r in resolution.resolve_entities(entities, ["description"]).collect()}
    assert set(got) == {"A", "C"}
    assert (got["A"]["description"], got["A"]["source_chunks"]) == ("x", "c1,c2")
    rels = spark.createDataFrame([("A", "", "", "Oil Filter", None, 0), ("A", "", "B", "", "x", 1), ("", "", "A", "", "x", 2)], "from string, source string, to string, target string, type string, ord int")
    resolved = resolution.resolve_entities(entities, ["description"])
    assert [tuple(r)[:3] for r in resolution.resolve_relationships(rels, resolved).collect()] == [("A", "A", "CONNECTED_TO")]
    aliases = spark.createDataFrame([("B", "A")], "alias string, id string")
    assert {r["type"] for r in resolution.resolve_relationships(rels, resolved, aliases).collect()} == {"CONNECTED_TO", "X"}


def test_trails_use_no_edge_twice(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y"), ("b", "c", "x")], "src string, dst string, type string")
    roots = spark.createDataFrame([("a",)], "root string")
    ends = [r["node"] for r in graph.trails(roots, edges).collect()]
    assert sorted(ends) == ["a", "a", "b", "b", "c", "c"]  # back to the root by the parallel edge
    nodes = spark.createDataFrame([("a", "X"), ("b", "Chunk"), ("c", "X")], "id string, label string")
    assert {r["node"] for r in graph.neighbourhood(roots, nodes, edges).collect()} == {"a", "c"}
    alone = spark.createDataFrame([("z",)], "root string")
    assert [tuple(r) for r in graph.neighbourhood(alone, nodes, edges).collect()] == [("z", None)]


def test_upserts(spark):
    old = spark.createDataFrame([("X", "1", "a", "b")], "label string, id string, p string, q string")
    new = spark.createDataFrame([("X", "1", "c", None, 0), ("X", "2", "d", "e", 1)], "label string, id string, p string, q string, ord int")
    assert sorted(tuple(r) for r in graph.upsert_nodes(old, new).collect()) == [("X", "1", "c", "b"), ("X", "2", "d", "e")]


def test_budget(spark):
    rows = spark.createDataFrame([(1, s, i, "x" * 40) for s in range(3) for i in range(50)], "query_id int, section int, place int, line string")
    got = retrieval.within_budget(rows, 1000)
    lines = {}
    for r in got.collect():
        lines.setdefault(r["section"], []).append((r["place"], r["line"]))
    text = []
    for s, (share, head, mark) in enumerate(((0.45, "=== GRAPH CONTEXT ===", "... (graph trimmed)"), (0.6, "\n=== RELATIONSHIPS ===", "... (rels trimmed)"), (1.0, "\n=== MANUAL TEXT ===", "... (text trimmed)"))):
        text.append(head)
        for _ in range(50):
            text.append("x" * 40)
            if sum(map(len, text)) > 1000 * share:
                text.append(mark)
                break
        assert len(lines[s]) >= 2
    assert retrieval.context_text(got).first()["context"] == "\n".join(text)


def test_louvain(spark):
    clique = lambda xs: [(a, b) for i, a in enumerate(xs) for b in xs[i + 1 :]]
    pairs = spark.createDataFrame(clique("abcd") + clique("efgh") + [("d", "e")], "a string, b string")
    found = {r["node"]: r["community"] for r in community.louvain(pairs).collect()}
    assert set(found) == set("abcdefgh")
    alone = spark.createDataFrame([(c, c) for c in "abcdefgh"], "node string, community string")
    q = community.modularity(pairs, spark.createDataFrame(list(found.items()), "node string, community string")).first()["q"]
    assert q > community.modularity(pairs, alone).first()["q"]
    assert q > 0.2


def _moves_that_gain(pairs, found, resolution=1.0):
    """Nodes that would gain by moving to a neighbour's community, and communities that would by joining, in plain Python."""
    near, degree = {}, {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    degree = {n: len(x) for n, x in near.items()}
    m, mass = len(pairs), {}
    for n, c in found.items():
        mass[c] = mass.get(c, 0) + degree.get(n, 0)
    out = []
    for n, others in near.items():
        links = {}
        for o in others:
            links[found[o]] = links.get(found[o], 0) + 1
        worth = {c: links.get(c, 0) - resolution * degree[n] * (mass[c] - (degree[n] if c == found[n] else 0)) / (2 * m) for c in {*links, found[n]}}
        if max(worth.values()) > worth[found[n]] + 1e-6:
            out.append(n)
    across = {}
    for a, b in pairs:
        if found[a] != found[b]:
            key = tuple(sorted((found[a], found[b])))
            across[key] = across.get(key, 0) + 1
    return out + [k for k, w in across.items() if w - resolution * mass[k[0]] * mass[k[1]] / (2 * m) > 1e-6]


@pytest.mark.parametrize("kind", ["chain", "star", "random", "cliques"])
def test_louvain_settles_where_no_move_gains(spark, kind):
    rng = random.Random(8)
    n = 200
    if kind == "chain":
        pairs = [(i, i + 1) for i in range(n)]
    elif kind == "star":
        pairs = [(0, i) for i in range(1, n)] + [(i, i + 1) for i in range(1, n, 7)]
    elif kind == "cliques":
        pairs = [(8 * c + i, 8 * c + j) for c in range(20) for i in range(8) for j in range(i)] + [(8 * c, 8 * c + 8) for c in range(19)]
    else:
        pairs = sorted({tuple(sorted(rng.sample(range(100), 2))) for _ in range(250)})
    names = [(f"n{a:05d}", f"n{b:05d}") for a, b in pairs]
    frame = spark.createDataFrame([*names, ("n00000", "n00000"), (None, "x")], "a string, b string")
    alone = spark.createDataFrame([("alone",), ("n00001",), (None,)], "id string")
    found = {r["node"]: r["community"] for r in community.louvain(frame, nodes=alone).collect()}
    assert set(found) == {x for p in names for x in p} | {"alone"}
    assert found.pop("alone") == "alone"
    assert _moves_that_gain(names, found) == []
    if kind == "cliques":
        assert all(len({found[f"n{8 * c + i:05d}"] for i in range(8)}) == 1 for c in range(20))


def test_moves_made_at_once_raise_modularity_by_turn(spark):
    rng = random.Random(9)
    pairs = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(300)})
    frame = spark.createDataFrame(pairs, "a long, b long")
    weights = frame.unionAll(frame.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("w", F.lit(1.0))
    degrees = weights.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d"))
    for start in (1, 7):
        now = {n: n % start if start > 1 else n for n in range(80)}
        partition = spark.createDataFrame(list(now.items()), "node long, community long")
        for turn in range(4):
            before = community.modularity(frame, partition).first()["q"]
            made = community.independent_moves(community.gaining_moves(weights, degrees, partition, float(len(pairs))), float(len(pairs)), 1.0, turn).collect()
            now |= {r["node"]: r["to"] for r in made}
            partition = spark.createDataFrame(list(now.items()), "node long, community long")
            after = community.modularity(frame, partition).first()["q"]
            assert after > before if made else after == before


def test_encoding_and_answers(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: r["embedding"] for r in encoding.encode(rows, "t", dim=8).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1.0, abs=1e-5)
    assert set(got[2]) == {0.0} == set(got[3])
    contexts = spark.createDataFrame([(1, "q", " "), (2, "q", "c <think>x</think>")], "query_id int, query string, context string")
    assert [r["answer"] for r in encoding.answered(contexts).orderBy("query_id").collect()] == ["No relevant passages were found.", "Retrieved context:\nc"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "chunks.json").write_text(json.dumps({"chunks": [{"chunk_id": "a", "text": "b"}]}))
    (tmp_path / "emb.json").write_text(json.dumps({"a": [1.0, 2.0]}))
    assert tables.chunks_json(spark, str(tmp_path / "chunks.json")).first()["chunk_id"] == "a"
    assert tables.embeddings_json(spark, str(tmp_path / "emb.json")).first()["embedding"] == [1.0, 2.0]
    with pytest.raises(FileNotFoundError):
        tables.questions_json(spark, str(tmp_path / "none.json"))
    assert not tables.write_csv(spark.range(0).toDF("x"), str(tmp_path / "csv"))


def _streamed(spark, tmp_path, state):
    stream = spark.readStream.schema("chunk_id string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return progress.extraction_stream(stream, str(tmp_path / "out"), str(tmp_path / state))


def test_stream_does_each_chunk_once(spark, tmp_path, monkeypatch):
    rows = [("a", "part 1234-5678"), ("b", "25 Nm"), ("c", "nothing"), ("d", "WARNING hot. 3 bar"), ("a", "part 1234-5678"), (None, "9 mm")]
    spark.createDataFrame(rows, "chunk_id string, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    whole, calls = progress.written, []

    def dies(after):
        def run(frame, out, batch):
            calls.append(batch)
            if len(calls) == 2 and not after:
                raise RuntimeError("killed before")
            whole(frame, out, batch)
            if len(calls) == 2 and after:
                raise RuntimeError("killed after")

        return run

    for state, after in (("s1", True), ("s2", False)):
        calls.clear()
        monkeypatch.setattr(progress, "written", dies(after))
        with pytest.raises(Exception, match="killed"):
            _streamed(spark, tmp_path, state).awaitTermination()
        monkeypatch.setattr(progress, "written", whole)
        _streamed(spark, tmp_path, state).awaitTermination()
        assert sorted(r["chunk_id"] for r in progress.done(spark, str(tmp_path / "out")).collect()) == ["a", "b", "c", "d"]
    assert sorted((r["chunk_id"], r["type"]) for r in progress.results(spark, str(tmp_path / "out")).collect()) == [("a", "PartNumber"), ("b", "Measurement"), ("d", "Measurement"), ("d", "Warning")]


def test_validated_load(spark, tmp_path):
    kind = "chunk_id string, parsed struct<entities:array<struct<id:string,type:string>>,relationships:array<struct<from:string,to:string,source:string,target:string,type:string,confidence:double>>>"
    ways = [("a", "b", None, None, "part of", 0.5), ("", None, "a", "b", "PART-OF", None), ("a", None, None, "", "PART_OF", 1.0), (None, "b", "", None, "PART_OF", 1.0), ("a", "b", None, None, "made up", 1.0), ("a", "b", None, None, "PART_OF", 1.5), ("a", "b", None, None, None, 1.0)]
    rows = spark.createDataFrame([("c", ([("x", "Tool"), ("", "Tool"), ("y", "Gadget"), ("z", None)], ways)), ("d", ([], None)), ("e", None)], kind)
    good, bad, counts = extraction.validated_load(rows, str(tmp_path / "v"))
    assert counts == {"entities_valid": 1, "entities_quarantine": 3, "relationships_valid": 2, "relationships_quarantine": 5, "items": 11}
    assert sorted((r["what"], r["pos"]) for r in good.collect()) == [("entities", 0), ("relationships", 0), ("relationships", 1)]
    assert sorted((r["what"], r["reason"]) for r in bad.collect()) == sorted([("entities", "no id"), ("entities", "unknown type"), ("entities", "unknown type"), ("relationships", "no target"), ("relationships", "no source"), ("relationships", "unknown type"), ("relationships", "confidence out of range"), ("relationships", "unknown type")])
    assert extraction.validated_load(rows.limit(0), str(tmp_path / "w"))[2]["items"] == 0


def test_documents_of_several_files(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_text("# 71-10 Engine\none\f\f## Oil\nthree\f# Last\nfour")
    (tmp_path / "d/sub/b.txt").write_text("plain\fsecond")
    (tmp_path / "d/_skipped.txt").write_text("# no")
    (tmp_path / "d/c.md").write_text("# other")
    (tmp_path / "d/sub/e.txt").write_bytes(b"")
    path = str(tmp_path / "d")
    got = {(r["path"].rsplit("/", 1)[1], r["page_idx"]): r for r in documents.sections_read(spark, path, "*.txt").collect()}
    assert set(got) == {("a.txt", 0), ("a.txt", 2), ("a.txt", 3), ("b.txt", 0), ("b.txt", 1)}
    assert (got["a.txt", 0]["title"], got["a.txt", 0]["ata"], got["a.txt", 2]["title"], got["a.txt", 2]["page_end"], got["a.txt", 3]["title"]) == ("71-10 Engine", "71", "Oil", 2, "Last")
    assert {(got["b.txt", i]["title"], got["b.txt", i]["id"], got["b.txt", i]["page_end"]) for i in (0, 1)} == {(documents.UNTITLED, "SEC-0001", 1)}
    contents = documents.read_documents(spark, path, "contents", "*.txt")
    assert contents.count() == 5
    assert documents.read_documents(spark, str(tmp_path / "d/c.md")).first()["text"] == "# other"
    reader = documents.DocumentReader({"path": path, "pattern": "*.txt", "bytesatask": "1"})
    assert len(reader.partitions()) == 3
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("path",), f"{path}/a.txt")])) == []
    assert [p.paths for p in reader.partitions()] == [[f"{path}/a.txt"]]
    assert documents.read_documents(spark, path, "pages", "*.none").count() == 0


def test_intermediate_tables_are_deleted_by_their_owner(spark, tmp_path):
    from pathlib import Path

    folder = Path(tables.shared_dir(spark))
    kept = tables.settled(spark.range(3))
    before = set(folder.iterdir())
    with tables.scratch(spark):
        docs = spark.createDataFrame([(i, f"w{i} common") for i in range(20)], "doc long, text string")
        asked = spark.createDataFrame([(1, "w3 common")], "query_id int, query string")
        assert search.bm25_topk(docs, asked, "doc", "text", k=1).collect()[0]["doc"] == 3
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before
    assert kept.count() == 3
    assert tables.sweep(spark) >= 1


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_louvain_joins_send_nothing_to_the_driver(spark):
    weights = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0), ("c", "b", 2.0)], "a string, b string, w double")
    degrees = weights.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d"))
    alone = spark.createDataFrame([(x, x) for x in "abc"], "node string, community string")
    moves = community.gaining_moves(weights, degrees, alone, 3.0)
    for rows in (moves, community.independent_moves(moves, 3.0, 1.0, 0), community.modularity(weights, alone), community.projection(alone.selectExpr("node as id", "'System' as label"), weights.selectExpr("a as src", "b as dst"))):
        assert "Broadcast" not in _plan(rows)


def test_budget_deals_lines_once(spark):
    rows = spark.createDataFrame([(q, s, p, "x" * (30 * (p + 1))) for q in range(3) for s in range(3) for p in range(40)], "query_id long, section long, place long, line string")
    kept = retrieval.within_budget(rows, 700)
    assert _plan(kept).count("Exchange hashpartitioning") == 1
    got = {(r["query_id"], r["section"], r["place"]) for r in kept.collect()}
    assert {(1, 0, -1), (1, 0, 0), (1, 1, -1), (1, 1, 0), (1, 2, -1), (1, 2, 0)} <= got


def test_chunks_of_a_context_are_made_once(spark):
    from graphloom.plans.retrieve import Artefacts, retrieve

    made = spark.sparkContext.accumulator(0)

    def text(x):
        made.add(1)
        return f"pump {x} leaks"

    chunks = spark.range(30).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.udf(text, "string")("id").alias("text"), F.lit("05").alias("ata"))
    none = spark.createDataFrame([], "id string, label string, name string, description string, ata string")
    found = Artefacts(none, spark.createDataFrame([], "src string, dst string, type string"), chunks, spark.createDataFrame([], "id string, summary string"))
    asked = spark.createDataFrame([(1, "pump 7")], "query_id long, query string")
    assert "pump 7 leaks" in retrieve(found, asked, mode="baseline").first()["context"]
    assert made.value <= 60  # at most once for the filter and once for the text


def test_small_files_are_written_in_place_and_dealt_to_tasks(spark, tmp_path):
    files = spark.range(40).select(F.concat(F.lit("f"), "id", F.lit(".txt")).alias("name"), F.concat(F.lit("# 05 a\none "), "id", F.lit("\ftwo\n")).alias("text"))
    path = str(tmp_path / "files")
    assert documents.write_documents(files.unionAll(files.limit(1).select(F.lit(None).cast("string"), "text")), path) == 40
    assert documents.read_documents(spark, path).count() == 80
    reader = documents.DocumentReader({"path": path, "pattern": "*.txt", "bytesatask": str(documents.OPEN * 10)})
    assert len(reader.partitions()) >= 4
