"""Sections as nodes above their chunks, members below their communities, and the build of the whole graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import CHAPTERS, COMMUNITY_MIN
from graphloom.functions import text as T
from graphloom.operators import chunking, graph
from graphloom.operators.ranking import numbered


def sections_of(chunks: DataFrame) -> DataFrame:
    """(id, title, ata, level) of every section named by chunks, as its first chunk by global_seq has it; chunks without section_id name none."""
    rows = chunks.filter(T.truthy(F.col("section_id")).isNotNull())
    first = rows.groupBy("section_id").agg(F.min_by(F.struct("section_title", "ata", "level"), "global_seq").alias("s"))
    return first.select(F.col("section_id").alias("id"), F.col("s.section_title").alias("title"), F.col("s.ata").alias("ata"), F.coalesce("s.level", F.lit(1)).alias("level"))


def section_edges(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Edges from chunks to the sections that exist, each once."""
    rows = chunks.filter(T.truthy(F.col("chunk_id")).isNotNull()).select(F.col("chunk_id").alias("src"), F.col("section_id").alias("dst"))
    return rows.join(sections.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", F.lit("PART_OF_SECTION").alias("type")).distinct()


def with_embeddings(rows: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """rows with the embedding of their id, null without one; of an id's several embeddings one is taken, so rows don't multiply."""
    one = embeddings.groupBy(F.col("id").alias(key)).agg(F.min_by("embedding", F.hash("embedding")).alias("embedding"))
    return rows.join(one, key, "left")


def chapter_names(chapters: Column, most: int = 5) -> Column:
    """The names of the first most chapters; one without a name is called by its number."""
    named = F.create_map(*[F.lit(x) for pair in CHAPTERS.items() for x in pair])
    return F.transform(F.slice(chapters, 1, most), lambda c: F.coalesce(F.try_element_at(named, c), F.concat(F.lit("ATA "), c)))


def community_table(partition: DataFrame, nodes: DataFrame, least: int = COMMUNITY_MIN) -> DataFrame:
    """(id, community, place, size, ata_chapters, ata_names) of the communities of least members or more, the largest first, ties by community.

    Members are nodes that exist, each counted once: of several rows of an id the last by ord has its chapter or community, without ord the
    greatest. ids are numbered in that order."""
    known = nodes.groupBy(F.col("id").alias("node")).agg((F.max_by("ata", "ord") if "ord" in nodes.columns else F.max("ata")).alias("ata"))
    chapters = F.array_sort(F.collect_set(F.when(F.col("ata") != "00", F.col("ata"))))
    rows = partition.groupBy("node").agg((F.max_by("community", "ord") if "ord" in partition.columns else F.max("community")).alias("community")).join(known, "node").groupBy("community").agg(F.count("*").alias("size"), chapters.alias("ata_chapters")).filter(F.col("size") >= least)
    rows = numbered(rows.withColumn("_order", -F.col("size")), "_order", "community", into="place").drop("_order")
    return rows.select(F.concat(F.lit("COMM-"), T.zfill(F.col("place").cast("string"), 4)).alias("id"), "community", "place", "size", "ata_chapters", chapter_names(F.col("ata_chapters")).alias("ata_names"))


def member_edges(partition: DataFrame, nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges from nodes that exist to the communities (id, community) that are kept."""
    known = nodes.select(F.col("id").alias("node")).distinct()
    rows = partition.join(known, "node", "left_semi").join(communities.select("community", "id"), "community")
    return rows.select(F.col("node").alias("src"), F.col("id").alias("dst"), F.lit("MEMBER_OF").alias("type")).distinct()


def source_list(chunks: Column, most: int = 10) -> Column:
    """The first most ids of a list of source chunks, comma-joined; null for none."""
    return T.truthy(F.array_join(F.slice(chunks, 1, most), ","))


def first_chapter(chapters: Column) -> Column:
    """The first of a list, or the empty string where there is none."""
    return F.coalesce(F.get(chapters, F.lit(0)), F.lit(""))


def projection_counts(nodes: DataFrame, pairs: DataFrame, partition: DataFrame, exclude: list[str]) -> DataFrame:
    """One row: nodes of the projection (those without an edge too), its edges, and communities."""
    kept = nodes.filter(~F.col("label").isin(exclude)).agg(F.countDistinct("id").alias("nodes"))
    return kept.join(pairs.agg(F.count("*").alias("edges")), F.lit(True)).join(partition.agg(F.countDistinct("community").alias("communities")), F.lit(True))  # one row each


CHUNK_PROPERTIES = ["text", "section_title", "ata", "page_start", "page_end", "word_count", "global_seq", "section_id"]


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows of tables whose columns differ: a column that one lacks is null there, and one of unlike types becomes text."""
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for name, kind in t.dtypes:
            kinds.setdefault(name, set()).add(kind)
    out = None
    for t in tables:
        t = t.select(*[F.col(f"`{c}`").cast("string").alias(c) if len(kinds[c]) > 1 else F.col(f"`{c}`") for c in t.columns])
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def build_graph(chunks: DataFrame, entities: DataFrame, relationships: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a corpus: sections, chunks and entities as nodes with all their properties; adjacency, containment, sections and relationships as edges between nodes that exist.

    chunks: chunk_id, section_id, section_title, ata, level, text, global_seq and what else of CHUNK_PROPERTIES they have; entities: id, type, source_chunks
    (comma-joined or a list) and any properties, by ord where they have it; relationships: source, target, type; embeddings: id, embedding. nodes have label, id
    and one column a property (null where a node lacks it; unlike types become text). Of a (label, id) that comes more than once, the last to have a property gives
    it: chunks by global_seq, entities by ord, else in the tables' order. Blank ids make no node. Nodes come before edges, so that an edge counts whatever its order."""
    sections = sections_of(chunks)
    held = chunks.filter(T.truthy(F.col("chunk_id")).isNotNull())
    c = with_embeddings(held.select(F.col("chunk_id").alias("id"), *[p for p in CHUNK_PROPERTIES if p in chunks.columns], F.col("global_seq").cast("long").alias("ord")), embeddings, "id")
    named = entities.withColumn("id", F.trim("id")).filter(T.truthy(F.col("id")).isNotNull())
    listed = dict(entities.dtypes)["source_chunks"].startswith("array")
    named = named.withColumn("source_chunks", F.col("source_chunks") if listed else F.filter(F.split(F.coalesce("source_chunks", F.lit("")), ","), lambda x: x != ""))
    named = named.withColumn("ord", F.col("ord").cast("long") if "ord" in entities.columns else F.monotonically_increasing_id())
    things = with_embeddings(named.withColumns({"label": graph.label_of(F.col("type")), "source_chunks": source_list(F.col("source_chunks"))}).drop("type"), embeddings, "id")
    nodes = [sections.select(F.lit("DocumentSection").alias("label"), "id", "title", "ata", "level", F.lit(0).cast("long").alias("ord")), c.withColumn("label", F.lit("Chunk")), things]
    nodes = graph.last_properties(graph.clean_properties(stacked(*nodes)))
    edges = chunking.adjacent(held, "global_seq").unionAll(section_edges(chunks, sections))
    edges = edges.unionAll(graph.contains_edges(named.withColumn("source_chunks", F.array_join("source_chunks", ",")), held))
    kind = F.translate(F.upper(F.coalesce(T.truthy(F.col("type")), F.lit("CONNECTED_TO"))), " -", "__")
    return nodes, graph.upsert_edges(edges.unionAll(relationships.select(F.trim("source").alias("src"), F.trim("target").alias("dst"), kind.alias("type"))), nodes)
