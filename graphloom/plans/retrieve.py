"""Questions in, contexts out: the four paths, their fusion and the context, for a table of questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import DESCRIPTION_CLIP, MAX_ENTITIES, MAX_ROOTS, TOP_BM25, Settings
from graphloom.functions import text as T
from graphloom.operators import encoding, graph, ranking, retrieval, search
from graphloom.sources.tables import settled


@dataclass
class Artefacts:
    """nodes (id, label, name, description, ata), edges (src, dst, type), chunks (id, title, text, ata), communities (id, summary)."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    communities: DataFrame


def valid_questions(questions: DataFrame, most: int = 2000) -> DataFrame:
    return questions.filter(F.length("query").between(1, most))


def text_hits(found: Artefacts, questions: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Hits (query_id, id, score, rank, source, title, text, ata, place) of the vector, word and, if hybrid, community paths."""
    c = found.chunks.select(F.col("id").cast("string").alias("id"), "title", "text", "ata")
    settings = Settings.of(questions.sparkSession)
    c = c.filter(F.size(T.search_tokens(F.concat_ws(" ", "title", "text"))) > 0)  # a chunk without a token is in no path
    c = settled(c)  # every path reads them, more than once
    by_words = search.bm25_topk(c, questions, "id", "title", "text", k=TOP_BM25).withColumnRenamed("doc", "id").withColumn("source", F.lit("bm25"))
    asked = encoding.encode(questions, "query", into="q", dim=settings.encoder_dim).select("query_id", "q")
    vectors = settled(encoding.encode(c, "text", into="vector", dim=settings.encoder_dim).select("id", "vector"))
    by_vector = retrieval.vector_topk(vectors, asked, mode=settings.score_mode).withColumn("source", F.lit("vector"))
    paths = [by_vector.join(c, "id"), by_words.join(c, "id")]
    if mode == "hybrid":
        texts = found.communities.select(F.col("id").cast("string").alias("id"), F.lit("").alias("title"), F.col("summary").alias("text"), F.lit("").alias("ata"))
        paths.append(search.community_overlap(found.communities.withColumn("id", F.col("id").cast("string")), questions).withColumn("source", F.lit("community")).join(texts, "id"))
    return retrieval.fused(*paths)


def graph_hits(found: Artefacts, questions: DataFrame, hops: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked nodes (query_id, node, label, score, ord) about a question, and the edges (query_id, src, dst, type) on the way to them. Without hops as many as the session's settings say."""
    hops = Settings.of(questions.sparkSession).hops if hops is None else hops
    hits = search.expand_codes(search.new_index(found.nodes.filter("label <> 'Entity'"), "id", "name", "description", "ata"), questions)
    roots = ranking.top_k(hits, MAX_ROOTS, ["query_id"], F.asc("branch"), F.asc("rank"), F.asc("doc"), into="at").select("query_id", F.col("doc").alias("root"), "at")
    roots = settled(roots)
    distinct = roots.select("root").distinct()
    near = graph.neighbourhood(distinct, found.nodes, found.edges, hops).filter("node is not null")
    own = roots.select("query_id", F.col("root").alias("node"), (F.col("at") * 2).alias("ord"))
    more = roots.join(near, "root").select("query_id", "node", (F.col("at") * 2 + 1).alias("ord"))
    ways = graph.path_edges(distinct, found.nodes, found.edges, hops)
    return graph.ranked_nodes(own.unionAll(more), found.nodes), roots.join(ways, "root").select("query_id", "src", "dst", "type").distinct()


def context_entities(nodes: DataFrame, most: int = MAX_ENTITIES) -> DataFrame:
    """(query_id, entities, entities_found) of graph_hits()'s nodes: the ids of the first most in the order of a context, and how many there are."""
    placed = ranking.top_k(nodes, 1 << 30, ["query_id"], F.desc("score"), F.asc("ord"), F.asc("node"), into="place")
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "node"))))
    return placed.groupBy("query_id").agg(F.transform(first, lambda x: x["node"]).alias("entities"), F.count("*").alias("entities_found"))


def retrieve(found: Artefacts, questions: DataFrame, mode: str = "hybrid") -> DataFrame:
    """(query_id, query, context, contexts, entities, entities_found) of every valid question; mode baseline leaves out the graph and communities, and so finds no entities.

    contexts: the texts that an answer is judged against; entities: the first nodes of the graph's part."""
    asked = valid_questions(questions.select(F.col("query_id").cast("string").alias("query_id"), "query"))
    hits = settled(text_hits(found, asked, mode))
    lines = retrieval.text_lines(hits).select("query_id", F.lit(2).cast("long").alias("section"), "place", "line")
    entities = asked.select("query_id", F.array().cast("array<string>").alias("entities"), F.lit(0).cast("long").alias("entities_found")).limit(0)
    if mode == "hybrid":
        nodes, ways = graph_hits(found, asked)
        nodes = settled(nodes)
        entities = context_entities(nodes)
        d = T.truthy(F.substring("description", 1, DESCRIPTION_CLIP))
        named = nodes.join(found.nodes.groupBy(F.col("id").alias("node")).agg(F.max(F.struct("name", "description", "ata")).alias("p")).select("node", "p.*"), "node")
        line = F.concat(F.lit("["), "label", F.lit("|ATA-"), F.coalesce("ata", F.lit("")), F.lit("] "), "node", F.lit(": "), T.first_truthy(F.col("name"), F.col("node")), F.coalesce(F.concat(F.lit(" — "), d), F.lit("")))
        of_nodes = ranking.top_k(named.withColumn("line", line), 1 << 30, ["query_id"], F.desc("score"), F.asc("ord"), F.asc("node"), into="place")
        way = F.concat(F.lit("  ("), "src", F.lit(") -["), "type", F.lit("]-> ("), "dst", F.lit(")"))
        of_ways = ranking.top_k(ways.withColumn("line", way), 1 << 30, ["query_id"], F.asc("line"), into="place")
        for section, rows in enumerate((of_nodes, of_ways)):
            lines = lines.unionAll(rows.select("query_id", F.lit(section).cast("long").alias("section"), "place", "line"))
    texts = retrieval.context_text(retrieval.within_budget(settled(lines)))
    contexts = retrieval.snippets(hits).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda x: x["snippet"]).alias("contexts"))
    none = F.array().cast("array<string>")
    rows = asked.join(texts, "query_id", "left").join(contexts, "query_id", "left").join(entities, "query_id", "left")
    return rows.select("query_id", "query", "context", F.coalesce("contexts", none).alias("contexts"), F.coalesce("entities", none).alias("entities"), F.coalesce("entities_found", F.lit(0)).alias("entities_found"))
