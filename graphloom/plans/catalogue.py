"""The engine's queries over the driver's tables, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.config import CHAPTERS, PROJECTION_EXCLUDES
from graphloom.functions import jsons, vector
from graphloom.functions import text as T
from graphloom.functions.numbers import round_even, sql_round_even
from graphloom.operators import chunking, community, encoding, evaluation, extraction, graph, ranking, reports, resolution, retrieval, search, sections, store
from graphloom.plans.retrieve import Artefacts, context_entities, graph_hits, retrieve
from graphloom.sources import documents
from graphloom.sources.tables import scratch_path, settled, table
from graphloom.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _sections(spark, d):
    """Each document stands for a section."""
    return table(spark, d, "documents").select(F.format_string("SEC-%04d", "doc_id").alias("section_id"), "doc_id", F.col("source").alias("title"), F.col("lang").alias("ata"), "text")


def _benchmark(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _questions(spark, d):
    """Every turn of a user is a question."""
    return table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))


# -- text

SQL_TOKENS = "list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9]', ' ', 'g'), ' +'), lambda w: w <> '')"


def _sql_bm25(docs: str, queries: str, k: int, extra: str = "") -> str:
    """CTEs up to bm25(query_id, doc, score, rank) from docs (doc, x) and queries (query_id, query)."""
    return f"""
bd AS (SELECT doc, {SQL_TOKENS.format('x')} AS toks FROM ({docs})),
bp AS (SELECT doc, tok, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(toks) AS dl, unnest(toks) AS tok FROM bd WHERE len(toks) > 0) GROUP BY doc, tok),
bs AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM bd WHERE len(toks) > 0),
br AS (SELECT tok, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM bp, bs GROUP BY tok, n),
bi AS (SELECT tok, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM br) ELSE raw END AS idf FROM br),
bq AS (SELECT query_id, tok, count(*) AS qtf FROM (SELECT query_id, unnest({SQL_TOKENS.format('query')}) AS tok FROM ({queries})) GROUP BY query_id, tok),
bsc AS (SELECT query_id, doc, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM bp JOIN bq ON bp.tok = bq.tok JOIN bi ON bp.tok = bi.tok, bs GROUP BY query_id, doc{extra}),
bm25 AS (SELECT * FROM (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM bsc) WHERE rank <= {k} AND score > 0)"""


_DOCS, _ASKED = "SELECT doc_id AS doc, source || ' ' || text AS x FROM documents", "SELECT item_id AS query_id, text AS query FROM benchmark"


@query("WITH" + _sql_bm25(_DOCS, _ASKED, 4) + " SELECT query_id, doc, score, rank FROM bm25")
def bm25_topk(spark, d):
    return search.bm25_topk(table(spark, d, "documents"), _benchmark(spark, d), "doc_id", "source", "text").select("query_id", "doc", "score", "rank")


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {SQL_TOKENS.format('text')} AS t FROM documents)")
def tokenize_stats(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.search_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)\bWARNING\b') AS has_warning, regexp_matches(text, '(?i)\bCAUTION\b') AS has_caution, regexp_matches(text, '(?i)\bNOTE\b') AS has_note,
  regexp_matches(text, '(?im)^\s*(?:WARNING|CAUTION|NOTE)\s*[:\-]?\s*$') AS has_safety_block, regexp_matches(text, '(?im)^\s*(?:TASK|JOB SET-UP|JOB CLOSE-UP|SUBTASK|PROCEDURE)\b') AS has_task,
  CAST(len(regexp_extract_all(text, '(?m)^\s*(?:\(\d+\)|\d+[.\):]|Step\s+\d+:|[a-z][.\)])\s+\S')) AS BIGINT) AS step_count, regexp_matches(text, '(?i)\b\d+(?:[.,]\d+)?\s*(?:Nm|N\.m|ft\.?lb|bar|psi|mm|cm|°[CF]|kPa)\b') AS has_measurements,
  len(regexp_extract_all(text, '(?m)^\s*(?:\(\d+\)|\d+[.\):]|Step\s+\d+:|[a-z][.\)])\s+\S')) > 0 AS has_steps,
  regexp_matches(text, '(?im)^\s*(?:TOOLS REQUIRED|MATERIALS REQUIRED|PARTS REQUIRED)') AS has_tools_table, regexp_matches(text, '\b\d{3,}\s*[\-]\s*\d{3,}\b') AS has_part_numbers,
  CAST(len(regexp_extract_all(text, '(?i)\b\d+(?:[.,]\d+)?\s*(?:Nm|N\.m|ft\.?lb|bar|psi|mm|cm|°[CF]|kPa)\b')) AS BIGINT) AS measurement_count FROM documents""")
def feature_flags(spark, d):
    found = T.features(F.col("text")) | T.block_features(F.col("text"))
    return table(spark, d, "documents").withColumns(found).select("doc_id", *found)


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b(?:the|and|that)\b')) AS BIGINT) AS n_common, CAST(len(regexp_extract_all(text, '(?m)^[A-Z]')) AS BIGINT) AS n_lines FROM documents")
def regex_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\b(?:the|and|that)\b")).cast("long").alias("n_common"), F.regexp_count("text", F.lit("(?m)^[A-Z]")).cast("long").alias("n_lines"))


SQL_NORM = r"array_to_string(string_split(upper(regexp_replace(trim(regexp_replace({}, '[^A-Za-z0-9_\s]', ' ', 'g')), '[\s\-_/]+', '_', 'g')), '_')[1:5], '_')"
SQL_DEDUP = f"replace(lower({SQL_NORM}), '_', '')"


@query(f"SELECT p_partkey, {SQL_NORM.format("p_name || ' (' || p_brand || ')/' || p_type")} AS name FROM part")
def normalize_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalize_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")/"), "p_type")).alias("name"))


@query(f"SELECT p_partkey, {SQL_DEDUP.format('p_name')} AS name_key, 'part::' || regexp_replace(upper(p_brand), '[\\s\\-]', '', 'g') AS part_key, 'warning::' || {SQL_DEDUP.format('substr(p_name, 1, 80)')} AS warning_key FROM part")
def dedup_keys(spark, d):
    key = lambda kind, c: T.typed_dedup_key(F.lit(kind), F.col(c), F.col(c), F.lit(""))
    return table(spark, d, "part").select("p_partkey", T.dedup_form(F.col("p_name")).alias("name_key"), key("PartNumber", "p_brand").alias("part_key"), key("Warning", "p_name").alias("warning_key"))


@query(f"""SELECT p_partkey, 'COMP-' || lpad(p_size::VARCHAR, greatest(2, length(p_size::VARCHAR))::INT, '0') || '-' || {SQL_NORM.format('p_name')} AS component_id, 'TOOL-' || {SQL_NORM.format('p_name')} AS tool_id,
  'WARN-' || lpad(p_size::VARCHAR, greatest(2, length(p_size::VARCHAR))::INT, '0') || '-' || lpad(p_partkey::VARCHAR, greatest(4, length(p_partkey::VARCHAR))::INT, '0') AS warning_id,
  'REQ-' || lpad(p_size::VARCHAR, greatest(2, length(p_size::VARCHAR))::INT, '0') || '-REQ-' || lpad(p_partkey::VARCHAR, greatest(4, length(p_partkey::VARCHAR))::INT, '0') AS requirement_id, 'PART-' || regexp_replace(upper(p_brand), '[^A-Za-z0-9_\\-]', '', 'g') AS part_id FROM part""")
def deterministic_ids(spark, d):
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    return table(spark, d, "part").select("p_partkey", T.named("COMP", name, size).alias("component_id"), T.named("TOOL", name).alias("tool_id"), T.numbered("WARN", size, seq=F.col("p_partkey")).alias("warning_id"), T.requirement_id(size, F.col("p_type"), F.col("p_partkey")).alias("requirement_id"), T.part_id(F.col("p_brand")).alias("part_id"))


@query(r"SELECT p_partkey, CASE WHEN regexp_extract(p_name || ' ' || p_size, '\b(\d{2})(?:-\d+)?\b', 1) = '' THEN '00' ELSE regexp_extract(p_name || ' ' || p_size, '\b(\d{2})(?:-\d+)?\b', 1) END AS chapter FROM part")
def ata_guess(spark, d):
    return table(spark, d, "part").select("p_partkey", T.guess_chapter(F.concat_ws(" ", "p_name", "p_size")).alias("chapter"))


@query(r"SELECT o_orderkey, array_to_string(regexp_extract_all(o_orderpriority || ' ' || o_orderdate::DATE::VARCHAR, '\b(\d{2})\b', 1), ',') AS codes FROM orders")
def code_extraction(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.codes(F.concat_ws(" ", "o_orderpriority", F.col("o_orderdate").cast("date"))), ",").alias("codes"))


# -- chunking

SQL_CHUNKS = """ch AS (SELECT doc_id, low, w[low + 1:low + 512] AS part FROM (SELECT doc_id, w, unnest(range(0, len(w), 412)) AS low FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents) WHERE len(w) >= 80) WHERE len(w[low + 1:low + 512]) >= 80),
chunks AS (SELECT doc_id, printf('SEC-%04d', doc_id) AS section_id, printf('SEC-%04d-C%03d', doc_id, low // 412 + 1) AS chunk_id, low // 412 AS chunk_seq, len(part) AS word_count, array_to_string(part, ' ') AS text FROM ch)"""


def _chunks(spark, d):
    return chunking.chunk_windows(_sections(spark, d))


@query(f"WITH {SQL_CHUNKS} SELECT section_id, chunk_id, CAST(chunk_seq AS BIGINT) AS chunk_seq, CAST(word_count AS BIGINT) AS word_count, md5(text) AS digest FROM chunks")
def chunk_windows(spark, d):
    return _chunks(spark, d).select("section_id", "chunk_id", "chunk_seq", "word_count", F.md5("text").alias("digest"))


@query(rf"""WITH {SQL_CHUNKS} SELECT count(*) AS n_chunks, round(avg(word_count), 6) AS avg_words, 0::BIGINT + count(*) FILTER (regexp_matches(text, '(?i)\bWARNING\b')) AS n_warning,
  CAST(coalesce(sum(len(regexp_extract_all(text, '(?m)^\s*(?:\(\d+\)|\d+[.\):]|Step\s+\d+:|[a-z][.\)])\s+\S'))), 0) AS BIGINT) AS n_steps,
  CAST(coalesce(sum(len(regexp_extract_all(text, '(?i)\b\d+(?:[.,]\d+)?\s*(?:Nm|N\.m|ft\.?lb|bar|psi|mm|cm|°[CF]|kPa)\b'))), 0) AS BIGINT) AS n_measurements FROM chunks""")
def chunk_stats(spark, d):
    return chunking.chunk_stats(_chunks(spark, d)).select("n_chunks", "avg_words", "n_warning", "n_steps", "n_measurements")


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id, row_number() OVER (ORDER BY doc_id, chunk_seq) - 1 AS global_seq FROM chunks")
def global_sequence(spark, d):
    return chunking.global_sequence(_chunks(spark, d).select("doc_id", "chunk_seq", "chunk_id"), "doc_id", "chunk_seq").select("chunk_id", "global_seq")


@query(f"WITH {SQL_CHUNKS} SELECT * FROM (SELECT chunk_id AS src, lead(chunk_id) OVER (ORDER BY doc_id, chunk_seq) AS dst, 'ADJACENT_TO' AS type FROM chunks) WHERE dst IS NOT NULL")
def adjacent_chunks(spark, d):
    return chunking.adjacent(chunking.global_sequence(_chunks(spark, d).select("doc_id", "chunk_seq", "chunk_id"), "doc_id", "chunk_seq"), "global_seq")


@query(f"WITH {SQL_CHUNKS} SELECT * FROM (SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_seq) AS dst, 'ADJACENT_TO' AS type FROM chunks) WHERE dst IS NOT NULL")
def adjacent_in_document(spark, d):
    return chunking.adjacent(_chunks(spark, d), "chunk_seq", "doc_id")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, min(turn) + 1 AS page_start, max(turn) + 1 AS page_end FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def section_text_agg(spark, d):
    rows = chunking.section_texts(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", F.md5("text").alias("digest"), "page_start", "page_end")


@query("""WITH t AS (SELECT conv_id AS doc, turn AS idx, CAST(length(text) % 13 AS BIGINT) AS level, 1 + 2 * turn AS page_1 FROM conversations),
n AS (SELECT a.doc, a.idx, min_by(b.page_1, b.idx) AS p FROM t a JOIN t b ON a.doc = b.doc AND b.idx > a.idx AND b.level <= a.level GROUP BY a.doc, a.idx)
SELECT t.doc, t.idx, printf('SEC-%04d', t.idx + 1) AS id, page_1 - 1 AS page_start, CAST(CASE WHEN p IS NULL THEN 99 ELSE greatest(0, p - 2) END AS BIGINT) AS page_end FROM t LEFT JOIN n ON t.doc = n.doc AND t.idx = n.idx""")
def toc_page_end(spark, d):
    toc = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), (F.length("text") % 13).cast("long").alias("level"), (1 + 2 * F.col("turn")).alias("page_1"))
    return chunking.toc_ends(toc, 99).select("doc", "idx", "id", "page_start", "page_end")


@query("""WITH s AS (SELECT conv_id AS idx, count(*) % 3 + 1 AS level, conv_id * 3 AS page_start, conv_id * 3 + 2 * count(*) AS page_end FROM conversations GROUP BY conv_id),
p AS (SELECT doc_id AS page_idx FROM documents),
o AS (SELECT page_idx, idx, row_number() OVER (PARTITION BY page_idx ORDER BY level DESC, idx) AS rn FROM p JOIN s ON page_idx BETWEEN page_start AND page_end)
SELECT p.page_idx, coalesce(o.idx, (SELECT min(idx) FROM s)) AS section_idx FROM p LEFT JOIN o ON p.page_idx = o.page_idx AND rn = 1""")
def page_to_section(spark, d):
    n = F.count("*")
    sections = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("idx")).agg((n % 3 + 1).alias("level"), (F.col("idx") * 3).alias("page_start"), (F.col("idx") * 3 + 2 * n).alias("page_end"))
    return chunking.pages_to_sections(table(spark, d, "documents").select(F.col("doc_id").alias("page_idx")), sections)


# -- vectors: one exemplar of each label asks all vectors

_VQ = "q AS (SELECT label AS query_id, min_by(embedding, vec_id) AS q FROM embeddings GROUP BY label), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS c FROM embeddings, q)"


def _vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), rows.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("q"))


@query(f"WITH {_VQ}, r AS (SELECT query_id, id, round(c, 6) AS score FROM s) SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r WHERE score >= 0.35) WHERE rank <= 5")
def cosine_topk(spark, d):
    return retrieval.vector_topk(*_vectors(spark, d))


@query(f"WITH {_VQ} SELECT query_id, count(*) AS n FROM s WHERE round(c, 6) >= 0.5 GROUP BY query_id")
def cosine_threshold(spark, d):
    return retrieval.vectors_within(*_vectors(spark, d), 0.5).groupBy("query_id").agg(F.count("*").alias("n"))


@query(f"WITH {_VQ}, r AS (SELECT query_id, id, round((1 + c) / 2, 6) AS score FROM s) SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r WHERE score >= 0.3) WHERE rank <= 5")
def vector_unit_score(spark, d):
    return retrieval.vector_topk(*_vectors(spark, d), floor=0.3, mode="unit")


# -- resolution: parts share few names, so their rows merge

SQL_RESOLVED = f"""ents AS (SELECT 'P' || p_partkey AS id, p_type AS type, p_name AS name, p_partkey AS ord, 'K' || (p_partkey % 50) AS chunk, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS brand, {SQL_DEDUP.format('p_name')} AS norm_name FROM part),
src AS (SELECT type, norm_name, string_agg(chunk, ',' ORDER BY ord) AS source_chunks FROM (SELECT type, norm_name, chunk, min(ord) AS ord FROM ents GROUP BY ALL) GROUP BY ALL),
res AS (SELECT e.type, e.norm_name, min_by(id, ord) AS id, min(ord) AS ord, count(*) AS merged, min_by(brand, ord) FILTER (brand <> '') AS brand, any_value(source_chunks) AS source_chunks FROM ents e JOIN src ON e.type = src.type AND e.norm_name = src.norm_name GROUP BY e.type, e.norm_name)"""


def _parts(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.concat(F.lit("K"), (F.col("p_partkey") % 50).cast("string")).alias("chunk"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("brand"))


def _resolved(spark, d):
    return resolution.resolve_entities(_parts(spark, d), ["brand"])


@query(f"WITH {SQL_RESOLVED} SELECT id, type, norm_name, brand, merged FROM res")
def entity_resolution(spark, d):
    return _resolved(spark, d).select("id", "type", "norm_name", "brand", "merged")


@query(f"WITH {SQL_RESOLVED} SELECT id, source_chunks FROM res")
def entity_source_lists(spark, d):
    return _resolved(spark, d).select("id", "source_chunks")


@query("SELECT p_type AS type, count(*) AS n FROM part GROUP BY p_type")
def type_counts(spark, d):
    return resolution.type_counts(_parts(spark, d))


SQL_RELS = f"""rels AS (SELECT 'P' || p_partkey AS s, p_name AS t, CASE WHEN p_size % 2 = 0 THEN 'USED_IN' ELSE 'CONNECTED_TO' END AS type FROM part),
names AS (SELECT norm_name, max_by(id, ord) AS id FROM res GROUP BY norm_name)"""


def _rels(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("from"), F.lit("").alias("source"), F.lit("").alias("to"), F.col("p_name").alias("target"), F.when(F.col("p_size") % 2 == 0, "used-in").otherwise("").alias("type"), F.col("p_partkey").alias("ord"))


@query(f"WITH {SQL_RESOLVED}, {SQL_RELS} SELECT DISTINCT rels.s AS source, names.id AS target, rels.type FROM rels JOIN res ON rels.s = res.id JOIN names ON names.norm_name = {SQL_DEDUP.format('rels.t')}")
def relationship_resolution(spark, d):
    return resolution.resolve_relationships(_rels(spark, d), _resolved(spark, d)).select("source", "target", "type")


@query(f"WITH {SQL_RESOLVED} SELECT 'P' || p_partkey AS id FROM part WHERE 'P' || p_partkey NOT IN (SELECT id FROM res)")
def dangling_relationships(spark, d):
    known = _resolved(spark, d).select(F.col("id").alias("from"))
    return _rels(spark, d).join(known, "from", "left_anti").select(F.col("from").alias("id"))


# -- graph: nations between regions and their customers and suppliers

SQL_GRAPH = """nodes AS (SELECT 'R' || r_regionkey AS id, 'System' AS label, r_name AS name, '00' AS ata FROM region UNION ALL SELECT 'N' || n_nationkey, 'Component', n_name, lpad((n_nationkey % 100)::VARCHAR, 2, '0') FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'Chunk', c_name, lpad((c_nationkey % 100)::VARCHAR, 2, '0') FROM customer UNION ALL SELECT 'S' || s_suppkey, 'Tool', s_name, lpad((s_nationkey % 100)::VARCHAR, 2, '0') FROM supplier),
edges AS (SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'LOCATED_IN' AS type FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'PART_OF' FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'PART_OF' FROM supplier)"""
_TRAILS = """ways AS (SELECT src || '>' || type || '>' || dst AS e, src AS a, dst AS b FROM edges UNION ALL SELECT src || '>' || type || '>' || dst, dst, src FROM edges),
roots AS (SELECT id AS root FROM nodes WHERE label IN ('System', 'Component')),
t1 AS (SELECT root, b AS node, e AS e1 FROM roots JOIN ways ON root = a), t2 AS (SELECT root, b AS node, e1, e AS e2 FROM t1 JOIN ways ON node = a WHERE e <> e1)"""


def _nodes(spark, d):
    rows = None
    for name, prefix, key, label, title, code in (("region", "R", "r_regionkey", "System", "r_name", None), ("nation", "N", "n_nationkey", "Component", "n_name", "n_nationkey"), ("customer", "C", "c_custkey", "Chunk", "c_name", "c_nationkey"), ("supplier", "S", "s_suppkey", "Tool", "s_name", "s_nationkey")):
        ata = F.lpad((F.col(code) % 100).cast("string"), 2, "0") if code else F.lit("00")
        part = table(spark, d, name).select(F.concat(F.lit(prefix), key).alias("id"), F.lit(label).alias("label"), F.col(title).alias("name"), ata.alias("ata"))
        rows = part if rows is None else rows.unionAll(part)
    return rows


def _edges(spark, d):
    rows = None
    for name, prefix, key, to, other, kind in (("nation", "N", "n_nationkey", "R", "n_regionkey", "LOCATED_IN"), ("customer", "C", "c_custkey", "N", "c_nationkey", "PART_OF"), ("supplier", "S", "s_suppkey", "N", "s_nationkey", "PART_OF")):
        part = table(spark, d, name).select(F.concat(F.lit(prefix), key).alias("src"), F.concat(F.lit(to), other).alias("dst"), F.lit(kind).alias("type"))
        rows = part if rows is None else rows.unionAll(part)
    return rows


def _roots(spark, d):
    return _nodes(spark, d).filter(F.col("label").isin("System", "Component")).select(F.col("id").alias("root"))


@query(f"WITH {SQL_GRAPH} SELECT id, label, name, ata FROM nodes")
def graph_nodes(spark, d):
    return graph.clean_properties(_nodes(spark, d))


@query(f"WITH {SQL_GRAPH} SELECT DISTINCT src, dst, type FROM edges")
def graph_edges(spark, d):
    return graph.upsert_edges(_edges(spark, d), _nodes(spark, d))


@query(f"WITH {SQL_GRAPH} SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def graph_stats(spark, d):
    return graph.graph_stats(_nodes(spark, d), _edges(spark, d))


@query(f"WITH {SQL_GRAPH} SELECT src, dst, type FROM edges")
def edge_upsert_idempotent(spark, d):
    edges, stray = _edges(spark, d), _edges(spark, d).withColumn("dst", F.lit("nowhere"))
    return graph.upsert_edges(edges.unionAll(edges).unionAll(stray), _nodes(spark, d))


@query(f"WITH {SQL_GRAPH} SELECT id, label, CASE WHEN label = 'Tool' THEN upper(name) ELSE name END AS name, CASE WHEN label = 'Tool' AND ata = '03' THEN '99' ELSE ata END AS ata FROM nodes")
def node_upsert_merge(spark, d):
    old = _nodes(spark, d)
    new = old.filter(F.col("label") == "Tool").select("id", "label", F.upper("name").alias("name"), F.when(F.col("ata") == "03", "99").alias("ata"), F.lit(1).alias("ord"))
    return graph.upsert_nodes(old, new.unionAll(new.withColumns({"name": F.lit("overwritten"), "ord": F.lit(0)}))).select("id", "label", "name", "ata")


@query(f"WITH {SQL_RESOLVED}, x AS (SELECT id AS dst, unnest(string_split(source_chunks, ',')) AS src FROM res) SELECT DISTINCT src, dst, 'CONTAINS' AS type FROM x WHERE src IN (SELECT 'K' || n_nationkey FROM nation)")
def contains_edges(spark, d):
    return graph.contains_edges(_resolved(spark, d), table(spark, d, "nation").select(F.concat(F.lit("K"), "n_nationkey").alias("chunk_id")))


@query("SELECT p_type AS label, p_name AS id, count(*) AS n FROM part GROUP BY p_type, p_name HAVING count(*) > 1")
def unique_violations(spark, d):
    return graph.unique_violations(table(spark, d, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("id")))


@query(f"WITH {SQL_GRAPH}, {_TRAILS} SELECT DISTINCT root, node FROM t1")
def one_hop(spark, d):
    return graph.neighbourhood(_roots(spark, d), _nodes(spark, d), _edges(spark, d), hops=1, without=None)


@query(f"WITH {SQL_GRAPH}, {_TRAILS} SELECT root, node FROM t1 UNION SELECT root, node FROM t2")
def two_hop_trail(spark, d):
    return graph.neighbourhood(_roots(spark, d), _nodes(spark, d), _edges(spark, d), without=None)


@query(f"WITH {SQL_GRAPH}, {_TRAILS} SELECT root, node FROM (SELECT root, node FROM t1 UNION SELECT root, node FROM t2) WHERE node IN (SELECT id FROM nodes WHERE label <> 'Chunk')")
def two_hop_excluding_label(spark, d):
    return graph.neighbourhood(_roots(spark, d), _nodes(spark, d), _edges(spark, d))


@query(f"""WITH {SQL_GRAPH}, {_TRAILS}, ok AS (SELECT id FROM nodes WHERE label <> 'Chunk'), used AS (SELECT root, e1 AS e FROM t1 WHERE node IN (FROM ok) UNION SELECT root, e1 FROM t2 WHERE node IN (FROM ok) UNION SELECT root, e2 FROM t2 WHERE node IN (FROM ok))
SELECT DISTINCT root, src, dst, type FROM used JOIN edges ON e = src || '>' || type || '>' || dst""")
def path_relationships(spark, d):
    return graph.path_edges(_roots(spark, d), _nodes(spark, d), _edges(spark, d))


@query(f"""WITH {SQL_GRAPH}, {_TRAILS} SELECT DISTINCT root AS query_id, node, label, CASE label WHEN 'Component' THEN 0.80::DOUBLE WHEN 'System' THEN 0.75::DOUBLE WHEN 'Tool' THEN 0.65::DOUBLE ELSE 0.50::DOUBLE END AS score FROM t1 JOIN nodes ON node = id""")
def ranked_context_nodes(spark, d):
    hits = graph.trails(_roots(spark, d), _edges(spark, d), 1).select(F.col("root").alias("query_id"), "node", F.lit(0).alias("ord"))
    return graph.ranked_nodes(hits, _nodes(spark, d)).select("query_id", "node", "label", "score")


@query(f"WITH {SQL_GRAPH} SELECT DISTINCT id, name AS title, label AS type FROM nodes")
def graph_viz_nodes(spark, d):
    return graph.viz_nodes(_nodes(spark, d))


@query(f"WITH {SQL_GRAPH} SELECT src, dst, type FROM edges WHERE dst IN (SELECT id FROM nodes WHERE label = 'System') AND src IN (SELECT id FROM nodes)")
def edge_semi_join(spark, d):
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    systems = nodes.filter(F.col("label") == "System").select(F.col("id").alias("dst"))
    return edges.join(systems, "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "type")


# -- keyword search and communities

_NAMED, _BY_NATION = "SELECT id AS doc, name || ' ATA ' || ata AS x FROM nodes", "SELECT n_nationkey AS query_id, n_name || ' 05' AS query FROM nation"


def _searched(spark, d):
    return _nodes(spark, d).withColumn("code", F.concat(F.lit("ATA "), F.col("ata")))


@query(f"WITH {SQL_GRAPH}, {_sql_bm25(_NAMED, _BY_NATION, 8, ' HAVING round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) > 0.3')} SELECT query_id, doc, score, rank FROM bm25")
def keyword_search(spark, d):
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" 05")).alias("query"))
    return search.keyword_search(search.new_index(_searched(spark, d), "id", "name", "code"), asked).select("query_id", "doc", "score", "rank")


_EXPANDED = "SELECT n_nationkey::VARCHAR AS query_id, n_name || ' 05' AS query FROM nation UNION ALL SELECT n_nationkey || '|05', 'ATA 05' FROM nation"


@query(f"""WITH {SQL_GRAPH}, {_sql_bm25(_NAMED, _EXPANDED, 8, ' HAVING round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) > 0.3')},
x AS (SELECT string_split(query_id, '|')[1] AS query_id, doc, score, rank, CASE WHEN query_id LIKE '%|%' THEN 1 ELSE 0 END AS branch FROM bm25)
SELECT query_id, doc, score, branch::BIGINT AS branch FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY branch) AS rn FROM x WHERE branch = 0 OR rank <= 3) WHERE rn = 1""")
def keyword_expand_codes(spark, d):
    asked = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("query_id"), F.concat("n_name", F.lit(" 05")).alias("query"))
    return search.expand_codes(search.new_index(_searched(spark, d), "id", "name", "code"), asked).select("query_id", "doc", "score", "branch")


_OVERLAP = """ow AS (SELECT query_id, w, count(*) AS n FROM (SELECT conv_id || ':' || turn AS query_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM conversations WHERE role = 'user') WHERE length(w) > 4 GROUP BY ALL),
os AS (SELECT query_id, item_id AS id, CAST(sum(n) AS DOUBLE) AS score FROM benchmark JOIN ow ON contains(lower(text), w) GROUP BY ALL),
overlap AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM os) WHERE rank <= 2)"""


def _overlap(spark, d):
    communities = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("summary"))
    return search.community_overlap(communities, _questions(spark, d))


@query(f"WITH {_OVERLAP} SELECT query_id, id, score, rank FROM overlap")
def community_overlap(spark, d):
    return _overlap(spark, d)


SQL_PARTITION = "part AS (SELECT id AS node, CASE WHEN label = 'System' THEN id ELSE 'R' || (ata::INT % 5) END AS community FROM nodes)"


def _partition(spark, d):
    return _nodes(spark, d).select(F.col("id").alias("node"), F.when(F.col("label") == "System", F.col("id")).otherwise(F.concat(F.lit("R"), (F.col("ata").cast("int") % 5).cast("string"))).alias("community"))


@query(f"WITH {SQL_GRAPH}, {SQL_PARTITION} SELECT community, count(*) AS size, array_to_string(list_sort(list_distinct(list(ata) FILTER (ata <> '00'))), ',') AS chapters FROM part JOIN nodes ON node = id GROUP BY community HAVING count(*) >= 3")
def community_rollup(spark, d):
    return community.rollup(_partition(spark, d), _nodes(spark, d))


@query(f"WITH {SQL_GRAPH}, {SQL_PARTITION} SELECT community, count(*) AS size, array_to_string(list_sort(list(node))[1:50], ',') AS member_ids FROM part GROUP BY community")
def community_members(spark, d):
    return community.members(_partition(spark, d))


@query(f"""WITH {SQL_GRAPH}, {SQL_PARTITION}, t AS (SELECT community, label AS type, count(*) AS n, array_to_string(list_sort(list(name))[1:8], ', ') AS names FROM part JOIN nodes ON node = id GROUP BY ALL)
SELECT community, string_agg(type || 's (' || n || '): ' || names, chr(10) ORDER BY type) AS summary FROM t GROUP BY community""")
def community_summaries(spark, d):
    return community.described(_partition(spark, d), _nodes(spark, d).withColumnRenamed("label", "type"))


@query(f"""WITH {SQL_GRAPH}, {SQL_PARTITION}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src NOT LIKE 'C%'), e AS (SELECT x.community AS ca, y.community AS cb FROM p JOIN part x ON a = x.node JOIN part y ON b = y.node),
dg AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY c)
SELECT round((SELECT count(*) FILTER (ca = cb) / count(*)::DOUBLE FROM e) - (SELECT sum(d * d) FROM dg) / (4.0::DOUBLE * (SELECT count(*) FROM e) * (SELECT count(*) FROM e)), 6) AS q""")
def modularity_score(spark, d):
    return community.modularity(community.projection(_nodes(spark, d), _edges(spark, d)), _partition(spark, d))


def _projected(spark, d):
    return _nodes(spark, d).filter(~F.col("label").isin(PROJECTION_EXCLUDES)).select("id")


@query()
def louvain_partition(spark, d):
    return community.louvain(community.projection(_nodes(spark, d), _edges(spark, d)), nodes=_projected(spark, d))


@query()
def louvain_modularity(spark, d):
    pairs = community.projection(_nodes(spark, d), _edges(spark, d))
    return community.modularity(pairs, community.louvain(pairs))


# -- fusion and context

_FUSED = f"""{_sql_bm25(_DOCS, "SELECT conv_id || ':' || turn AS query_id, text AS query FROM conversations WHERE role = 'user'", 4)}, {_OVERLAP},
h AS (SELECT query_id, 'D' || doc AS id, score, rank, 'bm25' AS source, 0 AS branch FROM bm25 UNION ALL SELECT query_id, 'B' || id, score, rank, 'community', 1 FROM overlap),
fused AS (SELECT query_id, id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, branch, rank, id) AS place FROM h)"""


def _word_hits(spark, d):
    return search.bm25_topk(table(spark, d, "documents"), _questions(spark, d), "doc_id", "source", "text").select("query_id", F.concat(F.lit("D"), "doc").alias("id"), "score", "rank", F.lit("bm25").alias("source"))


def _hits(spark, d):
    return _word_hits(spark, d), _overlap(spark, d).select("query_id", F.concat(F.lit("B"), "id").alias("id"), "score", "rank", F.lit("community").alias("source"))


@query(f"WITH {_FUSED} SELECT query_id, id, score, source, place FROM fused")
def fused_hits(spark, d):
    return retrieval.fused(*_hits(spark, d)).select("query_id", "id", "score", "source", "place")


@query(f"WITH {_FUSED} SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM h GROUP BY query_id, id")
def reciprocal_rank_fusion(spark, d):
    return retrieval.reciprocal_fusion(*_hits(spark, d))


@query(f"WITH {_FUSED} SELECT query_id, id, score, place FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, id) AS place FROM h WHERE source = 'bm25')")
def baseline_hits(spark, d):
    return retrieval.fused(_word_hits(spark, d)).select("query_id", "id", "score", "place")


@query(f"WITH {_FUSED} SELECT query_id, count(*) FILTER (source = 'bm25') > 0 AS bm25_used, count(*) FILTER (source = 'community') > 0 AS community_used, count(*) < 3 AS fallback_used, count(DISTINCT id) AS found FROM h GROUP BY query_id")
def path_flags(spark, d):
    return retrieval.path_flags(retrieval.fused(*_hits(spark, d))).select("query_id", "bm25_used", "community_used", "fallback_used", "found")


def _lines(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") % 3).cast("long").alias("section"), F.col("turn").alias("place"), F.col("text").alias("line"))


def _sql_budget(budget: int) -> str:
    out, carry = [], "(SELECT DISTINCT query_id, 0::BIGINT AS carry FROM l)"
    for s, (share, head, mark) in enumerate(((0.45, 21, 19), (0.60, 22, 18), (1.0, 20, 18))):
        out.append(f"""k{s} AS (SELECT *, carry + {head} + coalesce(sum(length(line)) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rn FROM l JOIN {carry} c USING (query_id) WHERE section = {s}),
r{s} AS (SELECT * FROM k{s} WHERE rn = 1 OR prior <= {budget} * {share}::DOUBLE), s{s} AS (SELECT query_id, max(prior + length(line)) AS total, max(place) AS last FROM r{s} GROUP BY query_id),
c{s} AS (SELECT c.query_id, CAST(coalesce(total + CASE WHEN total > {budget} * {share}::DOUBLE THEN {mark} ELSE 0 END, carry) AS BIGINT) AS carry FROM {carry} c LEFT JOIN s{s} USING (query_id))""")
        carry = f"c{s}"
    return ", ".join(out)


@query(f"WITH l AS (SELECT conv_id AS query_id, turn % 3 AS section, turn AS place, text AS line FROM conversations), {_sql_budget(2000)} SELECT query_id, section, place FROM r0 UNION ALL SELECT query_id, section, place FROM r1 UNION ALL SELECT query_id, section, place FROM r2")
def context_budget(spark, d):
    rows, lines = retrieval.within_budget(_lines(spark, d), 2000), _lines(spark, d).select("query_id", "section", "place")
    return rows.select("query_id", "section", "place").join(lines, ["query_id", "section", "place"], "left_semi")


_HEADS = ["'=== GRAPH CONTEXT ==='", "chr(10) || '=== RELATIONSHIPS ==='", "chr(10) || '=== MANUAL TEXT ==='"]
_MARKS = ["'... (graph trimmed)'", "'... (rels trimmed)'", "'... (text trimmed)'"]
_CONTEXT = " UNION ALL ".join(f"SELECT query_id, {k} AS section, place, line FROM r{k} UNION ALL SELECT query_id, {k}, -1, {_HEADS[k]} FROM s{k} UNION ALL SELECT query_id, {k}, last + 1, {_MARKS[k]} FROM s{k} WHERE total > 2000 * {share}::DOUBLE" for k, share in enumerate((0.45, 0.6, 1.0)))


@query(f"WITH l AS (SELECT conv_id AS query_id, turn % 3 AS section, turn AS place, text AS line FROM conversations), {_sql_budget(2000)}, a AS ({_CONTEXT}) SELECT query_id, string_agg(line, chr(10) ORDER BY section, place) AS context FROM a GROUP BY query_id")
def context_text(spark, d):
    return retrieval.context_text(retrieval.within_budget(_lines(spark, d), 2000))


@query("SELECT query_id, rank, snippet FROM (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, trim(role || chr(10) || trim(text)) AS snippet FROM conversations WHERE trim(text) <> '') WHERE rank <= 5")
def snippets(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.col("turn").alias("place"), F.col("role").alias("title"), "text")
    return retrieval.snippets(rows).select("query_id", "rank", "snippet")


# -- evaluation: events stand for answered questions

_HITS = "(CASE WHEN contains(lower(props), '1') THEN 1 ELSE 0 END + CASE WHEN contains(lower(props), 'k') THEN 1 ELSE 0 END + CASE WHEN contains(lower(props), '7') THEN 1 ELSE 0 END)::DOUBLE / 3"
SQL_EVAL = f"ev AS (SELECT event_id AS id, event_type AS mode, value * 100 AS total_ms, value * 60 + user_id AS llm_ms, CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE '' END AS error, {sql_round_even(_HITS, 3)} AS keyword_recall FROM events)"


def _answers(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("mode"), F.col("props").alias("answer"), F.array(F.lit("1"), F.lit("K"), F.lit("7")).alias("keywords"), (F.col("value") * 100).alias("total_ms"), (F.col("value") * 60 + F.col("user_id")).alias("llm_ms"), F.when(F.col("user_id") % 7 == 0, "failed").otherwise("").alias("error"))
    return evaluation.evaluated(rows)


@query(f"WITH {SQL_EVAL} SELECT id, keyword_recall, greatest(total_ms - llm_ms, 0.0::DOUBLE) AS retrieval_ms FROM ev")
def keyword_recall(spark, d):
    return _answers(spark, d).select("id", "keyword_recall", "retrieval_ms")


_SUMMARY = f"""sr AS (SELECT mode, count(*) AS queries_total, count(*) FILTER (error = '') AS queries_successful, count(*) FILTER (error <> '') AS queries_failed, median(total_ms) FILTER (error = '') AS r50, avg(total_ms) FILTER (error = '') AS ravg, avg(keyword_recall) FILTER (error = '') AS rkeep FROM ev GROUP BY mode),
sm AS (SELECT mode, queries_total, queries_successful, queries_failed, coalesce({sql_round_even('r50', 1)}, 0) AS total_ms_p50, coalesce({sql_round_even('ravg', 1)}, 0) AS total_ms_avg, coalesce({sql_round_even('rkeep', 3)}, 0) AS keyword_recall_avg FROM sr)"""


@query(f"WITH {SQL_EVAL}, {_SUMMARY} SELECT * FROM sm")
def eval_summary(spark, d):
    return evaluation.summarised(_answers(spark, d))


@query(f"WITH {SQL_EVAL}, {_SUMMARY} SELECT {sql_round_even('o.keyword_recall_avg - b.keyword_recall_avg', 3)} AS absolute_gain, CASE WHEN b.keyword_recall_avg >= 1 THEN 0 ELSE {sql_round_even('(o.keyword_recall_avg - b.keyword_recall_avg) / (1 - b.keyword_recall_avg) * 100', 1)} END AS relative_gain_pct, {sql_round_even('o.total_ms_avg - b.total_ms_avg', 1)} AS latency_delta_ms FROM sm b, sm o WHERE b.mode = 'click' AND o.mode = 'view'")
def eval_comparison(spark, d):
    return evaluation.compared(evaluation.summarised(_answers(spark, d)), "click", "view")


@query(f"SELECT {sql_round_even('f', 3)} AS faithfulness, {sql_round_even('r', 3)} AS relevancy FROM (SELECT avg(CASE WHEN user_id % 5 <> 0 THEN value END) AS f, avg(CASE WHEN user_id < 0 THEN value END) AS r FROM events)")
def nullable_averages(spark, d):
    return evaluation.averages(table(spark, d, "events").select(F.when(F.col("user_id") % 5 != 0, F.col("value")).alias("faithfulness"), F.when(F.col("user_id") < 0, F.col("value")).alias("relevancy")), "faithfulness", "relevancy")


@query(f"WITH {SQL_EVAL} SELECT id, CAST(round(100 * greatest(total_ms - llm_ms, 0.0::DOUBLE) / greatest(1.0::DOUBLE, total_ms)) AS BIGINT) AS retrieval_pct, CASE WHEN total_ms >= 30000 THEN 'bad' WHEN total_ms >= 5000 THEN 'warn' ELSE 'ok' END AS band FROM ev")
def latency_shares(spark, d):
    return evaluation.latency_shares(_answers(spark, d))


# -- JSON, maps, resume

@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query()
def json_salvage(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit('```json\n{"relationships": ['), "props", F.lit('], "entities": ['), "props", F.lit(', {"id":')).alias("raw"))
    return rows.select("event_id", jsons.salvage(F.col("raw")).alias("document"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT vec_id AS id, CASE WHEN vec_id IN (SELECT p_partkey FROM part) THEN 'part' ELSE 'vector' END AS origin FROM embeddings UNION ALL SELECT p_partkey, 'part' FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)")
def map_union(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.struct(F.lit(0).alias("ord"), F.lit("vector").alias("origin")).alias("v"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.struct(F.lit(1).alias("ord"), F.lit("part").alias("origin")).alias("v"))
    return vectors.unionAll(parts).groupBy("id").agg(F.max("v")["origin"].alias("origin"))


@query("SELECT conv_id, turn, step, next_step FROM (SELECT conv_id, turn, 'STEP-' || conv_id || '-' || lpad(turn::VARCHAR, 3, '0') AS step, 'STEP-' || conv_id || '-' || lpad((lead(turn) OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR, 3, '0') AS next_step FROM conversations) WHERE next_step IS NOT NULL")
def precedes_steps(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.step_id(F.col("conv_id").cast("string"), F.col("turn")).alias("step"))
    return rows.withColumn("next_step", F.lead("step").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next_step is not null")


@query("SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'assistant') WHERE rn = 1")
def last_answer(spark, d):
    return ranking.first_by(table(spark, d, "conversations").filter("role = 'assistant'"), ["conv_id"], F.desc("turn")).select("conv_id", "text")


# -- models' stand-ins

@query("SELECT doc_id, 384 AS dim, CASE WHEN regexp_matches(lower(text), '[a-z0-9]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def encoded_documents(spark, d):
    rows = encoding.encode(table(spark, d, "documents"), "text", into="vector")
    return rows.select("doc_id", F.size("vector").alias("dim"), F.round(vector.dot(F.col("vector"), F.col("vector")), 4).alias("norm"))


_SQL_FOUND = r"""fd AS (SELECT {key} AS chunk_id, 'PartNumber' AS type, unnest(regexp_extract_all(text, '\b\d{{3,}}\s*[\-]\s*\d{{3,}}\b')) AS text, generate_subscripts(regexp_extract_all(text, '\b\d{{3,}}\s*[\-]\s*\d{{3,}}\b'), 1) - 1 AS ord FROM {rows}
UNION ALL SELECT {key}, 'Measurement', unnest(regexp_extract_all(text, '(?i)\b\d+(?:[.,]\d+)?\s*(?:Nm|N\.m|ft\.?lb|bar|psi|mm|cm|°[CF]|kPa)\b')), generate_subscripts(regexp_extract_all(text, '(?i)\b\d+(?:[.,]\d+)?\s*(?:Nm|N\.m|ft\.?lb|bar|psi|mm|cm|°[CF]|kPa)\b'), 1) - 1 FROM {rows}
UNION ALL SELECT {key}, 'Warning', unnest(regexp_extract_all(text, '(?i)\bWARNING\b[^.]*')), generate_subscripts(regexp_extract_all(text, '(?i)\bWARNING\b[^.]*'), 1) - 1 FROM {rows})"""


@query(f"WITH {SQL_CHUNKS}, {_SQL_FOUND.format(key='chunk_id', rows='chunks')} SELECT chunk_id, upper(type) || '-' || chunk_id || '-' || ord AS id, type, text, CAST(ord AS INTEGER) AS ord FROM fd")
def extracted_entities(spark, d):
    return encoding.extract(_chunks(spark, d))


@query("SELECT count(*) AS ok, 0::BIGINT AS failed, count(*) AS n_entities, count(*) FILTER (user_id % 2 = 0) AS n_relationships FROM events")
def extraction_counts(spark, d):
    """Events' properties stand for model results, some cut short."""
    raw = F.concat(F.lit('{"entities": [{"id": "E'), "event_id", F.lit('", "type": "Tool"}], "relationships": [{"from": "a", "to": "b"}'), F.when(F.col("user_id") % 2 == 0, "]}").otherwise(", {"))
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("chunk_id"), raw.alias("result"), F.lit(None).cast("string").alias("error"))
    return extraction.counts(extraction.parsed(rows))


def _artefacts(spark, d):
    nodes = _nodes(spark, d).withColumn("description", F.concat(F.lit("ATA "), F.col("ata")))
    chunks = _chunks(spark, d).select(F.col("chunk_id").alias("id"), "title", "text", "ata")
    return Artefacts(nodes, _edges(spark, d), chunks, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("summary")))


@query()
def hybrid_context(spark, d):
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" with the thing 05")).alias("query"))
    return retrieve(_artefacts(spark, d), asked)


@query()
def baseline_context(spark, d):
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" with the thing 05")).alias("query"))
    return retrieve(_artefacts(spark, d), asked, mode="baseline")


@query("SELECT n_nationkey AS id, round(CASE WHEN n_nationkey = 0 THEN 0 WHEN n_nationkey <= 6 THEN 1 ELSE 2 END * cos(CASE WHEN n_nationkey <= 6 THEN (n_nationkey - 1) / 6.0::DOUBLE ELSE (n_nationkey - 7) / 12.0::DOUBLE END * 2 * pi()), 6) + 0.0 AS x FROM nation")
def radial_layout(spark, d):
    rows = graph.radial_layout(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), "id")
    return rows.select("id", F.when(F.col("x") == 0, 0.0).otherwise(F.col("x")).alias("x"))


@query("SELECT event_id, 'total_ms' AS stage, value * 100 AS ms FROM events UNION ALL SELECT event_id, 'llm_ms', value * 60 FROM events")
def timing_entries(spark, d):
    """Entries of a timing map whose keys end in _ms."""
    timing = F.create_map(F.lit("total_ms"), F.col("value") * 100, F.lit("llm_ms"), F.col("value") * 60, F.lit("count"), F.lit(1.0))
    return table(spark, d, "events").select("event_id", F.explode(F.map_filter(timing, lambda k, v: F.endswith(k, F.lit("_ms")))).alias("stage", "ms"))


@query("SELECT conv_id, turn FROM conversations WHERE length(text) BETWEEN 1 AND 300")
def valid_requests(spark, d):
    return table(spark, d, "conversations").filter(F.length("text").between(1, 300)).select("conv_id", "turn")


@query(f"WITH {SQL_GRAPH} SELECT DISTINCT label AS name, 'node' AS what FROM nodes UNION SELECT DISTINCT type, 'edge' FROM edges")
def legend_types(spark, d):
    return _nodes(spark, d).select(F.col("label").alias("name"), F.lit("node").alias("what")).unionAll(_edges(spark, d).select("type", F.lit("edge"))).distinct()


@query("SELECT a.user_id, a.n - b.n AS delta FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) a JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) b USING (user_id)")
def paired_modes(spark, d):
    """Rows of two modes, side by side by key."""
    by = lambda m, c: table(spark, d, "events").filter(F.col("event_type") == m).groupBy("user_id").agg(F.count("*").alias(c))
    return by("view", "a").join(by("click", "b"), "user_id").select("user_id", (F.col("a") - F.col("b")).alias("delta"))


# -- sections, communities and the whole build

SQL_SECTION_CHUNKS = "WITH c AS (SELECT 'K' || turn || '-' || conv_id AS chunk_id, 'S' || (conv_id % 7) AS section_id, role || conv_id AS section_title, lpad((conv_id % 12)::VARCHAR, 2, '0') AS ata, CAST(1 + conv_id % 3 AS INTEGER) AS level, conv_id * 1000 + turn AS global_seq, text FROM conversations)"


def _section_chunks(spark, d):
    conv = F.col("conv_id").cast("string")
    rows = table(spark, d, "conversations")
    return rows.select(F.concat(F.lit("K"), "turn", F.lit("-"), conv).alias("chunk_id"), F.concat(F.lit("S"), (F.col("conv_id") % 7).cast("string")).alias("section_id"), F.concat("role", conv).alias("section_title"), F.lpad((F.col("conv_id") % 12).cast("string"), 2, "0").alias("ata"), (1 + F.col("conv_id") % 3).cast("int").alias("level"), (F.col("conv_id") * 1000 + F.col("turn")).alias("global_seq"), "text")


_SQL_SECTIONS = "s AS (SELECT section_id AS id, min_by(section_title, global_seq) AS title, min_by(ata, global_seq) AS ata, min_by(level, global_seq) AS level FROM c GROUP BY section_id)"


@query(f"{SQL_SECTION_CHUNKS}, {_SQL_SECTIONS} SELECT id, title, ata, level FROM s")
def document_sections(spark, d):
    return sections.sections_of(_section_chunks(spark, d))


@query(f"{SQL_SECTION_CHUNKS} SELECT DISTINCT chunk_id AS src, section_id AS dst, 'PART_OF_SECTION' AS type FROM c WHERE section_id <> 'S3'")
def section_edges(spark, d):
    chunks = _section_chunks(spark, d)
    return sections.section_edges(chunks, sections.sections_of(chunks).filter("id <> 'S3'"))


def _embedded(spark, d):
    return table(spark, d, "embeddings").select(F.concat(F.lit("P"), "vec_id").alias("id"), "embedding")


@query("SELECT 'P' || p_partkey AS id, p_name AS name, e.embedding IS NOT NULL AS embedded, coalesce(len(e.embedding), 0) AS dim FROM part LEFT JOIN embeddings e ON p_partkey = vec_id")
def embedded_nodes(spark, d):
    rows = sections.with_embeddings(_parts(spark, d).select("id", "name"), _embedded(spark, d), "id")
    return rows.select("id", "name", F.col("embedding").isNotNull().alias("embedded"), F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("dim"))


@query("SELECT p_partkey, '[ATA ' || lpad((p_size % 100)::VARCHAR, 2, '0') || '] ' || p_name || chr(10) || p_type AS chunk_text, trim('[Component ATA-' || lpad((p_size % 100)::VARCHAR, 2, '0') || '] ' || p_name || '. ' || p_brand || ' ' || '') AS entity_text FROM part")
def embedding_texts(spark, d):
    ata = F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")
    return table(spark, d, "part").select("p_partkey", T.chunk_text(ata, F.col("p_name"), F.col("p_type")).alias("chunk_text"), F.trim(T.entity_text(F.lit("Component"), ata, F.col("p_name"), F.col("p_brand"), F.lit(""))).alias("entity_text"))


_SQL_COMMUNITIES = f"""kept AS (SELECT community, count(*) AS size, list_sort(list_distinct(list(ata) FILTER (ata <> '00'))) AS chapters FROM part JOIN nodes ON node = id GROUP BY community HAVING count(*) >= 3),
chapter_names AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in CHAPTERS.items())}) AS t(code, name)),
comm AS (SELECT 'COMM-' || lpad(place::VARCHAR, greatest(4, length(place::VARCHAR))::INT, '0') AS id, * FROM (SELECT row_number() OVER (ORDER BY size DESC, community) - 1 AS place, * FROM kept))"""


def _community_table(spark, d):
    return sections.community_table(_partition(spark, d), _nodes(spark, d))


@query(f"""WITH {SQL_GRAPH}, {SQL_PARTITION}, {_SQL_COMMUNITIES}, n AS (SELECT id, string_agg(coalesce(name, 'ATA ' || c), '|' ORDER BY c) AS names FROM (SELECT id, unnest(chapters[1:5]) AS c FROM comm) LEFT JOIN chapter_names ON c = code GROUP BY id)
SELECT comm.id, community, place, size, array_to_string(chapters, ',') AS chapters, coalesce(names, '') AS names, coalesce(chapters[1], '') AS first_chapter FROM comm LEFT JOIN n ON comm.id = n.id""")
def community_ranking(spark, d):
    rows = _community_table(spark, d)
    return rows.select("id", "community", "place", "size", F.array_join("ata_chapters", ",").alias("chapters"), F.array_join("ata_names", "|").alias("names"), sections.first_chapter(F.col("ata_chapters")).alias("first_chapter"))


@query(f"WITH {SQL_GRAPH}, {SQL_PARTITION}, {_SQL_COMMUNITIES} SELECT DISTINCT node AS src, comm.id AS dst, 'MEMBER_OF' AS type FROM part JOIN comm ON part.community = comm.community JOIN nodes ON node = nodes.id")
def member_edges(spark, d):
    return sections.member_edges(_partition(spark, d), _nodes(spark, d), _community_table(spark, d))


@query(f"WITH {SQL_GRAPH}, {SQL_PARTITION} SELECT (SELECT count(DISTINCT id) FROM nodes WHERE label <> 'Chunk') AS nodes, (SELECT count(*) FROM edges WHERE src NOT LIKE 'C%') AS edges, (SELECT count(DISTINCT community) FROM part) AS communities")
def projection_counts(spark, d):
    nodes = _nodes(spark, d)
    return sections.projection_counts(nodes, community.projection(nodes, _edges(spark, d)), _partition(spark, d), ["Chunk", "DocumentSection", "Measurement"])


def _built(spark, d):
    things = _resolved(spark, d).select("id", "type", F.col("norm_name").alias("name"), F.col("brand").alias("description"), F.lit("00").alias("ata"), "merged", "ord", F.array(F.lit("K0-0"), F.lit("K1-1")).alias("source_chunks"))
    rels = resolution.resolve_relationships(_rels(spark, d), _resolved(spark, d))
    return sections.build_graph(_section_chunks(spark, d), things, rels, _embedded(spark, d))


_SQL_BUILT_NODES = """bn AS (SELECT 'Chunk' AS label, chunk_id AS id, NULL AS name, NULL AS title, section_title, ata, nullif(text, '') AS text, section_id, NULL AS level, NULL AS description, NULL::BIGINT AS merged, NULL AS source_chunks, false AS embedded, global_seq FROM c
UNION ALL SELECT 'DocumentSection', id, NULL, title, NULL, ata, NULL, NULL, level::VARCHAR, NULL, NULL, NULL, false, NULL FROM s
UNION ALL SELECT 'Entity', id, norm_name, NULL, NULL, '00', NULL, NULL, NULL, brand, merged, 'K0-0,K1-1', id IN (SELECT 'P' || vec_id FROM embeddings), NULL FROM res)"""
_SQL_BUILT_EDGES = f"""{SQL_RELS}, be AS (SELECT chunk_id AS src, lead(chunk_id) OVER (ORDER BY global_seq) AS dst, 'ADJACENT_TO' AS type FROM c UNION SELECT chunk_id, section_id, 'PART_OF_SECTION' FROM c
UNION SELECT chunk_id, id, 'CONTAINS' FROM c, res WHERE chunk_id IN ('K0-0', 'K1-1') UNION SELECT rels.s, names.id, rels.type FROM rels JOIN res ON rels.s = res.id JOIN names ON names.norm_name = {SQL_DEDUP.format('rels.t')})"""
_NODE_COLUMNS = "label, id, name, title, section_title, ata, md5(text) AS text, section_id, level, description, merged::VARCHAR AS merged, source_chunks, embedded, global_seq::VARCHAR AS global_seq"


def _node_rows(nodes):
    return nodes.select("label", "id", "name", "title", "section_title", "ata", F.md5("text").alias("text"), "section_id", F.col("level").cast("string").alias("level"), "description", F.col("merged").cast("string").alias("merged"), "source_chunks", F.col("embedding").isNotNull().alias("embedded"), F.col("global_seq").cast("string").alias("global_seq"))


@query(f"{SQL_SECTION_CHUNKS}, {_SQL_SECTIONS}, {SQL_RESOLVED}, {_SQL_BUILT_NODES} SELECT {_NODE_COLUMNS} FROM bn")
def built_nodes(spark, d):
    """All nodes with all their properties."""
    return _node_rows(_built(spark, d)[0])


@query(f"{SQL_SECTION_CHUNKS}, {SQL_RESOLVED}, {_SQL_BUILT_EDGES} SELECT src, dst, type FROM be WHERE dst IS NOT NULL")
def built_edges(spark, d):
    return _built(spark, d)[1]


def _stored(spark, d):
    """The built graph stored, then brought up to date: tools that are renamed, one that is new, an edge from it and one to nowhere."""
    path = scratch_path(spark, "graph")
    nodes, edges = _built(spark, d)
    store.store_graph(nodes, edges, path, buckets=16)
    renamed = table(spark, d, "supplier").select(F.lit("Entity").alias("label"), F.concat(F.lit("P"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("renamed").alias("description"), F.col("s_suppkey").alias("ord"))
    ways = table(spark, d, "supplier").select(F.concat(F.lit("P"), "s_suppkey").alias("src"), F.lit("S1").alias("dst"), F.lit("LOCATED_IN").alias("type"))
    store.upsert_graph(path, renamed, ways.unionAll(ways.withColumn("dst", F.lit("nowhere"))))
    return store.open_graph(spark, path)


@query(f"""{SQL_SECTION_CHUNKS}, {_SQL_SECTIONS}, {SQL_RESOLVED}, {_SQL_BUILT_NODES}, sup AS (SELECT 'P' || s_suppkey AS sid, s_name FROM supplier),
st AS (SELECT * REPLACE (coalesce(s_name, name) AS name, CASE WHEN s_name IS NOT NULL THEN 'renamed' ELSE description END AS description) FROM bn LEFT JOIN sup ON label = 'Entity' AND id = sid
UNION ALL SELECT 'Entity', sid, s_name, NULL, NULL, NULL, NULL, NULL, NULL, 'renamed', NULL, NULL, false, NULL, sid, s_name FROM sup WHERE sid NOT IN (SELECT id FROM bn WHERE label = 'Entity'))
SELECT {_NODE_COLUMNS} FROM st""")
def stored_graph_nodes(spark, d):
    """The stored graph's nodes after a change, read back."""
    return _node_rows(_stored(spark, d)[0])


@query(f"{SQL_SECTION_CHUNKS}, {SQL_RESOLVED}, {_SQL_BUILT_EDGES} SELECT src, dst, type FROM be WHERE dst IS NOT NULL UNION SELECT 'P' || s_suppkey, 'S1', 'LOCATED_IN' FROM supplier")
def stored_graph_edges(spark, d):
    return _stored(spark, d)[1]


_SQL_GRAPH_TEXTS = "SELECT id AS doc, concat_ws(' ', id, name, title, description, text, ata) AS x FROM bn"
_SQL_GRAPH_ASKED = "SELECT n_nationkey AS query_id, n_name || ' the renamed 05 and Brand' AS query FROM nation"


@query(f"{SQL_SECTION_CHUNKS}, {_SQL_SECTIONS}, {SQL_RESOLVED}, {_SQL_BUILT_NODES}, {_sql_bm25(_SQL_GRAPH_TEXTS, _SQL_GRAPH_ASKED, 8)} SELECT query_id, doc, score, rank FROM bm25 WHERE score > 0.3")
def graph_keyword_search(spark, d):
    """Full-text search over the built graph: names, titles, descriptions and chunk texts."""
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" the renamed 05 and Brand")).alias("query"))
    held = search.new_index(_built(spark, d)[0], "id", *search.NODE_TEXTS)
    return search.keyword_search(held, asked).select("query_id", "doc", "score", "rank")


@query("SELECT p_partkey, CASE WHEN p_size = 0 THEN NULL ELSE array_to_string(list_transform(range(1, p_size + 1), lambda i: 'K' || i)[1:10], ',') END AS source_chunks FROM part")
def source_lists(spark, d):
    chunks = F.when(F.col("p_size") > 0, F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit("K"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", sections.source_list(chunks).alias("source_chunks"))


# -- ids and keys that the queries above leave out

SQL_ATA = "lpad(p_size::VARCHAR, greatest(2, length(p_size::VARCHAR))::INT, '0')"
SQL_SEQ = "lpad(p_partkey::VARCHAR, greatest(4, length(p_partkey::VARCHAR))::INT, '0')"


@query(f"""SELECT p_partkey, 'SYS-' || {SQL_ATA} || '-' || {SQL_NORM.format('p_type')} AS system_id, 'CONS-' || {SQL_NORM.format('p_name')} AS consumable_id, 'CAUT-' || {SQL_ATA} || '-' || {SQL_SEQ} AS caution_id,
  'NOTE-' || {SQL_ATA} || '-' || {SQL_SEQ} AS note_id, 'MEAS-' || {SQL_ATA} || '-' || p_type || '-' || {SQL_SEQ} AS measurement_id, 'TASK-' || {SQL_ATA} || '-10-00-' || {SQL_SEQ} AS task_id,
  'STEP-TASK-' || {SQL_ATA} || '-10-00-' || {SQL_SEQ} || '-' || lpad(p_size::VARCHAR, greatest(3, length(p_size::VARCHAR))::INT, '0') AS step_id, 'CHUNK-SEC-' || p_size || '-' || {SQL_SEQ} AS chunk_id FROM part""")
def more_ids(spark, d):
    ata, seq, name, kind = F.col("p_size").cast("string"), F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    task = T.task_id(ata, F.lit("10"), F.lit("0"), seq)
    return table(spark, d, "part").select("p_partkey", T.named("SYS", kind, ata).alias("system_id"), T.named("CONS", name).alias("consumable_id"), T.numbered("CAUT", ata, seq=seq).alias("caution_id"), T.numbered("NOTE", ata, seq=seq).alias("note_id"), T.numbered("MEAS", ata, kind, seq=seq).alias("measurement_id"), task.alias("task_id"), T.step_id(task, F.col("p_size")).alias("step_id"), T.chunk_node_id(F.concat(F.lit("SEC-"), ata), seq).alias("chunk_id"))


@query(f"SELECT p_partkey, 'measurement::' || {SQL_DEDUP.format('substr(p_name, 1, 60)')} || '-' || p_size || '-Nm' AS measurement_key, 'interval::' || {SQL_DEDUP.format('substr(p_type, 1, 60)')} AS interval_key, 'P' || p_partkey || '>' || p_brand || '>X' AS relationship_key FROM part")
def more_keys(spark, d):
    rel = T.relationship_key(F.concat(F.lit("P"), "p_partkey"), F.col("p_brand"), F.lit("X"))
    return table(spark, d, "part").select("p_partkey", T.measurement_key(F.col("p_name"), F.col("p_size").cast("string"), F.lit("Nm")).alias("measurement_key"), T.interval_key(F.col("p_type")).alias("interval_key"), F.concat_ws(">", rel["source"], rel["target"], rel["type"]).alias("relationship_key"))


# -- reports

@query("SELECT conv_id, turn, len(c[1:3]) AS kept, list_sum(list_transform(c[1:3], lambda x: least(length(x), 1200)))::BIGINT AS chars FROM (SELECT conv_id, turn, [text, role, text || text, role] AS c FROM conversations)")
def judged_contexts(spark, d):
    kept = reports.decoded_contexts(reports.encoded_contexts(reports.clipped_contexts(F.array("text", "role", F.concat("text", "text"), "role"))))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(kept).cast("long").alias("kept"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(f"WITH {SQL_EVAL}, r AS (SELECT id, mode, total_ms, keyword_recall, NULL AS answer_chars FROM ev WHERE mode = 'view' UNION ALL SELECT id, mode, total_ms, keyword_recall, length(props)::BIGINT FROM ev JOIN events ON id = event_id WHERE mode = 'click') SELECT id, mode, total_ms, keyword_recall, coalesce(answer_chars, -1) AS answer_chars FROM r")
def evaluation_rows(spark, d):
    rows = _answers(spark, d)
    pick = lambda m, *more: rows.filter(F.col("mode") == m).select("id", "mode", "total_ms", "keyword_recall", *more)
    return reports.evaluation_rows(pick("view"), pick("click", "answer_chars")).withColumn("answer_chars", F.coalesce("answer_chars", F.lit(-1).cast("long")))


@query(f"WITH {SQL_EVAL}, {_SUMMARY} SELECT mode, queries_total AS total, total_ms_avg, keyword_recall_avg AS recall, '2024-01-02 03:04:05' AS generated_at FROM sm")
def report_documents(spark, d):
    docs = reports.report(evaluation.summarised(_answers(spark, d)), "mode", stamp=F.lit("2024-01-02 03:04:05").cast("timestamp"))
    back = F.from_json("document", "queries_total long, total_ms_avg double, keyword_recall_avg double, generated_at string")
    return docs.select("mode", back.alias("x")).select("mode", F.col("x.queries_total").alias("total"), "x.total_ms_avg", F.col("x.keyword_recall_avg").alias("recall"), "x.generated_at")


@query(f"WITH {SQL_EVAL} SELECT id, 'retrieval_ms' AS series, greatest(total_ms - llm_ms, 0.0::DOUBLE) AS value FROM ev UNION ALL SELECT id, 'llm_ms', llm_ms FROM ev")
def plotted_latency(spark, d):
    return reports.plotted(_answers(spark, d), "id", "retrieval_ms", "llm_ms")


@query("SELECT type, n, row_number() OVER (ORDER BY n DESC, type) AS place FROM (SELECT p_type AS type, count(*) AS n FROM part GROUP BY p_type)")
def type_report(spark, d):
    return reports.by_count(resolution.type_counts(_parts(spark, d)))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(regexp_replace(lower(role || ' the of'), '[^a-z0-9]', ' ', 'g'), ' +'), lambda w: w <> '')) AS q, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +'), lambda w: w <> '')) AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN NULL ELSE 1.0::DOUBLE END AS faithfulness, round(len(list_intersect(q, a)) / len(q)::DOUBLE, 3) AS answer_relevancy, CASE WHEN len(list_intersect(q, a)) > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS context_precision FROM t""")
def judged_metrics(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(" the of")).alias("query"), F.col("text").alias("answer"), F.array("text", F.lit("of")).alias("contexts"))
    return reports.judged(rows).select("conv_id", "turn", "faithfulness", "answer_relevancy", "context_precision")


@query(r"SELECT page_id, regexp_replace(trim(url), '/+$', '') AS base, 'https://' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+$', '') AS bare, substr(url, 1, 8) || '...' || right(url, 4) AS mark, url AS key FROM pages")
def web_addresses(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", reports.base_url(F.concat(F.lit(" "), url, F.lit("/ "))).alias("base"), reports.base_url(F.regexp_replace(url, "^[a-z]+://", "")).alias("bare"), reports.fingerprint(url).alias("mark"), reports.unquoted(F.concat(F.lit(' "'), url, F.lit('"'))).alias("key"))


@query(r"""WITH l AS (SELECT conv_id, turn, i - 1 AS place, trim(x[i]) AS line FROM (SELECT conv_id, turn, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT conv_id, turn, string_split('# ' || role || chr(10) || '- ' || text || chr(10) || chr(10) || '2. ' || role || chr(10) || text, chr(10)) AS x FROM conversations)))
SELECT conv_id, turn, place, CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(line, '^[-*•]\s') THEN 'bullet' WHEN regexp_matches(line, '^\d+[.)]\s') THEN 'numbered' ELSE 'paragraph' END AS kind, regexp_replace(line, '^(#{1,6}|[-*•]|\d+[.)])\s+', '') AS body FROM l WHERE length(line) > 0""")
def answer_blocks(spark, d):
    text = F.concat(F.lit("# "), "role", F.lit("\n- "), "text", F.lit("\n\n2. "), "role", F.lit("\n"), "text")
    return reports.blocks(table(spark, d, "conversations").select("conv_id", "turn", text.alias("t")), "t").select("conv_id", "turn", "place", "kind", "body")


@query("SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 50)) AS confidence, CAST(floor(length(props) / 4) AS BIGINT) AS tokens FROM events")
def clamped_confidence(spark, d):
    return table(spark, d, "events").select("event_id", reports.clamped(F.col("value") / 50).alias("confidence"), reports.token_estimate(F.col("props")).alias("tokens"))


# -- documents read from files: each conversation is a file, each turn a page, some turns under a heading

_SQL_FILES = r"""t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page_idx, count(*) OVER (PARTITION BY conv_id) AS n_pages, conv_id % 3 <> 0 AND turn % 2 = 1 AS headed, 1 + turn % 3 AS level, role || ' ' || lpad((turn % 90)::VARCHAR, 2, '0') AS title,
  regexp_replace(text, '[#\f]', '', 'g') AS body FROM conversations),
pages AS (SELECT conv_id, page_idx, n_pages, regexp_replace(CASE WHEN page_idx = 0 THEN 'conv ' || conv_id || chr(10) ELSE '' END || CASE WHEN headed THEN repeat('#', level::INT) || ' ' || title || chr(10) ELSE '' END || body, '^\s+|\s+$', '', 'g') AS text FROM t),
toc AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY page_idx) - 1 AS idx, level, title, page_idx + 1 AS page_1, n_pages FROM t WHERE headed
  UNION ALL SELECT conv_id, 0, 1, 'Main Content', 1, max(n_pages) FROM t GROUP BY conv_id HAVING NOT bool_or(headed)),
nx AS (SELECT a.conv_id, a.idx, min_by(b.page_1, b.idx) AS p FROM toc a JOIN toc b ON a.conv_id = b.conv_id AND b.idx > a.idx AND b.level <= a.level GROUP BY a.conv_id, a.idx),
sec AS (SELECT toc.conv_id, toc.idx, level, title, page_1 - 1 AS page_start, CASE WHEN p IS NULL THEN n_pages - 1 ELSE greatest(0, p - 2) END AS page_end FROM toc LEFT JOIN nx ON toc.conv_id = nx.conv_id AND toc.idx = nx.idx)"""


@query(rf"""WITH {_SQL_FILES}, own AS (SELECT pages.conv_id, page_idx, max_by(sec.idx, level * 1000 - sec.idx) AS idx FROM pages JOIN sec ON pages.conv_id = sec.conv_id AND page_idx BETWEEN page_start AND page_end GROUP BY ALL)
SELECT pages.conv_id, pages.page_idx, md5(text) AS digest, printf('SEC-%04d', sec.idx + 1) AS id, level, title, CASE WHEN regexp_matches(title, '\b\d{{2}}\b') THEN regexp_extract(title, '\b(\d{{2}})\b', 1) ELSE '00' END AS ata, page_start, page_end
FROM pages LEFT JOIN own ON pages.conv_id = own.conv_id AND pages.page_idx = own.page_idx JOIN sec ON sec.conv_id = pages.conv_id AND sec.idx = coalesce(own.idx, 0) WHERE text <> ''""")
def paged_documents(spark, d):
    """Conversations written as files of pages, read back through the data source with the section of each page."""
    path = scratch_path(spark, "paged")
    turn = F.struct("turn", F.concat(F.when((F.col("conv_id") % 3 != 0) & (F.col("turn") % 2 == 1), F.concat(F.expr("repeat('#', cast(1 + turn % 3 as int))"), F.lit(" "), "role", F.lit(" "), F.lpad((F.col("turn") % 90).cast("string"), 2, "0"), F.lit("\n"))).otherwise(F.lit("")), F.regexp_replace("text", r"[#\f]", "")).alias("page"))
    files = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["page"]), "\f").alias("pages"))
    documents.write_documents(files.select(F.concat("conv_id", F.lit(".txt")).alias("name"), F.concat(F.lit("conv "), "conv_id", F.lit("\n"), "pages", F.lit("\n")).alias("text")), path)
    rows = settled(documents.sections_read(spark, path, "*.txt"))
    named = rows.filter("page_idx = 0").select("path", F.regexp_extract("text", r"^conv (\d+)", 1).cast("long").alias("conv_id"))
    return rows.join(named, "path").select("conv_id", F.col("page_idx").cast("long").alias("page_idx"), F.md5("text").alias("digest"), "id", F.col("level").cast("long").alias("level"), "title", "ata", "page_start", "page_end")


# -- numbers, validated loads, streams

@query(f"SELECT event_id, {sql_round_even('value', 1)} AS p1, {sql_round_even('value / 3', 2)} AS p2, {sql_round_even('value / 80', 3)} AS p3, {sql_round_even('-value / 8', 0)} AS p0 FROM events")
def rounded_values(spark, d):
    """Rounding to the nearest decimal of the exact value, halves to even."""
    v = F.col("value")
    return table(spark, d, "events").select("event_id", round_even(v, 1).alias("p1"), round_even(v / 3, 2).alias("p2"), round_even(v / 80, 3).alias("p3"), round_even(-v / 8, 0).alias("p0"))


_SQL_ITEMS = """ev AS (SELECT event_id::VARCHAR AS chunk_id, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'E' || event_id END AS id, CASE WHEN event_type = 'view' THEN 'Tool' WHEN event_type = 'click' THEN 'Gadget' END AS etype, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'b' END AS dst, CASE WHEN event_type = 'view' THEN 'uses-part' WHEN event_type = 'click' THEN 'made up' END AS rtype, value / 100 AS sure FROM events),
items AS (SELECT chunk_id, 'entities' AS what, CASE WHEN id = '' THEN 'no id' WHEN etype IS DISTINCT FROM 'Tool' THEN 'unknown type' END AS reason FROM ev
UNION ALL SELECT chunk_id, 'relationships', CASE WHEN dst = '' THEN 'no target' WHEN rtype IS DISTINCT FROM 'uses-part' THEN 'unknown type' WHEN NOT sure BETWEEN 0 AND 1 THEN 'confidence out of range' END FROM ev)"""


def _validated(spark, d):
    """Events stand for model results of one entity and one relationship each."""
    text = lambda c: c.cast("string")
    kind = lambda a, b: F.when(F.col("event_type") == "view", a).when(F.col("event_type") == "click", b)
    none = F.lit(None).cast("string")
    entity = F.struct(F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("E"), "event_id")).alias("id"), kind("Tool", "Gadget").alias("type"), text(F.col("props")).alias("name"))
    way = F.struct(F.lit("a").alias("from"), none.alias("to"), none.alias("source"), F.when(F.col("user_id") % 4 == 0, "").otherwise("b").alias("target"), kind("uses-part", "made up").alias("type"), (F.col("value") / 100).alias("confidence"))
    rows = table(spark, d, "events").select(text(F.col("event_id")).alias("chunk_id"), F.struct(F.array(entity).alias("entities"), F.array(way).alias("relationships")).alias("parsed"))
    return extraction.validated_load(rows, scratch_path(spark, "validated"))


@query(f"WITH {_SQL_ITEMS} SELECT chunk_id, what, coalesce(reason, 'valid') AS reason FROM items")
def validated_items(spark, d):
    """What was loaded and what was set aside, and why."""
    good, bad, _ = _validated(spark, d)
    return good.select("chunk_id", "what", F.lit("valid").alias("reason")).unionAll(bad.select("chunk_id", "what", "reason"))


@query(f"WITH {_SQL_ITEMS} SELECT count(*) FILTER (what = 'entities' AND reason IS NULL) AS entities_valid, count(*) FILTER (what = 'entities' AND reason IS NOT NULL) AS entities_quarantine, count(*) FILTER (what = 'relationships' AND reason IS NULL) AS relationships_valid, count(*) FILTER (what = 'relationships' AND reason IS NOT NULL) AS relationships_quarantine, count(*) AS items FROM items")
def validated_counts(spark, d):
    """The counters of the same load, as it saw them."""
    counts = _validated(spark, d)[2]
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


@query(f"WITH {_SQL_FOUND.format(key='doc_id::VARCHAR', rows='documents')} SELECT chunk_id, upper(type) || '-' || chunk_id || '-' || ord AS id, type, text, CAST(ord AS INTEGER) AS ord FROM fd")
def streamed_extraction(spark, d):
    """Documents through the extraction stream: run, run again from its checkpoint, and from a new one over the same rows."""
    path = scratch_path(spark, "streamed")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    rows.write.parquet(f"{path}/in")
    for state in ("first", "first", "second"):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
        progress.extraction_stream(stream, f"{path}/out", f"{path}/{state}").awaitTermination()
    return progress.results(spark, f"{path}/out")


_SQL_CONTEXT = f"""{_sql_bm25("SELECT id AS doc, name || ' ATA ' || ata || ' ' || ata AS x FROM nodes", _EXPANDED, 8)},
fx AS (SELECT string_split(query_id, '|')[1] AS query_id, doc, rank, CASE WHEN query_id LIKE '%|%' THEN 1 ELSE 0 END AS branch FROM bm25 WHERE score > 0.3),
fh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY branch) AS rn FROM fx WHERE branch = 0 OR rank <= 3) WHERE rn = 1),
fr AS (SELECT * FROM (SELECT query_id, doc AS root, row_number() OVER (PARTITION BY query_id ORDER BY branch, rank, doc) AS pl FROM fh) WHERE pl <= 6),
ways AS (SELECT src || '>' || type || '>' || dst AS e, src AS a, dst AS b FROM edges UNION ALL SELECT src || '>' || type || '>' || dst, dst, src FROM edges),
f1 AS (SELECT root, b AS node, e AS e1 FROM (SELECT DISTINCT root FROM fr) JOIN ways ON root = a), f2 AS (SELECT root, b AS node FROM f1 JOIN ways ON node = a WHERE e <> e1),
near AS (SELECT DISTINCT root, node FROM (SELECT root, node FROM f1 UNION ALL SELECT root, node FROM f2) JOIN nodes ON node = id WHERE label <> 'Chunk'),
cand AS (SELECT query_id, root AS node, pl * 2 AS ord FROM fr UNION ALL SELECT query_id, node, pl * 2 + 1 FROM fr JOIN near ON fr.root = near.root),
best AS (SELECT query_id, node, min(ord) AS ord FROM cand GROUP BY ALL),
rk AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY CASE label WHEN 'Component' THEN 0.80 WHEN 'System' THEN 0.75 WHEN 'Tool' THEN 0.65 ELSE 0.50 END DESC, ord, node) AS place FROM best JOIN nodes ON node = id)"""


@query(f"WITH {SQL_GRAPH}, {_SQL_CONTEXT} SELECT query_id, string_agg(node, ',' ORDER BY place) FILTER (place <= 8) AS entities, count(*) AS entities_found FROM rk GROUP BY query_id")
def first_entities(spark, d):
    """The first eight nodes of each question's graph context, and how many there are."""
    asked = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("query_id"), F.concat("n_name", F.lit(" 05")).alias("query"))
    nodes, _ = graph_hits(_artefacts(spark, d), asked)
    return context_entities(nodes).select("query_id", F.array_join("entities", ",").alias("entities"), "entities_found")


@query("SELECT p_partkey, CASE WHEN length(n) > 16 THEN substr(n, 1, 15) || '…' ELSE n END AS label FROM (SELECT p_partkey, replace(p_name || '_' || p_brand, '_', ' ') AS n FROM part)")
def short_labels(spark, d):
    """Labels of drawn nodes."""
    return table(spark, d, "part").select("p_partkey", T.short_label(F.concat_ws("_", "p_name", "p_brand")).alias("label"))


@query("SELECT conv_id, turn, 'text,bold,text,code' AS kinds, role AS bold, 'c' || turn AS code FROM conversations")
def answer_spans(spark, d):
    """Bold, code and plain parts of an answer's line."""
    line = F.concat(F.lit("see **"), "role", F.lit("** or `c"), "turn", F.lit("`"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", reports.spans(line).alias("s"))
    return rows.select("conv_id", "turn", F.array_join("s.kind", ",").alias("kinds"), F.col("s.text")[1].alias("bold"), F.col("s.text")[3].alias("code"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name || ',,' || p_type || ',', ','), lambda x: x <> ''), '|') AS parts FROM part")
def split_lists(spark, d):
    """Comma-joined lists as arrays, without empty parts."""
    return table(spark, d, "part").select("p_partkey", F.array_join(jsons.split_list(F.concat("p_name", F.lit(",,"), "p_type", F.lit(","))), "|").alias("parts"))
