"""Quality rules from how often lines recur over the documents of a host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, table

BLANK = " \t\n\x0b\f\r"
_GAP = r"[\x20\x09-\x0D]+"
_WINDOW = 5
SALTS = 16


def _split_words(text: Column) -> Column:
    """Runs without ASCII white space; none for a text without any."""
    bare = F.btrim(text, F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP))


def base_figures(documents: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Of every row: row_id, doc_id, host, the figures of the base rules, and its lines as (hash, words).

    Windows of five words are compared by 64-bit hashes. All steps work inside a row: windows are hashed by
    zipping the words with themselves, and only a text with a repeated window is sorted to find which words these cover."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("t"))
    rows = rows.select("row_id", "doc_id", "host", _split_words(F.col("t")).alias("w"), F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.length(F.regexp_replace("t", _GAP, "")).cast("long").alias("word_chars"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "").alias("l"))
    rows = rows.withColumn("h", F.when(F.size("w") < _WINDOW, F.array().cast("array<bigint>")).otherwise(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.xxhash64(a, b))))
    rows = rows.withColumn("h", F.zip_with("h", F.slice("h", F.lit(3), F.size("h")), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("h", F.slice(F.zip_with("h", F.slice("w", F.lit(_WINDOW), F.size("w")), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size("w") - (_WINDOW - 1), F.lit(0))))
    again = F.size(F.array_distinct("h")) < F.size("h")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("s", F.when(again, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    rows = rows.withColumn("s", F.array_sort(F.transform(F.filter(F.transform("s", lambda x, k: F.struct(x["i"].alias("i"), ((F.get("s", k - 1)["h"] == x["h"]) | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False))).alias("twice"))), lambda x: F.coalesce(x["twice"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.zip_with("s", F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.least(F.lit(_WINDOW), F.coalesce(b - a, F.lit(_WINDOW))).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    lines = F.transform("l", lambda x: F.struct(F.xxhash64(F.lower(F.regexp_replace(F.btrim(x, F.lit(BLANK)), _GAP, " "))).alias("h"), F.size(_split_words(x)).alias("n")))
    return rows.select("row_id", "doc_id", "host", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"), lines.alias("lines"))


def line_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 5, max_share: float = 0.04, min_words: int = 10, min_left: float = 0.5) -> DataFrame:
    """Every row with its base figures, removed_words and kept.

    Lines are normalised (trimmed, white space to one space, lower case) and hashed; a line that more than the
    share max_share of a host's documents hold is removed from all of them, whatever the host's size, unless no
    more than min_docs hold it, too few to tell. Lines above the limit, few a host, are joined in salted parts, so that
    a common line of a large host is spread over tasks. A document is rejected if the base rules fail it, or if fewer than min_words words or less than
    the share min_left of its words are left. Whole texts count; null texts are empty, null hosts are one host of their
    own; repeated rows are documents of their own; other columns are not read; an empty table gives no rows."""
    rows, _ = materialise(base_figures(documents, id_col, text_col, host_col), "lines")
    met = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    often = met.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    above = often.join(hosts, "host").filter(F.col("n") > F.lit(max_share) * F.col("docs")).select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int").alias("salt")
    removed = rows.select("row_id", "host", salt, F.explode("lines").alias("x")).select("row_id", "host", "salt", "x.h", "x.n").join(above, ["host", "h", "salt"]).groupBy("row_id").agg(F.sum("n").alias("removed"))
    rows = rows.drop("lines").join(removed, "row_id", "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= min_words) & (left >= F.lit(min_left) * F.col("n_words")))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the base rules and the line limits of their source."""
    return line_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), g AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT rid, CAST(sum(least(5, coalesce(j - i, 5))) AS BIGINT) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS j FROM twice) GROUP BY rid
), l AS (
  SELECT rid, host, x, lower(regexp_replace(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS x FROM d)
), l2 AS (
  SELECT * FROM l WHERE n > 0
), above AS (
  SELECT a.host, a.norm
  FROM (SELECT host, norm, count(DISTINCT rid) AS n FROM l2 GROUP BY host, norm) a
  JOIN (SELECT host, count(*) AS docs FROM d GROUP BY host) b ON a.host = b.host
  WHERE a.n > 5 AND a.n > 0.04::DOUBLE * b.docs
), removed AS (
  SELECT rid, CAST(sum(n) AS BIGINT) AS n FROM l2 JOIN above ON l2.host = above.host AND l2.norm = above.norm GROUP BY rid
), dups AS (
  SELECT rid, count(*) - count(DISTINCT x) AS n FROM l2 GROUP BY rid
), f AS (
  SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS gone
  FROM d JOIN w ON d.rid = w.rid LEFT JOIN covered ON d.rid = covered.rid LEFT JOIN removed ON d.rid = removed.rid LEFT JOIN dups ON d.rid = dups.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - gone >= 10 AND n_words - gone >= 0.5 * n_words AS kept
FROM f
"""
