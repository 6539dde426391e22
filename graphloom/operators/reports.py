"""What leaves the engine: report documents, plotted frames, judged metrics, web texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T

EVAL_COLUMNS = ["id", "query", "mode", "total_ms", "llm_ms", "retrieval_ms", "answer_chars", "keyword_recall", "error"]


def evaluation_rows(*modes: DataFrame) -> DataFrame:
    """Rows of all modes in one table; a column that one lacks is null there."""
    out = modes[0]
    for rows in modes[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def report(rows: DataFrame, *keys: str, stamp: Column | None = None) -> DataFrame:
    """(keys, document): each row's other columns as one JSON object, with generated_at if a stamp is given."""
    body = [F.col(c) for c in rows.columns if c not in keys]
    at = [F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("generated_at")] if stamp is not None else []
    return rows.select(*keys, F.to_json(F.struct(*body, *at)).alias("document"))


def plotted(rows: DataFrame, key: str, *series: str) -> DataFrame:
    """(key, series, value): what a stacked or grouped bar chart draws, in long form."""
    return rows.select(key, F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in series]), F.array(*[F.col(s).cast("double") for s in series]))).alias("series", "value"))


def clipped_contexts(contexts: Column, most: int = 3, chars: int = 1200) -> Column:
    """The first most texts, each of chars characters at most."""
    return F.transform(F.slice(contexts, 1, most), lambda x: F.substring(x, 1, chars))


def encoded_contexts(contexts: Column) -> Column:
    return F.to_json(contexts)


def decoded_contexts(text: Column) -> Column:
    """Texts of a JSON array; none where it can't be read."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def judged(rows: DataFrame, judges: dict[str, Callable[[str, str, list[str]], float | None]] | None = None) -> DataFrame:
    """rows (query, answer, contexts) with a nullable score a metric. judges: functions that may fail, which gives null.

    Without judges, shares of words: of the answer's in the contexts (faithfulness), of the query's in the answer
    (answer_relevancy), and of contexts that hold one of the query's words (context_precision); null where there is
    nothing to share out."""
    if judges is None:
        query, answer = F.array_distinct(T.search_tokens(F.col("query"))), F.array_distinct(T.search_tokens(F.col("answer")))
        held = F.array_distinct(T.search_tokens(F.array_join("contexts", " ")))
        share = lambda a, b: F.round(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a)), 3)
        hit = F.size(F.filter("contexts", lambda c: F.arrays_overlap(T.search_tokens(c), query))).cast("double")
        return rows.withColumns({"faithfulness": share(answer, held), "answer_relevancy": share(query, answer), "context_precision": F.round(F.try_divide(hit, F.size("contexts")), 3)})

    def safe(judge):
        @F.pandas_udf("double")
        def run(query: pd.Series, answer: pd.Series, contexts: pd.Series) -> pd.Series:
            def one(q, a, c):
                try:
                    return judge(q, a, list(c))
                except Exception:  # a judge that fails scores nothing
                    return None

            return pd.Series([one(*x) for x in zip(query, answer, contexts, strict=True)], dtype="float64")

        return run

    return rows.withColumns({name: safe(judge)(F.col("query"), F.col("answer"), clipped_contexts(F.col("contexts"))) for name, judge in judges.items()})


def by_count(counts: DataFrame, key: str = "type", n: str = "n") -> DataFrame:
    """counts with their place, the most frequent first, ties by key."""
    from graphloom.operators.ranking import numbered

    return numbered(counts.withColumn("_order", -F.col(n)), "_order", key, into="place", start=1).drop("_order")


# The address that is asked where none is set, and how blocks and spans of Markdown are told apart.
DEFAULT_URL = "http://localhost:8000"
HEADING, BULLET, NUMBERED = r"^#{1,6}\s", r"^[-*•]\s", r"^\d+[.)]\s"
BOLD, CODE = r"\*\*[^*]+\*\*", "`[^`]+`"


def base_url(x: Column, default: str = DEFAULT_URL) -> Column:
    """An address without white space around and slashes behind, with https:// where it names no scheme; default for null or empty."""
    bare = F.regexp_replace(F.trim(F.coalesce(T.truthy(x), F.lit(default))), "/+$", "")
    return F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def unquoted(x: Column) -> Column:
    """A key without white space and one pair of quotes around it."""
    bare = F.trim(x)
    paired = bare.rlike("""(?s)^(".*"|'.*')$""") & (F.length(bare) > 1)
    return F.when(paired, F.trim(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)


def fingerprint(key: Column) -> Column:
    """What may be logged of a key: its first eight and last four characters."""
    return F.concat(F.substring(key, 1, 8), F.lit("..."), F.right(key, F.lit(4)))


def blocks(rows: DataFrame, text: str) -> DataFrame:
    """rows with place, kind (heading, bullet, numbered, paragraph) and body of every line that is not blank of a Markdown text."""
    line = F.trim(F.col("line"))
    kind = F.when(line.rlike(HEADING), "heading").when(line.rlike(BULLET), "bullet").when(line.rlike(NUMBERED), "numbered").otherwise("paragraph")
    lines = rows.select("*", F.posexplode(F.split(text, "\n")).alias("place", "line")).filter(F.length(line) > 0)
    return lines.select(*rows.columns, F.col("place").cast("long").alias("place"), kind.alias("kind"), F.regexp_replace(line, r"^(#{1,6}|[-*•]|\d+[.)])\s+", "").alias("body"))


def spans(line: Column) -> Column:
    """Structs (kind, text) of a line's **bold**, `code` and plain parts."""
    parts = F.filter(F.regexp_extract_all(line, F.lit(f"{BOLD}|{CODE}|(?:(?!{BOLD}|{CODE}).)+"), F.lit(0)), lambda x: x != "")
    bold, code = lambda x: x.rlike(f"^{BOLD}$"), lambda x: x.rlike(f"^{CODE}$")
    return F.transform(parts, lambda x: F.struct(F.when(bold(x), "bold").when(code(x), "code").otherwise("text").alias("kind"), F.when(bold(x), F.substring(x, F.lit(3), F.length(x) - 4)).when(code(x), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x).alias("text")))


def clamped(x: Column) -> Column:
    """A confidence within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def token_estimate(x: Column) -> Column:
    """About how many tokens a text has: a quarter of its characters."""
    return F.floor(F.length(x) / 4)
