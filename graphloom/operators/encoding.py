"""Stand-ins for models: a hashed text encoder, rule-based extraction, and where real ones plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T


def encode(rows: DataFrame, text: str, into: str = "embedding", dim: int = 384) -> DataFrame:
    """rows with a vector of hashed token counts, scaled to length 1; zeros for a text without tokens.

    Tokens are hashed by built-in functions; only their slots go to numpy, by the Arrow batch, to be counted."""
    slots = F.transform(T.search_tokens(F.col(text)), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))

    @F.pandas_udf("array<float>")
    def counted(part: pd.Series) -> pd.Series:
        def one(found) -> np.ndarray:
            counts = np.bincount(found, minlength=dim).astype(np.float32)
            norm = float(np.sqrt((counts**2).sum()))
            return counts / norm if norm else counts

        return part.map(one)

    return rows.withColumn(into, counted(slots))


def encode_with(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], into: str = "embedding", batch: int = 32) -> DataFrame:
    """rows with vectors of a model that load() returns, loaded once a task and asked batch by batch."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for low in range(0, len(texts), batch) for v in model(texts[low : low + batch])])

    return rows.withColumn(into, run(F.col(text)))


def extract(chunks: DataFrame) -> DataFrame:
    """(id, type, text, chunk_id, ord) by rules: part numbers, measurements and safety words of each chunk, in its order."""
    found = [("PartNumber", F.regexp_extract_all("text", F.lit(T.PART_NUMBER), F.lit(0))), ("Measurement", F.regexp_extract_all("text", F.lit(T.MEASURE), F.lit(0))), ("Warning", F.regexp_extract_all("text", F.lit(r"(?i)\bWARNING\b[^.]*"), F.lit(0)))]

    def marked(kind: str, matches: Column) -> Column:
        return F.transform(matches, lambda x, i: F.struct(F.lit(kind).alias("type"), x.alias("text"), i.alias("ord")))

    all_of = F.concat(*[marked(k, m) for k, m in found])
    rows = chunks.select("chunk_id", F.explode(all_of).alias("x")).select("chunk_id", "x.*")
    return rows.withColumn("id", F.concat_ws("-", F.upper("type"), "chunk_id", F.col("ord").cast("string")))


def answered(contexts: DataFrame, generate: Callable[[str], str] | None = None, missing: str = "No relevant passages were found.") -> DataFrame:
    """contexts (query_id, query, context) with an answer: a model's, or without one the context's beginning."""
    blank = F.length(F.trim(F.coalesce("context", F.lit("")))) == 0

    @F.pandas_udf("string")
    def asked(prompts: pd.Series) -> pd.Series:
        return prompts.map(generate, na_action="ignore")

    text = asked(F.concat_ws("\n\n", "context", "query")) if generate else F.concat(F.lit("Retrieved context:\n"), F.substring("context", 1, 1800))
    return contexts.withColumn("answer", F.when(blank, missing).otherwise(T.without_thoughts(text)))
