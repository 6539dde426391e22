"""Extraction by a model: prompts, calls with retries, results parsed, checked and counted."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions import jsons
from graphloom.functions import text as T

RESULT = "entities array<struct<id string, type string, name string, text string, title string, description string, ata string>>, relationships array<struct<from string, to string, source string, target string, type string, confidence double>>"

# The ontology's types.
ENTITY_TYPES = ["ATAChapter", "Section", "Task", "Step", "Component", "System", "Tool", "Consumable", "PartNumber", "Warning", "Caution", "Note", "InspectionInterval", "Requirement", "Measurement", "Defect", "Chunk", "Community"]

RELATIONSHIP_TYPES = ["CONTAINS", "PART_OF", "PRECEDES", "PART_OF_SECTION", "ADJACENT_TO", "REQUIRES_TOOL", "USES_CONSUMABLE", "APPLIES_TO", "REFERENCES", "USES_PART", "WARNS_BEFORE", "WARNS_ABOUT", "GOVERNS", "HAS_INTERVAL", "HAS_MEASUREMENT", "SOURCED_FROM", "MEMBER_OF", "CONTAINS_ENTITY"]


def prompt(title: Column, chapter: Column, body: Column, hints: dict[str, Column]) -> Column:
    """What a model is asked of a chunk; each hint's line is there only if its condition holds."""
    lines = [F.when(c, F.lit(h)) for h, c in hints.items()]
    return F.concat_ws("\n", F.lit("Extract entities and relationships as JSON."), F.concat(F.lit("Chapter "), chapter, F.lit(": "), title), *lines, F.lit("Text:"), body)


# Tries of a call, and seconds to wait by how it failed: a busy service and a rate limit longer each time, another status before giving up, anything else.
TRIES = 3
BUSY, LIMITED, REFUSED, OTHER = 90.0, 45.0, 10.0, 5.0


def pause_after(error: Exception | None, attempt: int) -> tuple[float, bool]:
    """How long to wait after a call's attempt (from 1) failed with error, and whether to try again. The error's status_code says which kind it is."""
    status = getattr(error, "status_code", None)
    if status in (529, 429):
        return (BUSY if status == 529 else LIMITED) * attempt, True
    return (REFUSED, False) if status is not None else (OTHER, True)


def called(chunks: DataFrame, ask: Callable[[str], str], usable: Callable[[str], bool] = bool, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(chunk_id, result, error, attempts) of a model asked about each chunk's prompt.

    A call that raises is tried again as pause_after() says, one whose result isn't usable at once, TRIES times in all; what remains of it then is the last error, or a
    null result. Null prompts are empty ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for chunk, text in zip(frame["chunk_id"], frame["prompt"], strict=True):
                result, error, n = None, None, 0
                while n < TRIES:
                    n += 1
                    try:
                        result, error = ask(text or ""), None
                        if usable(result):
                            break
                        result = None
                    except Exception as e:  # noqa: BLE001  whatever the client raises is data here
                        error = str(e)[:200]
                        seconds, again = pause_after(e, n)
                        sleep(seconds)
                        if not again:
                            break
                rows.append((chunk, result, error, n))
            yield pd.DataFrame(rows, columns=["chunk_id", "result", "error", "attempts"])

    return chunks.select("chunk_id", "prompt").mapInPandas(run, "chunk_id string, result string, error string, attempts int")


def joined(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results of known chunks, with the chunk's columns."""
    return results.join(chunks.drop("result", "error"), "chunk_id")


def parsed(results: DataFrame) -> DataFrame:
    """results with the struct parsed; null where nothing could be salvaged."""
    return results.withColumn("parsed", F.from_json(jsons.salvage(F.col("result")), RESULT))


def entities_of(results: DataFrame) -> DataFrame:
    """(id, type, name, ..., chunk, ord): entities with an id, in the order of arrival."""
    rows = results.select("chunk_id", F.posexplode("parsed.entities").alias("pos", "e")).select("chunk_id", "pos", "e.*")
    return rows.filter(F.coalesce("id", F.lit("")) != "").withColumn("name", T.first_truthy(F.col("name"), F.col("text"), F.col("id"))).withColumns({"chunk": F.col("chunk_id"), "ord": F.struct("chunk_id", "pos")})


def relationships_of(results: DataFrame) -> DataFrame:
    rows = results.select("chunk_id", F.posexplode("parsed.relationships").alias("pos", "r")).select("chunk_id", "pos", "r.*")
    return rows.withColumn("ord", F.struct("chunk_id", "pos"))


def checked(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of known types, and the quarantine of the rest."""
    good = F.coalesce(F.col("type").isin(ENTITY_TYPES), F.lit(False))
    return entities.filter(good), entities.filter(~good)


def judged_items(results: DataFrame) -> DataFrame:
    """(chunk_id, what, pos, item, reason): every entity and relationship of results (chunk_id, parsed), as JSON, and why it isn't valid; null where it is.

    An entity needs an id and a known type. A relationship's ends are from or source and to or target, which it needs, its type (CONNECTED_TO where
    it has none) counts in upper case with underscores and has to be known, and its confidence, 1 where it has none, lies from 0 to 1."""
    e, r = F.col("x"), F.col("x")
    blank = lambda *c: T.first_truthy(*c).isNull()
    entity = F.when(blank(e["id"]), "no id").when(~F.coalesce(e["type"].isin(ENTITY_TYPES), F.lit(False)), "unknown type")
    kind = F.translate(F.upper(F.coalesce(r["type"], F.lit("CONNECTED_TO"))), " -", "__")
    sure = F.coalesce(r["confidence"], F.lit(1.0))
    way = F.when(blank(r["from"], r["source"]), "no source").when(blank(r["to"], r["target"]), "no target").when(~kind.isin(RELATIONSHIP_TYPES), "unknown type").when(~(sure.between(0.0, 1.0)), "confidence out of range")
    pick = lambda what, reason: results.select("chunk_id", F.lit(what).alias("what"), F.posexplode(f"parsed.{what}").alias("pos", "x")).select("chunk_id", "what", "pos", F.to_json("x").alias("item"), reason.alias("reason"))
    return pick("entities", entity).unionAll(pick("relationships", way))


def validated_load(results: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Valid items, the quarantine, and counts of both by kind: written under path in one pass over results, counted while it runs.

    The counts are what the write itself saw, so they are those of the files. A second load to the same path replaces the first."""
    seen = Observation()
    items = judged_items(results).withColumn("verdict", F.when(F.col("reason").isNull(), "valid").otherwise("quarantine"))
    counts = [F.count_if((F.col("what") == w) & (F.col("verdict") == v)).alias(f"{w}_{v}") for w in ("entities", "relationships") for v in ("valid", "quarantine")]
    items.observe(seen, *counts, F.count("*").alias("items")).write.mode("overwrite").partitionBy("verdict").parquet(path)
    rows = results.sparkSession.read.schema(items.schema).parquet(path)
    return rows.filter("verdict = 'valid'").drop("verdict", "reason"), rows.filter("verdict = 'quarantine'").drop("verdict"), seen.get


def counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error").isNull() & F.col("parsed").isNotNull()).alias("ok"), F.count_if(F.col("error").isNotNull() | F.col("parsed").isNull()).alias("failed"), F.coalesce(F.sum(F.size("parsed.entities")), F.lit(0)).alias("n_entities"), F.coalesce(F.sum(F.size("parsed.relationships")), F.lit(0)).alias("n_relationships"))
