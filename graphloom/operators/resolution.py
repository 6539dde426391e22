"""Entity and relationship resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T


def resolve_entities(entities: DataFrame, columns: list[str], dedup: str = "name") -> DataFrame:
    """One row per type and normalised name (or, dedup="typed", the type's own key): the first id, each column's first truthy value by arrival (ord), and the ordered distinct source chunks.

    entities: id, type, name, ord, chunk and columns. Rows without id are dropped. Every value is an
    aggregate that combines before it moves; a key of any number of rows keeps one row a task, but for its chunk list."""
    rows = entities.filter(F.coalesce(F.col("id"), F.lit("")) != "").withColumn("_name", T.first_truthy(F.col("name"), F.col("id")))
    form = T.dedup_form(F.col("_name")) if dedup == "name" else T.typed_dedup_key(F.col("type"), F.col("_name"), F.col("_name"), F.col("id"))
    rows = rows.withColumn("norm", F.concat_ws("::", F.coalesce("type", F.lit("Unknown")), form)).withColumn("norm_name", form)
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("ord"))).alias(c) for c in columns]
    chunks = rows.groupBy("norm", "chunk").agg(F.min("ord").alias("ord")).groupBy("norm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk"))), lambda x: x["chunk"]), ",").alias("source_chunks"))
    kept = rows.groupBy("norm").agg(F.min_by("id", "ord").alias("id"), F.min_by("type", "ord").alias("type"), F.first("norm_name").alias("norm_name"), F.min("ord").alias("ord"), F.count("*").alias("merged"), *firsts)
    return kept.join(chunks, "norm")


def name_map(resolved: DataFrame) -> DataFrame:
    """(norm_name, id): of a name that several types have, the latest new entity."""
    return resolved.groupBy("norm_name").agg(F.max_by("id", "ord").alias("id"))


def resolve_relationships(rels: DataFrame, resolved: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(source, target, type) whose ends are entity ids, or names that resolve to one; others are dropped, repeated ones kept once by ord.

    rels: from, source, to, target (empty counts as missing), type, ord. aliases: (alias, id), to map ids that
    a merge has swallowed."""
    kind = F.translate(F.upper(F.coalesce(T.truthy(F.col("type")), F.lit("CONNECTED_TO"))), " -", "__")
    rows = rels.select(T.first_truthy(F.col("from"), F.col("source")).alias("s"), T.first_truthy(F.col("to"), F.col("target")).alias("t"), kind.alias("type"), "ord").filter("s is not null and t is not null")
    ids, names = resolved.select(F.col("id").alias("known")).distinct(), name_map(resolved)
    for end in ("s", "t"):
        rows = rows.withColumn("_norm", T.dedup_form(F.col(end))).join(ids.withColumnRenamed("known", "_id"), F.col(end) == F.col("_id"), "left")
        rows = rows.join(names.select(F.col("norm_name").alias("_norm"), F.col("id").alias("_by_name")), "_norm", "left")
        found = [F.col("_id"), F.col("_by_name")]
        if aliases is not None:
            rows = rows.join(aliases.select(F.col("alias").alias(end), F.col("id").alias("_alias")), end, "left")
            found.insert(1, F.col("_alias"))
        rows = rows.withColumn(end, F.coalesce(*found)).filter(F.col(end).isNotNull()).select("s", "t", "type", "ord")
    return rows.groupBy(F.col("s").alias("source"), F.col("t").alias("target"), "type").agg(F.min("ord").alias("ord"))


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))
