"""From pages and sections to overlapping, feature-marked chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from graphloom.config import CHUNK_OVERLAP, CHUNK_SIZE, MIN_CHUNK_WORDS
from graphloom.functions import text as T
from graphloom.sources.tables import settled


def chunk_windows(sections: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, least: int = MIN_CHUNK_WORDS, features_on: str = "chunk_text") -> DataFrame:
    """Overlapping word windows of (section_id, text, ...), each of least words at least, with its features.

    Only the last windows can be short, so a window's number is its start over the step. features_on: the
    chunk's words joined by spaces, or raw_lines, the section's own lines."""
    step = size - overlap
    rows = sections.withColumn("_w", T.words(F.col("text"))).filter(F.size("_w") >= least)
    rows = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step)))).withColumn("_part", F.slice("_w", F.col("_at") + 1, F.lit(size)))
    rows = rows.filter(F.size("_part") >= least)
    seq = (F.col("_at") / step).cast("long")
    raw = F.col("text") if features_on == "raw_lines" else F.array_join("_part", " ")
    rows = rows.withColumns({"_raw": raw, "chunk_seq": seq, "word_count": F.size("_part").cast("long"), "chunk_id": F.concat(F.col("section_id"), F.lit("-C"), T.zfill((seq + 1).cast("string"), 3)), "text": F.array_join("_part", " ")})
    return rows.withColumns(T.features(F.col("_raw"))).drop("_w", "_at", "_part", "_raw")


def global_sequence(chunks: DataFrame, *order: str) -> DataFrame:
    """chunks with global_seq, numbers from 0 in the given order.

    Counts of ranges of the order, which are few, give each range its first number, so that the rows are numbered
    within ranges and never meet in one task."""
    from graphloom.operators.ranking import numbered

    return numbered(chunks, *order, into="global_seq")


def adjacent(chunks: DataFrame, key: str, *within: str) -> DataFrame:
    """(src, dst, type) of consecutive rows by key: in each group of within, or over all rows if there is none.

    Over all rows, each is numbered by ranges and joined with the next number, so that no task sees them all."""
    if within:
        order = Window.partitionBy(*within).orderBy(key)
        rows = chunks.select(F.col("chunk_id").alias("src"), F.lead("chunk_id").over(order).alias("dst")).filter("dst is not null")
    else:
        from graphloom.operators.ranking import numbered

        placed = settled(numbered(chunks.select(key, "chunk_id"), key, "chunk_id", into="at").select("at", "chunk_id"))
        rows = placed.select("at", F.col("chunk_id").alias("src")).join(placed.select((F.col("at") - 1).alias("at"), F.col("chunk_id").alias("dst")), "at")
    return rows.select("src", "dst", F.lit("ADJACENT_TO").alias("type"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.round(F.avg("word_count"), 6).alias("avg_words"), F.count_if("has_warning").alias("n_warning"), F.coalesce(F.sum("step_count"), F.lit(0)).cast("long").alias("n_steps"), F.coalesce(F.sum("measurement_count"), F.lit(0)).cast("long").alias("n_measurements"))


def section_texts(pages: DataFrame, section: str, order: str, text: str) -> DataFrame:
    """Texts of a section's pages joined in order, with its first and last page (from 1)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), lambda x: x[text])
    rows = pages.filter(F.length(F.trim(F.col(text))) > 0).groupBy(section)
    return rows.agg(F.array_join(parts, "\n").alias("text"), (F.min(order) + 1).alias("page_start"), (F.max(order) + 1).alias("page_end"))


def toc_ends(toc: DataFrame, last_page: int | None) -> DataFrame:
    """A table of contents (idx, level, page_1[, doc, last_page]) with id and page_start and page_end from 0: an entry ends before the next of its level or above, whatever the levels' numbers.

    Entries of a document are gone through from the last, with a stack of those that may end an earlier one: of
    lower and lower levels. Documents are groups; a table without doc is one document's. With last_page None each document's is in its rows."""
    own = "doc" in toc.columns
    rows = toc if own else toc.withColumn("doc", F.lit(0))
    schema = T_.StructType([*rows.schema.fields, T_.StructField("_end", T_.LongType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx", ascending=False, kind="stable")
        stack: list[tuple[int, int]] = []
        ends = []
        for level, page in zip(part["level"].tolist(), part["page_1"].tolist(), strict=True):
            while stack and stack[-1][0] > level:
                stack.pop()
            ends.append(max(0, stack[-1][1] - 2) if stack else int(part["last_page"].iloc[0]) if last_page is None else last_page)
            stack.append((level, page))
        return part.assign(_end=ends)

    done = rows.groupBy("doc").applyInPandas(run, schema)
    done = done.select("*", F.concat(F.lit("SEC-"), T.zfill((F.col("idx") + 1).cast("string"), 4)).alias("id"), (F.col("page_1") - 1).alias("page_start"), F.col("_end").alias("page_end")).drop("_end")
    return done if own else done.drop("doc")


def pages_to_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Each page (page_idx[, doc]) with section_idx: the deepest section (idx, level, page_start, page_end[, doc]) that spans it, the first of those; its document's first section if none does.

    Sections are opened to the pages they span, so the range join is an equi join, and the best of a page is an aggregate that combines before it moves."""
    by = ["doc"] if "doc" in pages.columns else []
    opened = sections.filter(F.col("page_end") >= F.col("page_start")).select(*by, "idx", "level", F.explode(F.sequence("page_start", "page_end")).alias("page_idx"))
    owner = opened.groupBy(*by, "page_idx").agg(F.max_by("idx", F.struct(F.col("level"), -F.col("idx"))).alias("section_idx"))
    first = sections.groupBy(*by).agg(F.min("idx").alias("_first"))
    held = pages.join(owner, [*by, "page_idx"], "left")
    held = held.join(first, by, "left") if by else held.join(F.broadcast(first), F.lit(True), "left")  # one row where there are no documents to tell apart
    return held.withColumn("section_idx", F.coalesce("section_idx", "_first")).drop("_first")
