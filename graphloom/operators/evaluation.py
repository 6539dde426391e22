"""Metrics of answers, and comparisons of modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.numbers import round_even


def evaluated(rows: DataFrame) -> DataFrame:
    """Answers (id, query, mode, answer, keywords, total_ms, llm_ms, error) with retrieval_ms, answer_chars and keyword_recall."""
    return rows.withColumns({"retrieval_ms": F.greatest(F.col("total_ms") - F.col("llm_ms"), F.lit(0.0)), "answer_chars": F.length("answer").cast("long"), "keyword_recall": T.keyword_recall(F.col("answer"), F.col("keywords"))})


def summarised(rows: DataFrame) -> DataFrame:
    """By mode: totals, and median and mean time and mean recall of the rows without error."""
    ok = F.coalesce("error", F.lit("")) == ""
    time, recall = F.when(ok, F.col("total_ms")), F.when(ok, F.col("keyword_recall"))
    return rows.groupBy("mode").agg(F.count("*").alias("queries_total"), F.count_if(ok).alias("queries_successful"), F.count_if(~ok).alias("queries_failed"), F.coalesce(round_even(F.median(time), 1), F.lit(0.0)).alias("total_ms_p50"), F.coalesce(round_even(F.avg(time), 1), F.lit(0.0)).alias("total_ms_avg"), F.coalesce(round_even(F.avg(recall), 3), F.lit(0.0)).alias("keyword_recall_avg"))


def compared(summary: DataFrame, base: str, other: str) -> DataFrame:
    """One row: gains of other over base."""
    pick = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    rows = summary.agg(*[pick(m, c).alias(f"{c}_{k}") for k, m in (("b", base), ("o", other)) for c in ("keyword_recall_avg", "total_ms_avg")])
    b, o = F.col("keyword_recall_avg_b"), F.col("keyword_recall_avg_o")
    return rows.select(round_even(o - b, 3).alias("absolute_gain"), T.relative_gain(b, o).alias("relative_gain_pct"), round_even(F.col("total_ms_avg_o") - F.col("total_ms_avg_b"), 1).alias("latency_delta_ms"))


def averages(rows: DataFrame, *metrics: str) -> DataFrame:
    """Means of what is not null, to 3 places."""
    return rows.agg(*[round_even(F.avg(m), 3).alias(m) for m in metrics])


def latency_shares(rows: DataFrame) -> DataFrame:
    """The part of the time that retrieval took, in percent, and its band."""
    most = F.greatest(F.lit(1.0), F.col("total_ms"))
    return rows.select("id", F.round(100 * F.greatest(F.col("total_ms") - F.col("llm_ms"), F.lit(0.0)) / most).cast("long").alias("retrieval_pct"), T.duration(F.col("total_ms")).alias("band"))
