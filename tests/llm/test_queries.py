"""Queries against their SQL, held-out accuracy, and the pipeline's stages."""

import os

import pandas as pd
import pytest

import corpus_pipeline
from graphloom.llm import registry
from graphloom.llm.common import materialise

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    key = lambda f: sorted(tuple("null" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert key(ours) == key(theirs)


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.97), ("op7_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.1"
    got = registry.QUERIES[name](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got[label]).mean() >= least


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, DATA), "stage")
        assert docs.columns == columns
        assert 0.6 * before < docs.count() <= before
    assert docs.filter("text like '%[SECRET]%'").count() > 0
    assert docs.filter("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.select("doc_id").distinct().count() == docs.count()
