import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import jsons, vector
from graphloom.functions import text as T
from graphloom.functions.numbers import round_even


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items()) or "x int") if values else spark.range(1)
    return row.select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("name", "expected"), [("Ölfilter (Haupt) für Motor links oben", "OELFILTER_HAUPT_FUER_MOTOR_LINKS"), ("Oil-Filter Assy", "OIL_FILTER_ASSY"), ("a/b", "A_B")])
def test_normalize_name(spark, name, expected):
    assert one(spark, T.normalize_name(F.col("x")), x=name) == expected


def test_ids(spark):
    assert one(spark, T.dedup_form(F.col("x")), x="Oil-Filter Assy") == "oilfilterassy"
    assert one(spark, T.named("COMP", F.col("x"), F.lit("71")), x="Oil Filter Assy") == "COMP-71-OIL_FILTER_ASSY"
    assert one(spark, T.requirement_id(F.lit("5"), F.col("x"), F.lit(1)), x="AIRWORTHINESS_LIMITATION") == "REQ-05-AWL-0001"
    assert one(spark, T.zfill(F.col("x"), 2), x="123") == "123"
    assert one(spark, T.part_id(F.col("x")), x="985782-000 a") == "PART-985782-000A"


def test_chapter(spark):
    assert one(spark, T.guess_chapter(F.col("x")), x="71-10 Oil Filter") == "71"
    assert one(spark, T.guess_chapter(F.col("x")), x="General") == "00"
    assert one(spark, T.guess_chapter(F.col("x")), x=None) == "00"


def test_features(spark):
    assert one(spark, T.features(F.col("x"))["measurement_count"], x="25 Nm and 3,5 bar") == 2
    assert one(spark, T.features(F.col("x"))["step_count"], x="1. a\n2. b") == 2
    assert one(spark, T.features(F.col("x"))["step_count"], x="1. a 2. b") == 1
    assert one(spark, T.features(F.col("x"))["has_warning"], x="a Warning here") is True


@pytest.mark.parametrize(("answer", "keywords", "expected"), [("Torque warning for oil filter", ["torque", "warning", "oil"], 1.0), ("Only torque is mentioned", ["torque", "warning"], 0.5), ("anything", [], 1.0)])
def test_keyword_recall(spark, answer, keywords, expected):
    rows = spark.createDataFrame([(answer, keywords)], "a string, k array<string>")
    assert rows.select(T.keyword_recall(F.col("a"), F.col("k")).alias("y")).first()["y"] == expected


@pytest.mark.parametrize(("base", "now", "expected"), [(0.5, 0.75, 50.0), (1.0, 1.0, 0.0)])
def test_relative_gain(spark, base, now, expected):
    assert one(spark, T.relative_gain(F.col("b"), F.col("n")), b=base, n=now) == expected


def test_salvage():
    assert jsons.salvaged('{"relationships":[{"from":"a","to":"b"}],"entities":[{"id":"x"},{"id":') == '{"relationships": [{"from": "a", "to": "b"}]}'
    assert jsons.salvaged('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert jsons.salvaged("nothing") is None
    assert jsons.salvaged(None) is None


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r["c"] for r in rows.select(vector.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(2**-0.5)
    assert got[1] is None


def test_round_even_is_that_of_exact_values(spark):
    rng = random.Random(3)
    values = [0.0625, 2.675, -0.0625, -2.675, 0.5, 1.5, 2.5, -0.5, 1.0005, 123.25, 123.35, 0.0, 1e-320, 4.4e12]
    values += [rng.choice([1, -1]) * rng.randint(0, 10**6) / rng.choice([8, 16, 1000, 2000, 7, 80]) for _ in range(3000)] + [rng.uniform(-1e9, 1e9) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", *[round_even(F.col("x"), p).alias(f"p{p}") for p in range(4)]).collect()
    assert all(r[f"p{p}"] == round(r["x"], p) for r in got for p in range(4))
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(round_even(F.col("x"), 2).alias("y")).collect()
    assert (odd[0]["y"] != odd[0]["y"], odd[1]["y"], odd[2]["y"]) == (True, float("inf"), None)
