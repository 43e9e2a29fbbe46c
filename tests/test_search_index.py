"""Search through the index against a scan."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modelsieve.operators import refs
from modelsieve.operators import search_index as I

DDL = "semantic_model_id STRING, table_name STRING, measure_name STRING, expression STRING"
TEXTS = ["sum(", "SUM(A", "aba", "abab", "é漢", "é漢x", "none of it", "x", "", "a[", "m1", "..."]


@pytest.fixture(scope="module")
def measures(spark):
    rnd = random.Random(2)
    words = ["Sum(A[x])", "abab", "aba", "bab", "É漢X", "[m1]", "calculate", "a", "", "..", "\n"]
    rows = [(f"s{i % 3}", "T", f"m{i}", None if i % 17 == 0 else " ".join(rnd.choices(words, k=rnd.randint(0, 6)))) for i in range(300)]
    return spark.createDataFrame([*rows, ("s", "T", "", None)], DDL).cache()


@pytest.fixture(scope="module")
def index(spark, measures, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "grams")
    I.write_index(measures, path)
    return I.read_index(spark, path)


def test_search_equals_a_scan(spark, measures, index, rows):
    found = I.search(index, measures, spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "text STRING"))
    expected = [(t, *r) for t in TEXTS for r in map(tuple, refs.search_measures(measures, t).select(*I.KEY).collect())]
    assert rows(found) == sorted(expected, key=repr)
    assert {t for t, *_ in expected} >= {"sum(", "aba", "abab", "é漢x", "x", ""}


def test_search_reads_postings_of_its_trigrams_only(spark, measures, index):
    asked = spark.createDataFrame([("calculate",)], "text STRING")
    plan = I.candidates(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "expression:string" not in plan
    # A text beside the index is not read for candidates.
    assert I.candidates(index, asked).count() == measures.where(F.col("expression").contains("calculate")).count()


def test_search_without_measures(spark, tmp_path):
    nothing = spark.createDataFrame([], DDL)
    I.write_index(nothing, str(tmp_path / "none"))
    asked = spark.createDataFrame([("abc",), ("a",)], "text STRING")
    assert I.search(I.read_index(spark, str(tmp_path / "none")), nothing, asked).collect() == []


def test_common_trigrams_are_not_paired_with_every_text(spark, tmp_path):
    rows = [("s", "T", f"m{i}", f"Brand#{i % 10}[x]") for i in range(500)]
    # One key twice, with parts of a text in different expressions: no hit.
    rows += [("s", "U", "u", "brand#"), ("s", "U", "u", "and#7["), ("s", "U", "v", "brand#7["), ("s", "U", "v", "brand#7[")]
    measures = spark.createDataFrame(rows, DDL)
    I.write_index(measures, str(tmp_path / "common"))
    index = I.read_index(spark, str(tmp_path / "common"))
    asked = spark.createDataFrame([(f"brand#{i}[",) for i in range(10)], "text STRING")
    found = Counter(r["text"] for r in I.search(index, measures, asked).collect())
    assert found == Counter({f"brand#{i}[": 50 + 2 * (i == 7) for i in range(10)})
    # A text meets the lists of one of its trigrams only.
    plan = I.candidates(index, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in plan and "count(1) AS __held" not in plan
