"""Steps whose work or memory must not grow faster than their input."""

import math
import re
from collections import Counter

from modelsieve.operators import graph, usage
from modelsieve.plans import fixpoint
from modelsieve.plans import queries as Q
from modelsieve.schemas import conform


def _empty(spark, *names):
    return {name: conform(spark.createDataFrame([], "x INT"), name) for name in names}


def test_used_objects_are_found_once(spark, rows, monkeypatch):
    calls = []
    measures = spark.createDataFrame([("m", "T", "x")], "semantic_model_id STRING, table_name STRING, measure_name STRING")
    columns = spark.createDataFrame([("m", "T", "a")], "semantic_model_id STRING, table_name STRING, column_name STRING")
    monkeypatch.setattr(Q.subset, "used_objects", lambda cat: calls.append("used") or {"columns": columns, "measures": measures})
    needed = Q.subset.required_by_measures
    monkeypatch.setattr(Q.subset, "required_by_measures", lambda *given: calls.append("needed") or needed(*given))
    cat = _empty(spark, "measure_dependencies", "calculated_table_dependencies", "semantic_model_relationship", "semantic_model_column")
    found, tables = Q._needed_columns(cat)
    assert rows(found) == [("m", "T", "a")] and rows(tables) == [("m", "T")]
    assert calls == ["used", "needed"]


def test_usage_is_made_distinct_by_link_only(spark, rows):
    used = "report_id STRING, page_name STRING, visual_name STRING, table_name STRING, {} STRING, usage_count BIGINT"
    cat = {
        "report_column_used": spark.createDataFrame([(f"r{i % 7}", f"p{i}", "v", "T", f"c{i % 2}", 1) for i in range(20)], used.format("column_name")),
        "report_measure_used": spark.createDataFrame([("r0", "p", "v", "T", "m", 1), (None, "p", "v", "T", "m", 1)], used.format("measure_name")),
        # One report is listed twice, r6 not at all.
        "report": spark.createDataFrame([(f"r{i % 6}", f"n{i % 2}") for i in range(7)], "report_id STRING, name STRING"),
        "semantic_model": spark.createDataFrame([("s0", "n0.SemanticModel"), ("s1", "n1.SemanticModel"), ("s2", "n1.SemanticModel")], "semantic_model_id STRING, name STRING"),
    }
    found = usage.linked_usage(cat)
    expected = {(s, "column", "T", c) for s in ("s0", "s1", "s2") for c in ("c0", "c1")} | {("s0", "measure", "T", "m")}
    assert rows(found) == sorted(expected, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[report_id#\d+, kind", plan)


def test_tasks_of_a_distinct_follow_the_rows(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i % 50, None if i % 3 else "x") for i in range(300)], "a INT, b STRING")
    assert fixpoint.distinct_rows(df, 300, per_task=20).rdd.getNumPartitions() == 15
    assert rows(fixpoint.distinct_rows(df, 300, per_task=20)) == rows(df.distinct())
    asked = []
    monkeypatch.setattr(graph, "distinct_rows", lambda df, n: asked.append(n) or fixpoint.distinct_rows(df, n))
    edges = spark.createDataFrame([("m", "A", "B"), ("m", "A", "B"), ("m", None, "B")], "semantic_model_id STRING, from_table STRING, to_table STRING")
    assert rows(graph.neighbours(edges)) == [("m", "A", "B"), ("m", "B", "A")]
    assert asked == [4]


def _page_catalog(spark, pages, sources):
    return {
        "report_column_used": spark.createDataFrame(
            [(f"r{i % 7}", f"p{i // 7}", table) for table, n in pages.items() for i in range(n)],
            "report_id STRING, page_name STRING, table_name STRING",
        ),
        "semantic_model_partitions": spark.createDataFrame(
            [("m", table, f"s{i}", f"a = {i}") for table, n in sources.items() for i in range(n)],
            "semantic_model_id STRING, table_name STRING, partition_name STRING, source_expression STRING",
        ),
        "report": spark.createDataFrame([(f"r{i}", "n") for i in range(6)] + [("r6", None), ("r0", "n")], "report_id STRING, name STRING"),
        "semantic_model": spark.createDataFrame([("m", "n.SemanticModel")], "semantic_model_id STRING, name STRING"),
    }


def test_tasks_of_page_sources_follow_from_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "ROWS_PER_SIDE", 5, raising=False)
    # T has many rows on both sides, U many pages, V many sources; W has no sources.
    pages, sources = {"T": 70, "U": 21, "V": 1, "W": 7, None: 7}, {"T": 40, "U": 1, "V": 30, "X": 3, None: 2}
    found = usage.page_sources(_page_catalog(spark, pages, sources))
    expected = Counter()
    for table, n in pages.items():
        for i in range(n):
            for k in range(sources.get(table, 0) if table and i % 7 < 6 else 0):
                expected[(f"r{i % 7}", f"p{i // 7}", table, f"s{k}", f"a = {k}")] += 1 + (i % 7 == 0)
    assert Counter(tuple(r) for r in found.collect()) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    tasks = {int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan)}
    assert tasks == {math.ceil(expected.total() / 25)}


def test_few_pairs_of_page_sources_are_joined_plainly(spark, rows):
    found = usage.page_sources(_page_catalog(spark, {"T": 2}, {"T": 1}))
    assert rows(found) == [("r0", "p0", "T", "s0", "a = 0")] * 2 + [("r1", "p0", "T", "s0", "a = 0")]
    assert "REPARTITION_BY_NUM" not in found._jdf.queryExecution().executedPlan().toString()
