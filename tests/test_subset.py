"""Unused objects and subsets against plain-Python evaluations on small random catalogs."""

import random

import pytest

from modelsieve.operators import subset, unused, usage
from modelsieve.operators.graph import relationship_key_columns, transitive_dependencies
from modelsieve.schemas import conform, empty

DEP = (
    "semantic_model_id STRING, measure_name STRING, measure_table STRING, dependency_type STRING, "
    "referenced_name STRING, referenced_table STRING"
)


def build(spark, seed):
    rng = random.Random(seed)
    tables = [f"T{i}" for i in range(9)]
    columns = {(t, f"c{j}") for t in tables for j in range(6) if rng.random() < 0.8}
    sort_by = {tc: f"c{rng.randrange(7)}" for tc in sorted(columns) if rng.random() < 0.3}
    measures = {f"m{i}": rng.choice(tables) for i in range(8)}
    direct = set()
    for m, home in measures.items():
        for _ in range(rng.randrange(3)):
            t, c = rng.choice(sorted(columns))
            direct.add((m, home, "column", c, t))
        if rng.random() < 0.4:
            direct.add((m, home, "table", rng.choice(tables), None))
        if rng.random() < 0.5:
            other = rng.choice([*measures, "unknown"])
            direct.add((m, home, "measure", other, measures.get(other, "")))
    calc = {(f"T{i}", "table", f"T{rng.randrange(9)}", None) for i in (7, 8)}
    calc |= {("T8", "column", "c1", "T6"), ("T7", "measure", "m1", None)}
    edges = []
    for i in range(7):
        (a, ac), (b, bc) = rng.choice(sorted(columns)), rng.choice(sorted(columns))
        edges.append((f"r{i}", a, ac, b, bc))
    bins = [(t, c, t, "c5") for t, c in sorted(columns)[:4]]
    used_columns = {rng.choice(sorted(columns)) for _ in range(4)} | {("Ghost", "x")}
    used_measures = {(measures[m], m) for m in rng.sample(sorted(measures), 3)}
    mid = "m"
    cat = {
        "semantic_model": conform(spark.createDataFrame([(mid, "Shop.SemanticModel"), ("other", "Other")], "semantic_model_id STRING, name STRING"), "semantic_model"),
        "semantic_model_table": conform(spark.createDataFrame([(mid, t) for t in tables], "semantic_model_id STRING, table_name STRING"), "semantic_model_table"),
        "semantic_model_column": conform(
            spark.createDataFrame([(mid, t, c, sort_by.get((t, c))) for t, c in sorted(columns)], "semantic_model_id STRING, table_name STRING, column_name STRING, sort_by_column STRING"),
            "semantic_model_column",
        ),
        "semantic_model_measure": conform(
            spark.createDataFrame([(mid, t, m) for m, t in measures.items()], "semantic_model_id STRING, table_name STRING, measure_name STRING"), "semantic_model_measure"
        ),
        "semantic_model_relationship": conform(
            spark.createDataFrame([(mid, *e) for e in edges], "semantic_model_id STRING, relationship_name STRING, from_table STRING, from_column STRING, to_table STRING, to_column STRING"),
            "semantic_model_relationship",
        ),
        "semantic_model_table_bins": spark.createDataFrame([(mid, *b) for b in bins], "semantic_model_id STRING, table_name STRING, source_column STRING, bin_table STRING, bin_column STRING"),
        "calculated_table_dependencies": conform(
            spark.createDataFrame([(mid, *c) for c in sorted(calc, key=repr)], "semantic_model_id STRING, calculated_table_name STRING, dependency_type STRING, referenced_name STRING, referenced_table STRING"),
            "calculated_table_dependencies",
        ),
        "measure_dependencies": transitive_dependencies(spark.createDataFrame([(mid, *d) for d in sorted(direct, key=repr)], DEP)),
        "report": conform(spark.createDataFrame([("r1", "Shop"), ("r2", "Shop"), ("r3", "Elsewhere")], "report_id STRING, name STRING"), "report"),
        "report_page": empty(spark, "report_page"),
        "report_filter": conform(spark.createDataFrame([("r1", "T0", "c0")], "report_id STRING, table_name STRING, column_name STRING"), "report_filter"),
        "report_column_used": conform(
            spark.createDataFrame([(r, t, c, 2) for t, c in sorted(used_columns) for r in ("r1", "r2")] + [("r3", "T1", "c9", 1)], "report_id STRING, table_name STRING, column_name STRING, usage_count INT"),
            "report_column_used",
        ),
        "report_measure_used": conform(
            spark.createDataFrame([("r2", t, m, 3) for t, m in sorted(used_measures)], "report_id STRING, table_name STRING, measure_name STRING, usage_count INT"), "report_measure_used"
        ),
    }
    closed = set(direct)
    while True:
        more = {(m, h, k, n, t) for m, h, k0, n0, _ in closed if k0 == "measure" for m2, _, k, n, t in direct if m2 == n0}
        if more <= closed:
            break
        closed |= more
    plain = dict(tables=tables, columns=columns, sort_by=sort_by, measures=measures, closed=closed, calc=calc, edges=edges,
                 bins=bins, used_columns=used_columns, used_measures=used_measures)
    return cat, plain


def plain_minimal(p):
    names = {m for _, m in p["used_measures"]}
    need = [d for d in p["closed"] if d[0] in names]
    report_tables = {t for t, _ in p["used_columns"]} | {t for t, _ in p["used_measures"]}
    dep_columns = {(t, n) for _, _, k, n, t in need if k == "column" and t}
    dep_measures = {n for _, _, k, n, _ in need if k == "measure"}
    final = report_tables | {t for t, _ in dep_columns}
    final |= {n for _, _, k, n, _ in need if k == "table"} | {t for _, _, k, _, t in need if k == "measure" and t}
    while True:
        rows = [c for c in p["calc"] if c[0] in final]
        dep_columns |= {(t, n) for _, k, n, t in rows if k == "column"}
        new = {n for _, k, n, _ in rows if k == "table"} | {t for _, k, _, t in rows if k == "column"}
        if new <= final:
            break
        final |= new
    measures = set(p["used_measures"]) | {(p["measures"][m], m) for m in dep_measures if m in p["measures"]}
    final |= {t for t, _ in measures}
    relationships = {e for e in p["edges"] if e[1] in final and e[3] in final}
    columns = p["used_columns"] | dep_columns
    columns |= {(e[1], e[2]) for e in relationships} | {(e[3], e[4]) for e in relationships}
    for _ in range(10):
        columns |= {(t, p["sort_by"][t, c]) for t, c in columns if (t, c) in p["sort_by"] and (t, p["sort_by"][t, c]) in p["columns"]}
    before, inside = set(columns), set(final)
    for st, sc, bt, bc in p["bins"]:
        if st in inside and (st, sc) in before and bt in inside:
            columns.add((bt, bc))
        if bt in inside and (bt, bc) in before:
            final.add(st)
            columns.add((st, sc))
    kept = final & set(p["tables"])
    with_columns, with_measures = {t for t, _ in columns}, {t for t, _ in measures}
    return {
        "tables": {(t, "report" if t in report_tables else "dax-dep", t not in with_columns, t not in with_measures) for t in kept},
        "columns": {(t, c) for t, c in p["columns"] if t in kept and (t not in with_columns or (t, c) in columns)},
        "measures": {(t, m) for m, t in p["measures"].items() if t in kept and (t not in with_measures or (t, m) in measures)},
        "relationships": {e[0] for e in relationships},
    }


@pytest.mark.parametrize("seed", [11, 12])
def test_minimal_model_and_unused_objects(spark, rows, seed):
    cat, plain = build(spark, seed)
    expected = plain_minimal(plain)
    found = subset.minimal_model(cat)
    assert set(rows(found["tables"].drop("semantic_model_id"))) == expected["tables"]
    assert set(rows(found["columns"].drop("semantic_model_id"))) == expected["columns"]
    assert set(rows(found["measures"].drop("semantic_model_id"))) == expected["measures"]
    assert {r for (r,) in rows(found["relationships"], "relationship_name")} == expected["relationships"]

    names = {m for _, m in plain["used_measures"]}
    names |= {n for m, _, k, n, _ in plain["closed"] if k == "measure" and m in names}
    assert {m for (m,) in rows(unused.unused_measures(cat), "measure_name")} == set(plain["measures"]) - names

    ends = {(e[1], e[2]) for e in plain["edges"]} | {(e[3], e[4]) for e in plain["edges"]}
    used = plain["used_columns"] | {(t, n) for _, _, k, n, t in plain["closed"] if k == "column"} | ends
    assert set(rows(unused.unused_columns(cat), "table_name", "column_name")) == plain["columns"] - used

    direct = {t for t, _ in plain["used_columns"] | plain["used_measures"]}
    direct |= {n for _, _, k, n, _ in plain["closed"] if k == "table"} | {t for _, _, k, _, t in plain["closed"] if k == "column"}
    reached = direct | {t for e in plain["edges"] if e[1] in direct or e[3] in direct for t in (e[1], e[3])}
    assert {t for (t,) in rows(unused.unused_tables(cat), "table_name")} == set(plain["tables"]) - reached

    summary = unused.unused_summary(cat).where("table_name is null").first()
    assert summary["unused_measures"] == len(set(plain["measures"]) - names)
    preview = unused.reduction_preview(cat).where("semantic_model_id = 'm'").first()
    assert preview["total_columns"] - preview["removed_columns"] == preview["used_columns"]

    one = subset.minimal_model(cat, model="m")
    assert rows(one["columns"]) == rows(found["columns"])
    assert subset.minimal_model(cat, model="other")["tables"].count() == 0


def test_filters_count_only_when_asked(spark, rows):
    cat, plain = build(spark, 14)
    without = set(rows(subset.used_objects(cat)["columns"], "table_name", "column_name"))
    assert without == plain["used_columns"]
    with_filters = set(rows(subset.used_objects(cat, include_filters=True)["columns"], "table_name", "column_name"))
    assert with_filters == without | ({("T0", "c0")} & plain["columns"])


def test_usage_roll_ups(spark, rows):
    cat, plain = build(spark, 15)
    by_report = rows(usage.usage_by_report(cat), "report_id", "total_column_usage", "total_measure_usage")
    n = len(plain["used_columns"])
    assert by_report == [("r1", 2 * n, 0), ("r2", 2 * n, 3 * len(plain["used_measures"])), ("r3", 1, 0)]
    table = usage.usage_by_table(cat, link_by="name").where("table_name = 'Ghost'").first()
    assert (table["column_usage"], table["measure_usage"], table["reports"]) == (4, 0, 2)
    summary = usage.model_usage_summary(cat, link_by="name").where("semantic_model_id = 'm'").first()
    used = {t for t, _ in plain["used_columns"] | plain["used_measures"]}
    assert (summary["total_tables"], summary["used_tables"], summary["unused_tables"]) == (9, len(used), max(9 - len(used), 0))


@pytest.fixture
def star(spark):
    """Two facts and five dimensions; the first fact has a measure over another table."""
    tables = ["FactA", "FactB", "Dim1", "Dim2", "Dim3", "Sub", "Alone"]
    edges = [
        ("e1", "FactA", "k1", "Dim1", "id", None, True),
        ("e2", "FactA", "k2", "Dim2", "id", "manyToOne", False),
        ("e3", "Dim2", "k", "Sub", "id", None, True),
        ("e4", "FactB", "k1", "Dim1", "id", None, True),
        ("e5", "FactB", "k3", "Dim3", "id", "oneToOne", True),
    ]
    columns = [("m", t, c, "n" if c == "id" else None) for t in tables for c in ("id", "k", "k1", "k2", "k3", "n")]
    measures = [("m", "FactA", "A", "SUM(Dim3[n])"), ("m", "FactA", "B", "SUM(FactA[n])"), ("m", "Dim3", "C", "1")]
    return {
        "semantic_model_table": conform(spark.createDataFrame([("m", t) for t in tables], "semantic_model_id STRING, table_name STRING"), "semantic_model_table"),
        "semantic_model_column": conform(
            spark.createDataFrame(columns, "semantic_model_id STRING, table_name STRING, column_name STRING, sort_by_column STRING"), "semantic_model_column"
        ),
        "semantic_model_measure": conform(
            spark.createDataFrame(measures, "semantic_model_id STRING, table_name STRING, measure_name STRING, expression STRING"), "semantic_model_measure"
        ),
        "semantic_model_relationship": conform(
            spark.createDataFrame([("m", *e) for e in edges], "semantic_model_id STRING, relationship_name STRING, from_table STRING, from_column STRING, to_table STRING, to_column STRING, cardinality STRING, is_active BOOLEAN"),
            "semantic_model_relationship",
        ),
    }


def seeds(spark, *pairs):
    return spark.createDataFrame([("m", t, d) for t, d in pairs], "semantic_model_id STRING, table_name STRING, direction STRING")


def test_subset_from_seeds_recursive(spark, star, rows):
    found = subset.subset_from_seeds(star, seeds(spark, ("FactA", "ManyToOne"), ("Ghost", "Both")), max_depth=3)
    assert rows(found["tables"], "table_name", "added_by_measure") == [
        ("Dim1", False), ("Dim2", False), ("Dim3", True), ("FactA", False), ("Sub", False),
    ]
    assert rows(found["relationships"], "relationship_name") == [("e1",), ("e2",), ("e3",)]
    # A table added by a measure keeps only the named columns; the others keep all.
    assert rows(found["columns"].where("table_name = 'Dim3'"), "column_name") == [("n",)]
    assert found["columns"].where("table_name = 'FactA'").count() == 6
    assert rows(found["measures"], "measure_name") == [("A",), ("B",), ("C",)]
    assert rows(found["missing_seeds"], "table_name") == [("Ghost",)]


def test_subset_from_seeds_only(spark, star, rows):
    found = subset.subset_from_seeds(star, seeds(spark, ("FactA", "ManyToOne")), recursive=False)
    assert rows(found["tables"], "table_name") == [("Dim3",), ("FactA",)]
    assert found["relationships"].count() == 0


def test_element_specs(spark, star, rows):
    spec_rows = [
        ("m", "FactA", "include", "column", None), ("m", "FactA", "include", "column", "n"), ("m", "FactA", "include", "measure", None),
        ("m", "Dim1", "exclude", "column", None), ("m", "Dim1", "exclude", "column", "id"), ("m", "Dim1", "exclude", "column", "k"),
    ]
    specs = spark.createDataFrame(spec_rows, "semantic_model_id STRING, table_name STRING, mode STRING, kind STRING, element STRING")
    keys = relationship_key_columns(star["semantic_model_relationship"].where("relationship_name = 'e1'"))
    found = subset.apply_element_spec(star, specs, key_columns=keys)
    kept = rows(found["columns"].where("table_name in ('FactA', 'Dim1', 'Sub')"), "table_name", "column_name", "sort_by_column")
    assert kept == [
        ("Dim1", "id", "n"), ("Dim1", "k1", None), ("Dim1", "k2", None), ("Dim1", "k3", None), ("Dim1", "n", None),
        ("FactA", "k1", None), ("FactA", "n", None),
        ("Sub", "id", "n"), ("Sub", "k", None), ("Sub", "k1", None), ("Sub", "k2", None), ("Sub", "k3", None), ("Sub", "n", None),
    ]
    # A list without entries keeps nothing; a kind without a list keeps all.
    assert rows(found["measures"], "measure_name") == [("C",)]
    removed = subset.removed_columns(star["semantic_model_column"], found["columns"])
    assert rows(removed.where("table_name = 'Dim1'"), "column_name") == [("k",)]


def test_sort_by_of_dropped_columns_is_cleared(spark, star, rows):
    kept = star["semantic_model_column"].where("table_name = 'Sub' and column_name in ('id', 'k')")
    assert rows(subset.clear_invalid_sort_by(kept), "column_name", "sort_by_column") == [("id", None), ("k", None)]


def test_report_based_specs_sort_fields_by_what_the_model_knows(spark, star, rows):
    cat = dict(star)
    cat["semantic_model"] = conform(spark.createDataFrame([("m", "Shop.SemanticModel")], "semantic_model_id STRING, name STRING"), "semantic_model")
    cat["report"] = conform(spark.createDataFrame([("r", "Shop")], "report_id STRING, name STRING"), "report")
    used = [("r", "FactA", "n"), ("r", "FactA", "A"), ("r", "FactA", "alias"), ("r", "Nowhere", "x")]
    cat["report_column_used"] = conform(spark.createDataFrame(used, "report_id STRING, table_name STRING, column_name STRING"), "report_column_used")
    cat["report_measure_used"] = empty(spark, "report_measure_used")
    found = subset.report_based_specs(cat).where("element is not null")
    assert rows(found, "table_name", "kind", "element") == [
        ("FactA", "column", "alias"), ("FactA", "column", "n"), ("FactA", "measure", "A"),
    ]


def plain_merge(target, sources):
    """Names of the source pages, one page after the other."""
    present = {n for n in target if n}
    result = []
    for name in sources:
        if name and name in present:
            number = 2
            while f"{name} ({number})" in present:
                number += 1
            name = f"{name} ({number})"
        if name:
            present.add(name)
        result.append(name)
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_pages(spark, seed):
    rng = random.Random(seed)
    pool = ["P", "P", "P", "Q", "P (3)", "P (2)", "Q (2) (2)", "Q (2)", "Q (x)", "P (02)", "P (12345678901234567890123)", "", None]
    arrivals = [(o, i, rng.choice(pool)) for o in range(6) for i in range(12)]
    ddl = "source_order BIGINT, position BIGINT, name STRING"
    target = spark.createDataFrame(arrivals[:12], ddl)
    found = subset.merge_pages(target, spark.createDataFrame(arrivals[12:], ddl)).collect()
    by_place = {(max(r["source_order"], 0), r["position"]): r["name"] for r in found}
    assert len(found) == len(arrivals)
    assert [by_place[o, i] for o, i, _ in arrivals[:12]] == [n for _, _, n in arrivals[:12]]
    expected = plain_merge([n for _, _, n in arrivals[:12]], [n for _, _, n in arrivals[12:]])
    assert [by_place[o, i] for o, i, _ in arrivals[12:]] == expected


def test_merge_pages_keeps_the_pages_of_the_target(spark):
    ddl = "source_order BIGINT, position BIGINT, name STRING"
    target = spark.createDataFrame([(0, 0, "A"), (0, 1, "A")], ddl)
    sources = spark.createDataFrame([(1, 0, "A"), (1, 1, "A (2)")], ddl)
    found = {(r["source_order"], r["position"]): r["name"] for r in subset.merge_pages(target, sources).collect()}
    assert found == {(-1, 0): "A", (-1, 1): "A", (1, 0): "A (2)", (1, 1): "A (2) (2)"}


def test_merge_pages_with_one_name_on_most_pages(spark):
    n = 20_000
    pages = spark.range(n).selectExpr("id % 100 as source_order", "id as position", "if(id % 3 = 0, concat('p', id), 'Page 1') as name")
    found = subset.merge_pages(pages.limit(0), pages)
    assert found.count() == n
    assert found.select("name").distinct().count() == n
    hot = n - (n + 2) // 3
    assert found.where(f"name = 'Page 1 ({hot})'").count() == 1
    assert found.where(f"name = 'Page 1 ({hot + 1})'").count() == 0


def test_prune_tables_reads_only_kept_columns(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 as a", "id * 3 as b").write.parquet(str(tmp_path / "t"))
    tables = {"t": spark.read.parquet(str(tmp_path / "t")), "gone": spark.range(1)}
    kept = spark.createDataFrame([("t", "b"), ("t", "not there")], "table_name STRING, column_name STRING")
    pruned = subset.prune_tables(tables, kept)
    assert list(pruned) == ["t"] and pruned["t"].columns == ["b"]
    assert "ReadSchema: struct<b:bigint>" in pruned["t"]._jdf.queryExecution().toString()
