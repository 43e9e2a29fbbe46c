import base64
import json

import pytest
from pyspark.sql import functions as F

from modelsieve.operators import extract_model, links, subset, usage
from modelsieve.schemas import conform
from modelsieve.sources import catalog as C
from modelsieve.sources import definitions as D
from modelsieve.sources import manifests as S
from modelsieve.sources import reimport as R
from modelsieve.streaming.ingest import item_stream, upsert_stream


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_scan_definitions(spark, tmp_path, rows):
    write(tmp_path / "My Space" / "Shop á+.SemanticModel" / "definition" / "tables" / "T 1.tmdl", "table 'T 1'\n")
    write(tmp_path / "My Space" / "Shop.Report" / "definition" / "report.json", '{"$schema":"x"}')
    write(tmp_path / "My Space" / "other" / "report.json", "{}")
    found = D.scan_definitions(spark, str(tmp_path))
    assert set(rows(found, "workspace", "item_id", "item_kind", "rel_path")) == {
        ("My Space", "local_My Space/Shop", "report", "definition/report.json"),
        ("My Space", "local_My Space/Shop á+", "model", "definition/tables/T 1.tmdl"),
    }
    assert rows(extract_model.extract_tables(found), "table_name") == [("T 1",)]


def test_definition_parts(spark, rows):
    payload = base64.b64encode("ñandú\n".encode() * 100).decode()
    text = json.dumps({"definition": {"parts": [
        {"path": "a.tmdl", "payload": payload, "payloadType": "InlineBase64"},
        {"path": "b", "payload": "x", "payloadType": "Other"},
    ]}})
    schema = "STRUCT<definition: STRUCT<parts: ARRAY<STRUCT<path: STRING, payload: STRING, payloadType: STRING>>>>"
    items = spark.createDataFrame([("i", text)], "item_id STRING, t STRING").select(
        "item_id", F.from_json("t", schema)["definition"].alias("definition")
    )
    assert rows(D.decode_definition_parts(items)) == [("i", "a.tmdl", "ñandú\n" * 100)]


def test_inventory(spark, tmp_path, rows):
    doc = {"workspaces": [
        {"id": "w1", "name": "A", "reports": [{"id": "r", "name": "R"}], "semantic_models": [{"id": "s", "name": "S"}]},
        {"id": "w2", "name": "B", "reports": []},
    ]}
    write(tmp_path / "inventory.json", json.dumps(doc, indent=2))
    found = D.explode_workspace_inventory(D.read_workspace_inventory(spark, str(tmp_path)))
    assert rows(found) == [("w1", "A", "report", "r", "R"), ("w1", "A", "semantic_model", "s", "S")]


def test_workspaces(spark, rows):
    ddl = "id STRING, displayName STRING, description STRING, type STRING, capacityId STRING, capacitySku STRING, domainId STRING"
    data = [
        ("a", None, None, None, None, None, None),
        ("b", "B", "d", "workspace", "c", None, None),
        ("c", "C", "", "Workspace", "c", "", None),
        ("d", "D", "", "workspace", "c", "F64", "x"),
    ]
    found = D.normalize_workspaces(spark.createDataFrame(data, ddl))
    assert rows(found, "id", "displayName", "description", "type", "isOnDedicatedCapacity") == [
        ("a", "", "", "Workspace", False), ("b", "B", "d", "ppu", False), ("c", "C", "", "Workspace", False), ("d", "D", "", "workspace", True),
    ]


def test_upsert_workspaces_keeps_creation_time(spark, rows):
    ddl = "id STRING, displayName STRING, updated_at INT"
    first = C.upsert_workspaces(spark.createDataFrame([], ddl), spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], ddl))
    second = C.upsert_workspaces(first, spark.createDataFrame([("a", "new", 5), ("a", "mid", 3)], ddl))
    assert rows(second, "id", "displayName", "updated_at", "created_at") == [("a", "new", 5, 1), ("b", "y", 1, 1)]


MEASURE = "semantic_model_id STRING, table_name STRING, measure_name STRING, expression STRING"


def test_upsert_catalog_matches_by_id_then_name(spark, rows):
    models = "semantic_model_id STRING, name STRING"
    stored = {
        "semantic_model": spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], models),
        "semantic_model_measure": spark.createDataFrame([(k, "T", "old" + k, "") for k in "123"], MEASURE),
    }
    batch = {
        "semantic_model": spark.createDataFrame([("1", "A renamed"), ("local_B", "B"), ("9", "New")], models),
        "semantic_model_measure": spark.createDataFrame([("local_B", "T", "newB", ""), ("9", "T", "new9", "")], MEASURE),
    }
    result = C.upsert_catalog(stored, batch, "semantic_model_id", parent="semantic_model")
    assert rows(result["semantic_model"]) == [("1", "A renamed"), ("2", "B"), ("3", "C"), ("9", "New")]
    # Item 1 came without measures and loses its old ones.
    assert rows(result["semantic_model_measure"], "semantic_model_id", "measure_name") == [("2", "newB"), ("3", "old3"), ("9", "new9")]


def test_items_match_within_their_workspace_only(spark, rows):
    models = "semantic_model_id STRING, workspace_id STRING, name STRING"
    stored = [("s1", "w1", "Sales"), ("d1", "w1", "Twice"), ("d2", "w1", "Twice"), ("g", None, "Global"), ("n", "w1", None)]
    incoming = [
        ("l2", "w2", "Sales"),  # the same name elsewhere
        ("l1", "w1", "Sales"),
        ("l3", "w1", "Twice"),  # two stored items have the name
        ("l4", "w1", "New"), ("l5", "w1", "New"),
        ("l6", None, "Global"), ("l7", "w1", "Global"), ("l8", "w1", None),
    ]
    found = C.match_items(spark.createDataFrame(stored, models), spark.createDataFrame(incoming, models), "semantic_model_id")
    assert dict(rows(found, "semantic_model_id", "stored_key")) == {k: {"l1": "s1", "l6": "g"}.get(k, k) for k, *_ in incoming}
    # The batch brings the stored item itself and another one of its name; and two new ones of one name.
    both = spark.createDataFrame([("s1", "w1", "Sales"), ("l1", "w1", "Sales")], models)
    assert rows(C.match_items(spark.createDataFrame(stored, models), both, "semantic_model_id"), "stored_key") == [("l1",), ("s1",)]
    pair = spark.createDataFrame([("l1", "w1", "Sales"), ("l2", "w1", "Sales")], models)
    assert rows(C.match_items(spark.createDataFrame(stored, models), pair, "semantic_model_id"), "stored_key") == [("l1",), ("l2",)]


def test_stored_catalog(spark, tmp_path, rows):
    path = str(tmp_path / "catalog")
    measures = spark.range(50).selectExpr("cast(id % 7 as string) as semantic_model_id", "'T' as table_name", "concat('m', id) as measure_name")
    models = spark.range(7).selectExpr("cast(id as string) as semantic_model_id", "concat('n', id) as name")
    whole = {"semantic_model": conform(models, "semantic_model"), "semantic_model_measure": conform(measures, "semantic_model_measure")}
    C.write_catalog(whole, path, buckets=4)
    batch = {
        "semantic_model": conform(spark.createDataFrame([("3", "n3"), ("5", "n5")], "semantic_model_id STRING, name STRING"), "semantic_model"),
        "semantic_model_measure": conform(spark.createDataFrame([("3", "T", "only", "x")], MEASURE), "semantic_model_measure"),
    }
    for _ in range(2):  # the same batch twice leaves the same catalog
        C.upsert_stored_catalog(spark, path, batch, buckets=4)
    cat = C.read_catalog(spark, path)
    assert sorted(cat) == ["semantic_model", "semantic_model_measure"]
    counts = dict(rows(cat["semantic_model_measure"].groupBy("semantic_model_id").count()))
    assert counts == {"0": 8, "1": 7, "2": 7, "3": 1, "4": 7, "6": 7}
    assert cat["semantic_model"].count() == 7
    found = C.query_catalog(spark, "WITH x AS (SELECT * FROM semantic_model_measure) SELECT count(*) AS n FROM x -- note")
    assert found.first()["n"] == 37
    assert rows(C.table_counts(cat), "table_name", "row_count", "tables") == [
        ("semantic_model", 7, 1), ("semantic_model_measure", 37, 1), (None, 44, 2),
    ]


@pytest.mark.parametrize("sql", ["DROP TABLE x", "INSERT INTO x VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "SELECT 1; DROP TABLE x", "", "  ;", "SELECT 1) t; DROP TABLE x; SELECT * FROM (SELECT 1", "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM range(3)",
                                 "CREATE TEMPORARY VIEW v AS SELECT 1", "SET a = b"])
def test_only_queries_run(spark, sql):
    with pytest.raises(Exception):  # noqa: B017
        C.query_catalog(spark, sql)


def test_queries_with_parameters_and_table_functions(spark, rows):
    ddl = ", ".join(f"{c} STRING" for c in "semantic_model_id measure_name measure_table dependency_type referenced_name referenced_table".split())
    deps = [("m", "a", "T", "measure", "b", "T"), ("m", "a", "T", "column", "c", "U"), ("m", "a", "T", "table", "U", None), ("n", "a", "T", "measure", "z", "")]
    edges = [("m", "F", "D", None), ("m", "D", "S", "manyToOne"), ("m", "S", "F", None), ("m", "F", "X", "oneToOne"), ("n", "F", "Q", None)]
    cat = {
        "measure_dependencies": spark.createDataFrame(deps, ddl),
        "semantic_model_relationship": spark.createDataFrame(edges, "semantic_model_id STRING, from_table STRING, to_table STRING, cardinality STRING"),
    }
    C.register_functions(spark, cat)

    def ask(sql, **args):
        return rows(C.query_catalog(spark, sql, args))

    assert ask("-- a note first\nSELECT * FROM reachable(:model, :name)", model="m", name="a") == [("b", "T")]
    assert ask("SELECT * FROM reachable(:model, :name)", model="m", name="a' OR '1'='1") == []
    assert ask("FROM needed_columns('m', 'a')") == [("U", "c")]
    assert ask("SELECT * FROM neighbours('m', 'F')") == [("D",), ("S",), ("X",)]
    assert ask("SELECT * FROM expanded('m', :t, :depth)", t="F", depth=5) == [("D", 1), ("F", 0), ("S", 2)]
    assert ask("SELECT * FROM expanded('m', :t, :depth)", t="F", depth=1) == [("D", 1), ("F", 0)]
    both = "WITH k AS (SELECT DISTINCT semantic_model_id AS k FROM measure_dependencies) SELECT k, r.reached FROM k, LATERAL reachable(k, 'a') r"
    assert ask(both) == [("m", "b"), ("n", "z")]


def test_calc_dependencies(spark, rows):
    data = [("w", {"DATABASE_NAME": "A", "OBJECT_NAME": "", "object_name": "o"}), ("w", {"database_name": "Z"})]
    found = D.load_calc_dependencies(
        spark.createDataFrame(data, "workspace_id STRING, fields MAP<STRING, STRING>"),
        spark.createDataFrame([("1", "A")], "semantic_model_id STRING, name STRING"),
    )
    assert rows(found, "semantic_model_id", "database_name", "object_name", "expression_text") == [("1", "A", "o", ""), (None, "Z", None, "")]


def test_subset_specs(spark, tmp_path, rows):
    docs = [
        {"name": "new", "base_model": "B", "initial_tables": [{"name": "A", "search_direction": "Both"}, {"name": "C"}], "max_depth": 2,
         "table_elements": {"A": {"columns": ["x", "y"], "measures": None, "mode": "exclude"}, "C": {"columns": []}}},
        {"name": "older", "initial_tables": [{"name": "A", "direction": "OneToMany"}], "recursive": False},
        {"name": "plain", "initial_tables": ["A", "B"]},
        {"name": "oldest", "included_tables": ["Q"]},
    ]
    for doc in docs:
        write(tmp_path / f"{doc['name']}.json", json.dumps(doc, indent=2))
    specs = S.load_subset_spec(spark, str(tmp_path))
    assert rows(specs, "name", "recursive", "max_depth") == [("new", True, 2), ("older", False, 10), ("oldest", True, 10), ("plain", True, 10)]
    assert rows(S.spec_seeds(specs), "name", "table_name", "direction") == [
        ("new", "A", "Both"), ("new", "C", "ManyToOne"), ("older", "A", "OneToMany"), ("oldest", "Q", "ManyToOne"),
        ("plain", "A", "ManyToOne"), ("plain", "B", "ManyToOne"),
    ]
    assert rows(S.spec_elements(specs, ["name"])) == [
        ("new", "A", "exclude", "column", "x"), ("new", "A", "exclude", "column", "y"), ("new", "A", "exclude", "column", None),
        ("new", "C", "include", "column", None),
    ]


def test_manifest_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("m", "T", True)], "model STRING, table_name STRING, keep BOOLEAN")
    S.write_subset_manifest(df, str(tmp_path / "m"))
    assert rows(S.read_subset_manifest(spark, str(tmp_path / "m"), "model STRING, table_name STRING, keep BOOLEAN")) == [("m", "T", True)]


def test_stream_replaces_items(spark, tmp_path, rows):
    ddl = "semantic_model_id STRING, measures ARRAY<STRING>"

    def drop(name, *items):
        write(tmp_path / "in" / name, "\n".join(json.dumps({"semantic_model_id": k, "measures": m}) for k, m in items))

    def extract(batch):
        items = batch.select("semantic_model_id")
        measures = batch.select("semantic_model_id", F.explode("measures").alias("measure_name"))
        return {"semantic_model": conform(items, "semantic_model"), "semantic_model_measure": conform(measures, "semantic_model_measure")}

    def run():
        query = upsert_stream(
            item_stream(spark, str(tmp_path / "in"), ddl), extract, str(tmp_path / "cat"), str(tmp_path / "progress"), buckets=2
        )
        query.awaitTermination()
        cat = C.read_catalog(spark, str(tmp_path / "cat"), views=False)
        return rows(cat["semantic_model_measure"], "semantic_model_id", "measure_name")

    drop("1.json", ("a", ["x", "y"]), ("b", ["z"]))
    assert run() == [("a", "x"), ("a", "y"), ("b", "z")]
    drop("2.json", ("a", ["n"]), ("b", []))
    assert run() == [("a", "n")]


def test_links(spark, rows):
    cat = {
        "semantic_model": conform(
            spark.createDataFrame([("g1", "w1", "A.SemanticModel"), ("g2", "w9", "B.SemanticModel")], "semantic_model_id STRING, workspace_id STRING, name STRING"), "semantic_model"
        ),
        "report": conform(
            spark.createDataFrame([("r1", "A", "w1", "g2"), ("r2", "B", "w1", "g2"), ("r3", "C", "w2", None)], "report_id STRING, name STRING, workspace_id STRING, semantic_model_reference STRING"), "report"
        ),
        "workspaces": conform(spark.createDataFrame([("w1", "One"), ("w0", "Aaa"), ("w2", "Two")], "id STRING, displayName STRING"), "workspaces"),
    }
    assert rows(links.report_links(cat, "name")) == [("r1", "g1"), ("r2", "g2")]
    assert rows(links.report_links(cat, "reference")) == [("r1", "g2"), ("r2", "g2")]
    with pytest.raises(ValueError):
        links.report_links(cat, "other")
    assert rows(links.reports_for_model(cat, "A.SemanticModel"), "report_id") == [("r1",)]
    assert links.model_for_report(cat, "C").first()["semantic_model_id"] is None
    assert rows(links.model_with_workspace(cat), "semantic_model_id", "workspace_name") == [("g1", "One"), ("g2", None)]
    assert rows(links.sibling_reports(cat["report"], cat["report"].where("report_id = 'r1'")), "sibling_id") == [("r2",)]
    assert rows(links.sibling_counts(cat["report"]), "report_id", "siblings") == [("r1", 1), ("r2", 1)]
    requests = spark.createDataFrame(
        [("a", "g2", "A"), ("b", None, "B"), ("c", "no", "B.SemanticModel"), ("d", None, None)], "request_id STRING, semantic_model_id STRING, name STRING"
    )
    assert rows(links.resolve_model_id(requests, cat["semantic_model"]), "request_id", "resolved_id", "resolved_by") == [
        ("a", "g2", "id"), ("b", "g2", "name"), ("c", "g2", "name"), ("d", "g1", "first"),
    ]
    assert links.linked_by_name_ratio(cat).first() == (2, 3)
    assert [tuple(r) for r in usage.workspace_counts(cat).select("displayName", "reports", "models", "is_empty").collect()] == [
        ("One", 2, 1, False), ("Two", 1, 0, False), ("Aaa", 0, 0, True),
    ]


def test_items_of_one_name_in_two_workspaces_stay_apart(spark, rows):
    files = spark.createDataFrame(
        [(f"file:/x/ws{i}/Sales.SemanticModel/definition/tables/T.tmdl", "table T") for i in (1, 2)], "path STRING, content STRING"
    )
    assert rows(D.classify_files(files), "item_id") == [("local_ws1/Sales",), ("local_ws2/Sales",)]


def test_stored_catalog_keeps_its_bucket_count(spark, tmp_path, rows):
    path = str(tmp_path / "catalog")
    models = conform(spark.createDataFrame([("a", "A"), ("b", "B")], "semantic_model_id STRING, name STRING"), "semantic_model")
    measures = conform(spark.createDataFrame([("a", "T", "old", ""), ("b", "T", "stays", "")], MEASURE), "semantic_model_measure")
    tables = conform(spark.createDataFrame([("a", "T")], "semantic_model_id STRING, table_name STRING"), "semantic_model_table")
    spaces = conform(spark.createDataFrame([("w1", "One"), ("w2", "Two")], "id STRING, displayName STRING"), "workspaces")
    whole = {"semantic_model": models, "semantic_model_measure": measures, "semantic_model_table": tables, "workspaces": spaces}
    C.write_catalog(whole, path, buckets=4)
    batch = {
        # Known by name only; without tables of its own.
        "semantic_model": conform(spark.createDataFrame([("local_A", "A")], "semantic_model_id STRING, name STRING"), "semantic_model"),
        "semantic_model_measure": conform(spark.createDataFrame([("local_A", "T", "new", "")], MEASURE), "semantic_model_measure"),
        "workspaces": conform(spark.createDataFrame([("w2", "Zwei")], "id STRING, displayName STRING"), "workspaces"),
    }
    with pytest.raises(ValueError):
        C.upsert_stored_catalog(spark, path, batch, buckets=64)
    C.upsert_stored_catalog(spark, path, batch)
    cat = C.read_catalog(spark, path, views=False)
    assert rows(cat["semantic_model_measure"], "semantic_model_id", "measure_name") == [("a", "new"), ("b", "stays")]
    assert rows(cat["semantic_model"], "semantic_model_id", "name") == [("a", "A"), ("b", "B")]
    assert rows(cat["semantic_model_table"]) == []
    assert rows(cat["workspaces"], "id", "displayName") == [("w1", "One"), ("w2", "Zwei")]
    with pytest.raises(ValueError):
        C.write_catalog(whole, path, buckets=8)


def test_stream_stores_the_latest_version_of_a_batch(spark, tmp_path, rows):
    ddl = "item_id STRING, version INT, measure_name STRING"
    lines = [("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")]
    write(tmp_path / "in" / "1.json", "\n".join(json.dumps(dict(zip(("item_id", "version", "measure_name"), x))) for x in lines))

    def extract(batch):
        found = batch.withColumnRenamed("item_id", "semantic_model_id").select("semantic_model_id", "measure_name")
        return {"semantic_model_measure": conform(found, "semantic_model_measure")}

    query = upsert_stream(
        item_stream(spark, str(tmp_path / "in"), ddl), extract, str(tmp_path / "cat"), str(tmp_path / "progress"), buckets=2, version="version"
    )
    query.awaitTermination()
    cat = C.read_catalog(spark, str(tmp_path / "cat"), views=False)
    assert rows(cat["semantic_model_measure"], "semantic_model_id", "measure_name") == [("a", "new"), ("b", "only")]


def test_seeds_in_mixed_form(spark, rows):
    texts = ['[{"name":"B","direction":"Both"}, "A"]', '["A", {"name":"B"}]']
    docs = spark.createDataFrame([(f'{{"name":"s{i}","initial_tables":{t}}}',) for i, t in enumerate(texts)], "content STRING")
    assert rows(S.spec_seeds(S.parse_subset_specs(docs)), "name", "table_name", "direction") == [
        ("s0", "A", "ManyToOne"), ("s0", "B", "Both"), ("s1", "A", "ManyToOne"), ("s1", "B", "ManyToOne"),
    ]


def test_a_name_of_many_reports_and_models_gives_no_pairs(spark):
    n = 1000
    cat = {
        "semantic_model": conform(spark.range(n).selectExpr("concat('m', id) as semantic_model_id", "'Sales.SemanticModel' as name"), "semantic_model"),
        "report": conform(spark.range(n).selectExpr("concat('r', id) as report_id", "'Sales' as name"), "report"),
        "report_column_used": conform(
            spark.range(n).selectExpr("concat('r', id) as report_id", "'T' as table_name", "concat('c', id % 2) as column_name"), "report_column_used"
        ),
        "report_measure_used": conform(spark.createDataFrame([], "report_id STRING"), "report_measure_used"),
    }
    found = usage.linked_usage(cat)
    assert found.count() == 2 * n
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Usage is reduced per report, then by name before the models join, then per model.
    depths = [len(line) - len(line.lstrip(" :+-")) for line in plan.split("\n") if "Aggregate [" in line and "kind" in line]
    assert len(depths) >= 3 and depths == sorted(depths)


def stored_models(spark, tmp_path, buckets=64):
    """A stored catalog of forty models, each with two tables, one of them used."""
    ids = [f"m{i}" for i in range(40)]

    def table(name, columns, data):
        return conform(spark.createDataFrame(data, ", ".join(f"{c} STRING" for c in columns.split())), name)

    key = "semantic_model_id "
    cat = {
        "semantic_model": table("semantic_model", key + "name", [(i, f"N{i}.SemanticModel") for i in ids]),
        "semantic_model_table": table("semantic_model_table", key + "table_name", [(i, t) for i in ids for t in ("A", "B", "C")]),
        "semantic_model_column": table("semantic_model_column", key + "table_name column_name", [(i, t, "c") for i in ids for t in ("A", "B", "C")]),
        "semantic_model_measure": table("semantic_model_measure", key + "table_name measure_name expression", [(i, "A", "x", "SUM(B[c])") for i in ids]),
        "semantic_model_relationship": table("semantic_model_relationship", key + "from_table from_column to_table to_column", [(i, "A", "c", "B", "c") for i in ids]),
        "semantic_model_table_bins": table("semantic_model_table_bins", key + "table_name", []),
        "calculated_table_dependencies": table("calculated_table_dependencies", key + "calculated_table_name", []),
        "report": table("report", "report_id name", [(f"r{i}", f"N{i}") for i in ids]),
        "report_column_used": table("report_column_used", "report_id", []),
        "report_measure_used": table("report_measure_used", "report_id table_name measure_name", [(f"r{i}", "A", "x") for i in ids]),
    }
    path = str(tmp_path / "catalog")
    R.write_with_dependencies(cat, path, buckets)
    return path


def test_an_item_is_read_from_its_bucket_alone(spark, tmp_path, rows):
    path = stored_models(spark, tmp_path)
    cat = C.read_catalog(spark, path, views=False)
    part = cat.of_items("semantic_model_id", "m7")
    scans = [part[t]._jdf.queryExecution().executedPlan().toString() for t in part if t.startswith(("semantic_model", "measure_")) and not part[t].isEmpty()]
    assert len(scans) == 7 and all("PartitionFilters: [" in s and "item_bucket" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)
    (bucket,) = {r[0] for r in C._bucketed(cat["semantic_model"].where("semantic_model_id = 'm7'"), "semantic_model", 64).select(C.BUCKET).collect()}
    # Whoever reads another bucket of a model's tables now fails.
    for folder in (tmp_path / "catalog").glob("*/item_bucket=*"):
        if folder.name != f"item_bucket={bucket}" and not folder.parent.name.startswith("report"):
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not a table")
    minimal = subset.minimal_model(cat, "m7")
    assert rows(minimal["tables"], "semantic_model_id", "table_name", "provenance") == [("m7", "A", "report"), ("m7", "B", "dax-dep")]
    assert rows(minimal["columns"], "table_name", "column_name") == [("A", "c"), ("B", "c")]
    asked = spark.createDataFrame([("m7",), ("none",)], "semantic_model_id STRING")
    found = cat.of_each("semantic_model_id", asked.where("semantic_model_id = 'm7'"))["semantic_model_table"]
    assert rows(found, "table_name") == [("A",), ("B",), ("C",)]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_reimport_touches_the_rows_of_its_models_only(spark, tmp_path, rows):
    path = stored_models(spark, tmp_path, buckets=8)
    models = conform(spark.createDataFrame([("m7", "N7.SemanticModel")], "semantic_model_id STRING, name STRING"), "semantic_model")
    tables = conform(spark.createDataFrame([("m7", t) for t in "AB"], "semantic_model_id STRING, table_name STRING"), "semantic_model_table")
    measures = conform(spark.createDataFrame([("m7", "A", "x", "[y]"), ("m7", "A", "y", "[x] + SUM(A[q])")], MEASURE), "semantic_model_measure")
    batch = {"semantic_model": models, "semantic_model_table": tables, "semantic_model_measure": measures}
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "catalog").glob("measure_*/item_bucket=*/*.parquet")}
    for _ in range(2):  # again, with nothing new
        R.reimport_models(spark, path, batch)
        cat = C.read_catalog(spark, path, views=False)
        closed = rows(cat["measure_dependencies"].where("semantic_model_id = 'm7'"), "measure_name", "dependency_type", "referenced_name")
        assert closed == [(m, *r) for m in "xy" for r in (("column", "q"), ("measure", "x"), ("measure", "y"), ("table", "A"))]
        assert cat["measure_dependencies"].where("semantic_model_id <> 'm7'").count() == 39 * 2
        assert R.stale_models(spark, path).collect() == []
    left = {f for f, t in files.items() if f.exists() and f.stat().st_mtime_ns == t}
    assert len({f.parent.name for f in files}) == 8 and len({f.parent.name for f in set(files) - left}) == 1
