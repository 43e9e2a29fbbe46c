import json
import random

import plain_report
import pytest
from pyspark.sql import functions as F

from modelsieve.functions import report_json as J
from modelsieve.operators import extract_report as XR
from modelsieve.operators.usage import column_usage
from modelsieve.sources.definitions import FILES_DDL


def ref(entity, prop, alias=False):
    return {"Expression": {"SourceRef": {"Source" if alias else "Entity": entity}}, "Property": prop}


def condition(kind, body=None):
    return {"Condition": {kind: body or {}}}


VISUAL = {
    "name": "v1",
    "position": {"x": 1.5, "width": 20},
    "visual": {
        "visualType": "barChart",
        "query": {
            "queryState": {
                "Y": {"projections": [{"field": {"Measure": ref("Sales", "Total")}, "queryRef": "Sales.Total"}]},
                "Category": {
                    "projections": [
                        {"field": {"Column": ref("d", "Year", alias=True)}, "queryRef": "d.Year"},
                        {"field": {"Aggregation": {"Expression": {"Column": ref("Sales", "Qty")}, "Function": 0}}, "queryRef": "Sum(Sales.Qty)"},
                    ]
                },
            },
            "sortDefinition": {"sort": [{"field": {"Measure": ref("Sales", "Total")}}]},
        },
        "objects": {
            "text": [{"properties": {"text": {"expr": {"Literal": {"Value": "'Hello'"}}}}}],
            "fill": [{"a": [{"Column": {"Property": "Colour", "Expression": {"SourceRef": {"Entity": "Dim.X"}}}}]}],
        },
        "visualContainerObjects": {
            "visualLink": [{"properties": {"navigationSection": {"expr": {"Literal": {"Value": "'page2'"}}}}}]
        },
        "note": 'text with "Column": {"Expression"} inside',
    },
    "prototypeQuery": {"From": [{"Name": "d", "Entity": "Dates"}]},
    "filterConfig": {
        "filters": [
            {
                "name": "f1",
                "field": {"Column": ref("d", "Region", alias=True)},
                "filter": {
                    "From": [{"Name": "d", "Entity": "Geo"}],
                    "Where": [condition("In", {"Expressions": [{"Column": ref("d", "Region", alias=True)}]}), condition("Comparison", {"ComparisonKind": 2})],
                },
            },
            {"field": {"Measure": ref("Sales", "Total")}, "filter": {"Where": [condition("Not"), condition("Equals"), condition("Odd")]}},
            {"name": "nothing", "field": {}},
            {"name": "agg", "field": {"Aggregation": {"Expression": {"Column": ref("q", "Amount", alias=True)}}}, "filter": {"Where": [condition("Comparison", {"ComparisonKind": 9})]}},
        ]
    },
}

LEGACY = {
    "filters": json.dumps([{"name": "rf", "expression": {"Column": ref("Dates", "Year")}}]),
    "sections": [
        {
            "displayName": "Start",
            "config": json.dumps({"visibility": 1}),
            "height": 720.0,
            "width": 1280,
            "filters": json.dumps([{"name": "pf", "expression": {"Measure": ref("Sales", "Total")}}]),
            "visualContainers": [
                {
                    "x": 5,
                    "y": 6.5,
                    "config": json.dumps(
                        {
                            "name": "lv",
                            "singleVisual": {
                                "visualType": "card",
                                "prototypeQuery": {
                                    "From": [{"Name": "s", "Entity": "Sales"}],
                                    "Select": [{"Measure": ref("s", "Total", alias=True), "Name": "s.Total"}],
                                },
                            },
                        }
                    ),
                    "filters": json.dumps([{"name": "lf", "expression": {"Column": ref("Geo", "City")}}]),
                },
                {"config": "{}"},
            ],
        },
        {"name": "second"},
    ],
}


def item(name, files):
    return [("ws", name, name, "report", path, doc if isinstance(doc, str) else json.dumps(doc, indent=1)) for path, doc in files.items()]


@pytest.fixture
def files(spark):
    modern = item(
        "modern",
        {
            "definition.pbir": {"datasetReference": {"byPath": {"path": "../Shop.SemanticModel"}}},
            "definition/report.json": {"$schema": "s", "filterConfig": {"filters": [{"name": "rf", "field": {"Column": ref("Geo", "City")}}]}},
            "definition/pages/pages.json": {"pageOrder": ["b", "a", "gone"], "activePageName": "a"},
            "definition/pages/a/page.json": {"name": "a", "displayName": "Page A", "height": 720, "width": 1280, "visibility": 1},
            "definition/pages/b/page.json": {"name": "b", "displayName": "Page B"},
            "definition/pages/a/visuals/v1/visual.json": VISUAL,
        },
    )
    remote = item(
        "remote",
        {
            "definition.pbir": {
                "datasetReference": {
                    "byConnection": {"connectionString": 'Data Source="powerbi://api.powerbi.com/v1.0/myorg/Team";semanticmodelid=ab-12'}
                }
            },
            "definition/report.json": {"$schema": "s"},
        },
    )
    return spark.createDataFrame(modern + remote + item("old", {"report.json": LEGACY}), FILES_DDL)


@pytest.fixture
def cat(files):
    return XR.extract_report_catalog(files)


def test_report_header(files, rows):
    found = XR.extract_report_header(files)
    assert rows(found, "report_id", "report_format", "model_name", "semantic_model_reference", "active_page_name") == [
        ("modern", "pbir", "Shop", None, "a"),
        ("old", "legacy", None, None, "Page 1"),
        ("remote", "pbir", "Team", "ab-12", None),
    ]


def test_pages(cat, rows):
    assert rows(cat["report_page"], "report_id", "name", "display_name", "height", "width", "is_visible", "position") == [
        ("modern", "a", "Page A", 720, 1280, False, 1),
        ("modern", "b", "Page B", None, None, True, 0),
        ("old", "Page 1", "Start", 720, 1280, False, 0),
        ("old", "second", "second", None, None, True, 1),
    ]


def test_visuals(cat, rows):
    assert rows(cat["report_visual"].drop("report_id")) == [
        ("Page 1", "lv", "card", 5.0, 6.5, 100.0, 100.0, None, None),
        ("Page 1", "visual_1", None, 0.0, 0.0, 100.0, 100.0, None, None),
        ("a", "v1", "barChart", 1.5, 0.0, 20.0, 100.0, "Hello", "page2"),
    ]


def test_field_occurrences(cat, rows):
    assert rows(cat["report_measure_used"], "report_id", "table_name", "measure_name", "usage_count") == [
        # projection, sort, both places in the document and the filter
        ("modern", "Sales", "Total", 5),
        ("old", "Sales", "Total", 1),
    ]
    assert set(rows(cat["report_column_used"], "report_id", "table_name", "column_name", "usage_count")) == {
        ("modern", "Dates", "Year", 2),
        # An aggregated column has no projection count.
        ("modern", "Sales", "Qty", 1),
        # Objects count twice; a table name ends at its first dot.
        ("modern", "Dim", "X.Colour", 2),
        # The filter's own alias wins inside the filter.
        ("modern", "Geo", "Region", 2),
        ("modern", "q", "Amount", 1),
        ("old", "Geo", "City", 1),
    }


def test_the_folder_layout_wins_over_a_single_file(spark, files, rows):
    both = files.unionByName(spark.createDataFrame(item("modern", {"report.json": LEGACY}), FILES_DDL))
    cat, twice = XR.extract_report_catalog(files), XR.extract_report_catalog(both)
    for table in ("report", "report_page", "report_visual", "report_column_used", "report_filter"):
        assert rows(twice[table]) == rows(cat[table])


def test_distinct_refs_option(files, rows):
    counts = column_usage(XR.extract_field_refs(*XR.report_visuals(files)), distinct_refs=True)
    assert {n for (n,) in rows(counts, "usage_count")} == {1}


def test_filters(cat, rows):
    found = rows(cat["report_filter"], "report_id", "level", "filter_name", "table_name", "column_name", "filter_description")
    assert set(found) == {
        ("modern", "report", "rf", "Geo", "City", None),
        ("modern", "visual", "f1", "Geo", "Region", "Se incluyen valores en 'Geo'.'Region'; Filtro de column where 'Region' es menor que"),
        (
            "modern", "visual", "Unnamed Filter", "Sales", "Total",
            "Se excluyen valores en 'Sales'.'Total'; Es igual a en 'Sales'.'Total'; Condición desconocida en 'Sales'.'Total'",
        ),
        ("modern", "visual", "agg", "q", "Amount", "Filtro de aggregation where 'Amount' es comparación desconocida"),
        ("old", "report", "rf", "Dates", "Year", None),
        ("old", "page", "pf", "Sales", "Total", None),
        ("old", "visual", "lf", "Geo", "City", None),
    }


def refs_of(spark, *pairs):
    """Sorted references that the column function finds for documents and lists of filters (texts)."""
    frame = spark.createDataFrame(list(enumerate(pairs)), "n int, t struct<doc: string, filters: string>")
    found = frame.select("n", J.document_refs(F.col("t.doc"), F.col("t.filters")).alias("refs")).collect()
    return [sorted((r["kind"], r["ref"]) for r in row["refs"]) for row in sorted(found, key=lambda r: r["n"])]


@pytest.mark.parametrize("levels", [3, 9, 60, 1200, 5000])
def test_field_nodes_at_any_depth(spark, levels):
    node = json.dumps({"Property": "P", "Expression": {"SourceRef": {"Entity": "T"}}})
    opened, closed = '{"x":[' * levels, "]}" * levels
    inner = opened + '{"Column":{"Property":"inner","Table":"T"}}' + closed
    value = opened + '{"Column":' + node[:-1] + ',"deep":' + inner + "}}" + closed
    filters = '{"filters":[{"a":1},{"filter":{"From":[{"Name":"T","Entity":"U"}]},"y":' + value + "}]}"
    objects = '{"visual":{"objects":{"o":' + value + '}},"name":"v"}'
    found = refs_of(spark, ('{"a":' + value + "}", None), (objects, None), ('{"filterConfig":' + filters + "}", None), ("{}", filters[11:-1]))
    # What lies inside a node belongs to it.
    assert found == [[("column", "T.P")], [("column", "T.P")] * 2, [("column", "U.P")], [("column", "U.P")]]


def random_document(rnd, depth=0):
    def name():
        return rnd.choice(["a", "b", "T1", "x.y", "", 'q"Column": {', None, "\\"])

    def node():
        found = {rnd.choice(["Entity", "Table", "Property"]): name()}
        if rnd.random() < 0.8:
            found |= {"Expression": {"SourceRef": {rnd.choice(["Entity", "Source"]): name()}}, "Property": rnd.choice(["p", "q r", 'a"b'])}
        if rnd.random() < 0.15:
            found["more"] = value(3)
        return found

    def value(level):
        kind = rnd.random()
        if level > 4 or kind < 0.15:
            return rnd.choice([1, None, "text", "{", '"}', "Column", True, [], {}])
        if kind < 0.5:
            return {rnd.choice(["Column", "Measure"]): rnd.choice([node(), node(), node(), [node()], "odd"]), "k": value(level + 1)}
        if kind < 0.7:
            return [value(level + 1) for _ in range(rnd.randint(0, 3))]
        return {rnd.choice(["k", "objects", "filters", "visual", "filterConfig", 'e"Column']): value(level + 1) for _ in range(2)}

    def source():
        return [{"Name": rnd.choice(["a", "b", "T1"]), "Entity": rnd.choice(["E", "F"])} for _ in range(rnd.randint(0, 3))]

    def entry():
        found = {"name": name(), rnd.choice(["field", "expression"]): rnd.choice([value(3), {"Column": node()}, {"Aggregation": {"Expression": {"Column": node()}}}])}
        conditions = [{"Condition": {rnd.choice(["Not", "In", "Equals", "Comparison", "Odd"]): {"ComparisonKind": rnd.choice([0, 2, 5, 6, -1, "x"])}}} for _ in range(2)]
        return rnd.choice([found, found, {**found, "filter": {"From": source(), "Where": conditions, "z": value(2)}}, "odd" if rnd.random() < 0.1 else found])

    def projection():
        return {"field": rnd.choice([{"Column": node()}, {"Measure": node()}, {"Aggregation": {"Expression": {"Column": node()}}}, {}]), "queryRef": rnd.choice([None, "a.p", "plain", "T1.x.y", ""])}

    state = {f"role{i}": rnd.choice([{"projections": [projection() for _ in range(2)]}, {}]) for i in range(2)}
    visual = {"query": {"queryState": state, "sortDefinition": {"sort": [projection()]}}, "objects": rnd.choice([value(1), {"o": value(1)}])}
    filters = [entry() for _ in range(rnd.randint(0, 4))]
    doc = {"name": "v", "visual": visual, "filterConfig": {"filters": filters, "other": value(2)}, "more": value(0)}
    doc[rnd.choice(["prototypeQuery", "singleVisual"])] = rnd.choice([{"From": source()}, {"prototypeQuery": {"From": source()}}])
    if rnd.random() < 0.2:
        doc["Measure"] = node()
    return doc, filters


def test_references_and_filters_against_a_plain_walk(spark):
    rnd = random.Random(17)
    cases = [random_document(rnd) for _ in range(400)]
    texts = [(json.dumps(d, indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5), rnd.choice([None, json.dumps(f)])) for d, f in cases]
    expected = [sorted(plain_report.document_refs(d, f)) for d, f in cases]
    assert refs_of(spark, *texts) == expected
    frame = spark.createDataFrame([(i, json.dumps(f)) for i, (_, f) in enumerate(cases)], "n int, filters string")
    parts = frame.select("n", J.filter_parts(F.col("filters")).alias("parts")).collect()
    found = [[tuple(p) for p in r["parts"]] for r in sorted(parts, key=lambda r: r["n"])]
    assert found == [list(plain_report.filter_parts(f)) for _, f in cases]


def test_damaged_documents_are_told_apart(spark, files, rows):
    assert refs_of(spark, ("{broken", None), (None, None), ("", "[1"), ("[1]", None), ('{"Column":', None)) == [[]] * 5
    damaged = item("bad", {"definition/report.json": "{", "definition/pages/p/page.json": "", "definition.pbir": "[]", "notes.txt": "{"})
    found = XR.unreadable_documents(files.unionByName(spark.createDataFrame(damaged, FILES_DDL)))
    assert rows(found) == [("bad", "definition.pbir"), ("bad", "definition/pages/p/page.json"), ("bad", "definition/report.json")]


def test_no_python_worker_reads_documents(files):
    visuals, pages = XR.report_visuals(files)
    for frame in (XR.extract_field_refs(visuals, pages), XR.extract_filters(XR.extract_report_header(files), pages, visuals)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInPandas" not in plan and "MapInArrow" not in plan
