import pytest
from pyspark.sql import functions as F

from modelsieve.operators import refs

TABLES = ["Sales", "Internet Sales", "Date", "Order", "Dim#1", "Calc"]


@pytest.fixture
def cat(spark):
    measures = [
        ("m", "Sales", "Total", "SUM('internet sales'[Amount]) + sum(SALES[Qty])"),
        ("m", "Sales", "Ratio", "VAR Calc = 1 RETURN [total] / [Nobody] + COUNTROWS(Calc)"),
        ("m", "Sales", "Rows", "COUNTROWS(Internet Sales) + COUNTROWS(sales) + DATE(2024,1,1) + SalesTax"),
        ("m", "Sales", "Key", "MAX(Order[Id]) + COUNTROWS(Dim#1) & \"Date\" + [Sales Amount]"),
        ("m", "Sales", "Quoted", "COUNTROWS('Internet Sales')"),
        ("m", "Sales", "Empty", ""),
        ("m2", "Sales", "Other", "COUNTROWS(Date) + [Total]"),
    ]
    return {
        "semantic_model_measure": spark.createDataFrame(
            measures, "semantic_model_id STRING, table_name STRING, measure_name STRING, expression STRING"
        ),
        "semantic_model_table": spark.createDataFrame(
            [("m", t, t == "Calc", "FILTER(Sales, Sales[Qty] > [Total])" if t == "Calc" else None) for t in TABLES]
            + [("m2", "Sales", False, None)],
            "semantic_model_id STRING, table_name STRING, is_calculated BOOLEAN, source_code STRING",
        ),
    }


def test_qualified_refs_take_the_spelling_of_the_model(cat, rows):
    found = refs.qualified_refs(cat["semantic_model_measure"], cat["semantic_model_table"])
    assert rows(found, "measure_name", "ref_table", "ref_column", "is_known") == [
        ("Key", "Order", "Id", True),
        ("Total", "Internet Sales", "Amount", True),
        ("Total", "Sales", "Qty", True),
    ]


def test_measure_refs_flag_unknown_names(cat, rows):
    found = refs.measure_refs(cat["semantic_model_measure"], cat["semantic_model_table"])
    assert rows(found, "semantic_model_id", "measure_name", "ref_measure", "is_known") == [
        ("m", "Key", "Sales Amount", False),
        ("m", "Ratio", "Nobody", False),
        ("m", "Ratio", "Total", True),
        ("m2", "Other", "Total", False),
    ]


def test_bare_tables(cat, rows):
    found = refs.bare_table_refs(cat["semantic_model_measure"], cat["semantic_model_table"])
    # The longest name wins; parts of words, calls, variables, strings and brackets do not count.
    assert rows(found, "semantic_model_id", "measure_name", "ref_table") == [
        ("m", "Key", "Dim#1"),
        ("m", "Rows", "Internet Sales"),
        ("m", "Rows", "Sales"),
    ]
    quoted = refs.bare_table_refs(cat["semantic_model_measure"], cat["semantic_model_table"], include_quoted=True)
    assert ("m", "Quoted", "Internet Sales") in rows(quoted, "semantic_model_id", "measure_name", "ref_table")


def test_direct_dependencies(cat, rows):
    found = refs.direct_dependencies(cat).where("measure_name in ('Ratio', 'Total')")
    assert rows(found, "measure_name", "dependency_type", "referenced_name", "referenced_table") == [
        ("Ratio", "measure", "Nobody", ""),
        ("Ratio", "measure", "Total", "Sales"),
        ("Total", "column", "Amount", "Internet Sales"),
        ("Total", "column", "Qty", "Sales"),
        # A column names its table, too, also the measure's own.
        ("Total", "table", "Internet Sales", None),
        ("Total", "table", "Sales", None),
    ]


def test_a_column_of_another_table_links_the_tables(spark, rows):
    from modelsieve.operators import graph

    ddl = "semantic_model_id STRING, table_name STRING, measure_name STRING, expression STRING"
    measures = spark.createDataFrame([("m", "A", "x", "SUM(B[q])"), ("m", "A", "y", "[x] + SUM(A[r])"), ("m", "C", "z", "[x]")], ddl)
    tables = spark.createDataFrame([("m", t, False) for t in "ABC"], "semantic_model_id STRING, table_name STRING, is_calculated BOOLEAN")
    direct = refs.direct_dependencies({"semantic_model_measure": measures, "semantic_model_table": tables})
    assert rows(graph.table_dependency_graph(direct), "table_name", "depends_on") == [("A", "B")]
    closed = graph.table_dependency_graph(graph.transitive_dependencies(direct))
    assert rows(closed, "table_name", "depends_on") == [("A", "B"), ("C", "B")]


def test_calculated_tables(cat, rows):
    found = refs.calculated_table_dependencies(cat)
    assert rows(found, "calculated_table_name", "dependency_type", "referenced_name", "referenced_table") == [
        ("Calc", "column", "Qty", "Sales"),
        ("Calc", "measure", "Total", None),
        ("Calc", "table", "Sales", None),
    ]


def test_functions_with_and_without_catalogue(cat, spark, rows):
    known = spark.createDataFrame([("sum",), ("MAX",)], "f STRING")
    found = refs.functions_used(cat["semantic_model_measure"], known)
    assert rows(found, "measure_name", "function_name") == [("Key", "MAX"), ("Total", "SUM")]
    assert refs.functions_used(cat["semantic_model_measure"]).where("function_name = 'DATE'").count() == 1


def test_external_and_own_references(spark, rows):
    measures = spark.createDataFrame(
        [("m", "Fact", "a", "SUM(Fact[Qty]) + SUM(Dim[Key]) + Ghost[x] + dim[y]"), ("m", "Dim", "b", "SUM(Other[z])")],
        "semantic_model_id STRING, table_name STRING, measure_name STRING, expression STRING",
    )
    tables = spark.createDataFrame([("m", t) for t in ("Fact", "Dim", "Other")], "semantic_model_id STRING, table_name STRING")
    included = tables.where("table_name = 'Fact'")
    assert rows(refs.external_table_refs(measures, included, tables)) == [("m", "Dim", "Key")]
    assert rows(refs.own_table_columns(measures)) == [("m", "Fact", "Qty")]


def test_search(cat, rows):
    found = refs.search_measures(cat["semantic_model_measure"], "COUNTROWS(DIM#")
    assert rows(found, "measure_name") == [("Key",)]
    assert refs.search_measures(cat["semantic_model_measure"], "50%_").count() == 0


def test_one_model_with_most_measures_keeps_all_rows(spark):
    n = 3000
    measures = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("m"), F.col("id") % 50)).alias("semantic_model_id"),
        F.lit("T").alias("table_name"),
        F.concat(F.lit("x"), F.col("id")).alias("measure_name"),
        F.lit("SUM(T[A]) + COUNTROWS(T)").alias("expression"),
    )
    tables = measures.select("semantic_model_id", "table_name").distinct().withColumn("is_calculated", F.lit(False))
    deps = refs.direct_dependencies({"semantic_model_measure": measures, "semantic_model_table": tables})
    assert deps.groupBy("dependency_type").count().orderBy("dependency_type").collect() == [("column", n), ("table", n)]


def test_options_of_dependencies(spark, rows):
    from modelsieve.operators import graph
    from modelsieve.schemas import conform

    def table(name, data, ddl):
        return conform(spark.createDataFrame(data, ddl), name)

    cat = {
        "semantic_model_table": table("semantic_model_table", [("m", "Date"), ("m", "Internet Sales"), ("m", "Sales")], "semantic_model_id STRING, table_name STRING"),
        "semantic_model_column": table("semantic_model_column", [("m", "Sales", "Amount")], "semantic_model_id STRING, table_name STRING, column_name STRING"),
        "semantic_model_measure": table(
            "semantic_model_measure",
            [
                ("m", "Sales", "A", "COUNTROWS('Internet Sales') + SUM(Sales[AMOUNT])\n-- Date[Old]\n+ [B]"),
                ("m", "Sales", "B", "CALCULATE(MIN(Sales[amount]))"),
            ],
            "semantic_model_id STRING, table_name STRING, measure_name STRING, expression STRING",
        ),
    }
    columns = ("measure_name", "dependency_type", "referenced_table", "referenced_name")
    plain = set(rows(refs.direct_dependencies(cat), *columns))
    assert ("A", "column", "Sales", "AMOUNT") in plain and ("A", "column", "Date", "Old") in plain
    assert ("A", "table", None, "Internet Sales") not in plain
    direct = refs.direct_dependencies(cat, include_quoted=True, spell_columns=True, dash_comments=True)
    assert set(rows(direct, *columns)) == {
        ("A", "column", "Sales", "Amount"), ("A", "table", None, "Internet Sales"), ("A", "measure", "Sales", "B"), ("B", "column", "Sales", "Amount"),
        ("A", "table", None, "Sales"), ("B", "table", None, "Sales"),
    }
    functions = refs.function_dependencies(cat["semantic_model_measure"])
    closed = graph.transitive_dependencies(direct.unionByName(functions)).where("dependency_type = 'function'")
    assert rows(closed, "measure_name", "referenced_name") == [
        ("A", "CALCULATE"), ("A", "COUNTROWS"), ("A", "MIN"), ("A", "SUM"), ("B", "CALCULATE"), ("B", "MIN"),
    ]


@pytest.mark.parametrize(
    ("expression", "seen"),
    [
        # beside the block that declares it, among the arguments of a call
        ("CALCULATE(VAR Sales = 1 RETURN Sales, Sales)", True),
        ("SUMX((VAR Sales = 1 RETURN Sales + 1), COUNTROWS(Sales))", True),
        # before its declaration
        ("VAR x = COUNTROWS(Sales) VAR Sales = 2 RETURN Sales", True),
        # in its own block, also further in, and in a block of its own there
        ("VAR Sales = 1 RETURN Sales", False),
        ("VAR Sales = 1 RETURN CALCULATE(MAX(Sales, 2), (Sales))", False),
        ("VAR a = 1 RETURN IF(a > 0, VAR Sales = MAX(a, 2) RETURN (Sales) * Sales, 3)", False),
        ("VAR Sales = 1 RETURN IF(TRUE(), VAR Sales = 2 RETURN Sales, Sales)", False),
        ("IF(TRUE(), VAR Sales = 1 RETURN Sales, VAR Sales = 2 RETURN Sales)", False),
        # two blocks, the second without it
        ("IF(TRUE(), VAR Sales = 1 RETURN Sales, VAR s = COUNTROWS(sales) RETURN s)", True),
    ],
)
def test_variables_hide_tables_in_their_scope_only(spark, rows, expression, seen):
    measures = spark.createDataFrame([("m", "T", "x", expression)], "semantic_model_id STRING, table_name STRING, measure_name STRING, expression STRING")
    tables = spark.createDataFrame([("m", "Sales"), ("m", "T")], "semantic_model_id STRING, table_name STRING")
    assert rows(refs.bare_table_refs(measures, tables, scoped_variables=True), "ref_table") == ([("Sales",)] if seen else [])
    assert rows(refs.bare_table_refs(measures, tables)) == []
