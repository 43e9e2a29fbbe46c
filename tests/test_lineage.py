"""Physical sources of model columns."""

import pytest
from pyspark.sql import functions as F

from modelsieve.functions import source_steps as S
from modelsieve.operators import lineage, subset

FACT = '''let
Source = Sql.Database("srv", "dw"),
dbo_Fact = Source{[Schema="dbo",Item="FactSales"]}[Data],
#"Renamed = ""Columns""" = Table.RenameColumns(dbo_Fact,{{"a", "b"}, {"b", "c"},
{"x ""y""", "z"}}),
Unused = Table.RenameColumns(dbo_Fact, {{"q", "c"}}),
#"Removed Other" = Table.SelectColumns(#"Renamed = ""Columns""",{"b", "c", "z", "d"}),
Again = Table.RenameColumns(#"Removed Other", {{"c", "final"}})
in
Again'''


def source(spark, text):
    return spark.createDataFrame([(text,)], "q string").select(S.source_of(F.col("q")).alias("s")).first()["s"]


def test_steps_are_followed_back_from_the_result(spark):
    found = source(spark, FACT)
    assert (found["schema_name"], found["source_table"]) == ("dbo", "FactSales")
    assert found["renames"] == [{"final": "c"}, {"b": "a", "c": "b", 'z': 'x "y"'}]
    names = spark.createDataFrame([(n,) for n in ("final", "b", "z", "d", "c")], "n string").withColumn("q", F.lit(FACT))
    physical = names.select("n", S.physical_name(S.source_of(F.col("q"))["renames"], F.col("n")).alias("p"))
    # The pairs of one step hold at once: c was b, and b was a.
    assert dict(map(tuple, physical.collect())) == {"final": "b", "b": "a", "z": 'x "y"', "d": "d", "c": "b"}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('let Source = X.Y("a"), T = Source{[Name="t"]}[Data] in T', (None, "t")),
        ('let\nS = Sql.Databases("s"),\ndb = S{[Name="dw"]}[Data],\nt = db{[Schema="s 1",Item="T 1"]}[Data]\nin\nt', ("s 1", "T 1")),
        ("let\na = 1\nin\na", (None, None)),
        ("FILTER(T, T[a] > 0)", (None, None)),
        ("let\na = b,\nb = a\nin\na", (None, None)),
        ("", (None, None)),
        (None, (None, None)),
    ],
)
def test_sources_of_queries(spark, text, expected):
    found = source(spark, text)
    assert ((found and found["schema_name"]), (found and found["source_table"])) == expected


def test_data_is_pruned_by_physical_names(spark, rows):
    ddl = "semantic_model_id STRING, table_name STRING"
    columns = spark.createDataFrame(
        [("m", "Sales", "Final", "final"), ("m", "Sales", "Day", "d"), ("m", "Sales", "Calc", None), ("m", "Plain", "k", "k")],
        ddl + ", column_name STRING, source_column STRING",
    )
    partitions = spark.createDataFrame([("m", "Sales", "p", FACT), ("m", "Plain", "p", "let\nx = 1\nin\nx")], ddl + ", partition_name STRING, source_expression STRING")
    known = lineage.physical_columns(columns, partitions)
    assert rows(known, "table_name", "column_name", "source_table", "source_name") == [("Sales", "Day", "FactSales", "d"), ("Sales", "Final", "FactSales", "b")]
    kept = columns.where("column_name <> 'Day'")
    tables = {"FactSales": spark.range(3).selectExpr("id as a", "id as b", "id as d"), "Plain": spark.range(2).selectExpr("id as k", "id as z")}
    pruned = subset.prune_tables(tables, kept, "m", known)
    assert {name: df.columns for name, df in pruned.items()} == {"FactSales": ["b"], "Plain": ["k"]}
