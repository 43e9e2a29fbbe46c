from pyspark.sql import functions as F

from modelsieve.functions import expressions as X
from modelsieve.functions.names import field_part, safe_name, table_part
from modelsieve.operators.refs import reference_rows


def one(spark, text, make):
    df = spark.createDataFrame([(text,)], "t STRING")
    return df.select(make(F.col("t")).alias("r")).first()["r"]


def test_metadata_lines_end_the_expression(spark):
    text = "SUM(T[A])\n\t\tLineageTag: 1\n+ [M]"
    assert one(spark, text, X.cut_metadata) == "SUM(T[A])"
    assert one(spark, "a\nchangedProperty = X\nb", X.cut_metadata) == "a"
    assert one(spark, "a\nformatString: 0", X.cut_metadata) == "a"
    assert one(spark, "a + lineagetag: x", X.cut_metadata) == "a + lineagetag: x"


def test_comments_are_blanked_but_not_inside_names_and_strings(spark):
    text = "A // [x]\n/* [y]\n[z] */ + [Cost // unit] & \"http://x\" & 'a//b'[c]"
    cleaned = one(spark, text, X.clean_expression)
    assert "[x]" not in cleaned and "[y]" not in cleaned and "[z]" not in cleaned
    for kept in ("[Cost // unit]", '"http://x"', "'a//b'"):
        assert kept in cleaned


def tokens(spark, text):
    df = spark.createDataFrame([("m", text)], "id STRING, t STRING")
    found = reference_rows(df, "t", ["id"]).select("raw_table", "raw_field")
    return [tuple(r) for r in found.collect()]


def test_reference_forms(spark):
    assert tokens(spark, "SUM('My Table'[Col A]) + T2 [ B ] + [M 1]") == [("My Table", "Col A"), ("T2", "B"), ("", "M 1")]
    assert tokens(spark, "'O''Brien'[x]") == [("O'Brien", "x")]
    assert tokens(spark, "Internet Sales[Amount]") == [("Internet Sales", "Amount")]


def test_keywords_before_a_reference_are_not_table_names(spark):
    assert tokens(spark, "VAR a = b\nRETURN [M]") == [("", "M")]
    assert tokens(spark, "x IN Sales[K]") == [("Sales", "K")]
    assert tokens(spark, "NOT [Flag] && a") == [("", "Flag")]


def test_string_literals_hold_no_references(spark):
    assert tokens(spark, '"[no] T[no] ""[no]""" & [yes]') == [("", "yes")]


def test_functions_and_variables(spark):
    text = "VAR total = CALCULATE(SUM(T[A]))\nvar Second = stdev.p (T[B])\nRETURN total"
    assert one(spark, text, X.called_names) == ["CALCULATE", "SUM", "STDEV.P"]
    assert one(spark, text, X.declared_variables) == ["total", "Second"]


def test_long_texts_need_no_recursion(spark):
    words = "word " * 200_000
    assert tokens(spark, words + "[M]")[-1][1] == "M"
    assert tokens(spark, words + "'" + "x" * 300_000) == []
    assert one(spark, '"' + "a" * 300_000 + '" // c', X.clean_expression).endswith(" ")


def test_light_references(spark):
    found = one(spark, "SUM(Dim[Key]) + Fact [ A B ] + [M] + 'Q'[x] + Ñ[y]", X.light_references)
    assert [(f["table"], f["column"]) for f in found] == [("Dim", "Key"), ("Fact", "A B")]


def test_names(spark):
    assert one(spark, "  Año/Ventas: 2024?* ", safe_name) == "Año_Ventas_ 2024__"
    assert one(spark, "T.a.b", table_part) == "T"
    assert one(spark, "T.a.b", field_part) == "a.b"
    assert one(spark, "nodot", field_part) is None
