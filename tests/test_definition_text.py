import pytest

from modelsieve.operators import extract_model as XM
from modelsieve.operators.subset import drop_invalid_variations
from modelsieve.sources.definitions import FILES_DDL

SALES = """table 'Sales Fact'
\tlineageTag: 1
\tisHidden

\tmeasure 'Total Amount' = SUM('Sales Fact'[Amount])
\t\tformatString: 0.00
\t\tlineageTag: 2

\tmeasure Margin =
\t\t\tVAR cost = SUM(Sales[Cost])

\t\t\tRETURN [Total Amount] - cost
\t\tformatString: "0 %"
\t\tisHidden
\t\tdisplayFolder: Money

\t\tannotation X = 1

\tmeasure Fenced = ```
\t\t\tVAR a = 1

\t\t  formatString: not a property
column fake
\t\t\tRETURN a
\t\t\t```
\t\tlineageTag: 3

\tcolumn Amount
\t\tdataType: decimal
\t\tsummarizeBy: sum
\t\tsourceColumn: Amount

\t\tvariation Variation
\t\t\tisDefault
\t\t\trelationship: rel-1
\t\t\tdefaultHierarchy: Dates.'Date Hierarchy'

\t\tvariation Loose
\t\t\tisDefault

\t\tannotation __PBI_SemanticLinks = [{"LinkTarget":{"TableName":"Sales Fact","TableItemName":"Amount (bins)","ObjectType":4},"LinkType":"UsedInGroup"},{"LinkTarget":{"TableName":"","TableItemName":"x","ObjectType":4},"LinkType":"UsedInGroup"},{"LinkTarget":{"TableName":"T","TableItemName":"y","ObjectType":3},"LinkType":"UsedInGroup"}]

\tcolumn 'Order Day' = FORMAT([Date], "dddd")
\t\tdataType: string
\t\tisHidden
\t\tsortByColumn: 'Day Number'

\tcolumn 'It''s'
\t\tdataType: string
\t\tisHidden: true

\thierarchy 'Date Hierarchy'

\t\tlevel Year
\t\t\tcolumn: Year

\tpartition 'Sales Fact' = m
\t\tmode: directQuery
\t\tsource =
\t\t\t\tlet
\t\t\t\t    a = Source,

\t\t\t\t    b = a
\t\t\t\tin b

\tpartition Calc = calculated
\t\tmode: import
\t\tsource = FILTER(Dates, Dates[Year] > 2000)

\tannotation Kind = Table
"""

RELATIONSHIPS = """relationship rel-1
\tfromColumn: 'Sales Fact'.'Order Key'
\ttoColumn: Dates.Key

relationship rel-2
\tisActive: false
\tcardinality: manyToMany
\tcrossFilteringBehavior: bothDirections
\tsecurityFilteringBehavior: oneDirection
\tfromColumn: 'O''Brien. Inc'.A
\ttoColumn: 'B'.'C.D'

relationship broken
\tfromColumn: nodot
\ttoColumn: Dates.Key
"""

MODEL = """model Model
\tculture: es-ES
\tsourceQueryCulture: en-US
\tdataAccessOptions
\t\tlegacyRedirects
\t\tmode: fast

annotation Order = ["a","b"]
annotation Order = ["c"]
ref table Sales
"""


@pytest.fixture
def files(spark):
    data = [
        ("ws", "local_Shop", "Shop", "model", f"definition/{path}", text)
        for path, text in (
            ("tables/Sales Fact.tmdl", SALES),
            ("tables/Windows.tmdl", "table Windows\r\n\r\n\tcolumn A\r\n\t\tdataType: int64\r\n\t\tisHidden: false\r\n"),
            ("relationships.tmdl", RELATIONSHIPS),
            ("model.tmdl", MODEL),
        )
    ]
    return spark.createDataFrame(data, FILES_DDL)


@pytest.fixture
def cat(files):
    return XM.extract_model_catalog(files)


def test_tables(cat, rows):
    assert rows(cat["semantic_model_table"], "table_name", "is_hidden", "is_calculated", "source_code") == [
        ("Sales Fact", True, True, "FILTER(Dates, Dates[Year] > 2000)"),
        ("Windows", False, False, None),
    ]


def test_columns(cat, rows):
    found = rows(cat["semantic_model_column"], "table_name", "column_name", "data_type", "summarize_by", "is_hidden", "sort_by_column")
    assert set(found) == {
        ("Sales Fact", "Amount", "decimal", "sum", False, None),
        ("Sales Fact", "Order Day", "string", None, True, "Day Number"),
        ("Sales Fact", "It's", "string", None, True, None),
        ("Windows", "A", "int64", None, False, None),
    }


def test_measures(cat, rows):
    found = {name: rest for name, *rest in rows(cat["semantic_model_measure"], "measure_name", "expression", "format_string", "is_hidden")}
    assert found == {
        "Total Amount": ["SUM('Sales Fact'[Amount])", "0.00", False],
        "Margin": ["VAR cost = SUM(Sales[Cost])\nRETURN [Total Amount] - cost", "0 %", True],
        "Fenced": ["\t\t\tVAR a = 1\n\n\t\t  formatString: not a property\ncolumn fake\n\t\t\tRETURN a", None, False],
    }


def test_partitions(cat, rows):
    assert rows(cat["semantic_model_partitions"], "partition_name", "source_type", "mode", "source_expression") == [
        ("Calc", "calculated", "import", "FILTER(Dates, Dates[Year] > 2000)"),
        ("Sales Fact", "m", "directQuery", "let\na = Source,\nb = a\nin b"),
    ]


def test_relationships(cat, rows):
    found = rows(cat["semantic_model_relationship"].drop("semantic_model_id"))
    assert found == [
        ("rel-1", "Sales Fact", "Order Key", "Dates", "Key", None, None, None, True),
        ("rel-2", "O'Brien. Inc", "A", "B", "C.D", "manyToMany", "bothDirections", "oneDirection", False),
    ]


def test_bins(cat, rows):
    assert rows(cat["semantic_model_table_bins"]) == [("local_Shop", "Sales Fact", "Amount", "Sales Fact", "Amount (bins)")]


def test_model_header(cat):
    header = cat["semantic_model"].first()
    assert (header["name"], header["culture"], header["source_query_culture"]) == ("Shop.SemanticModel", "es-ES", "en-US")
    assert header["data_access_options"] == {"legacyRedirects": "true", "mode": "fast"}
    assert header["annotations"] == {"Order": '["c"]'}


def test_variations_follow_kept_relationships(spark, files, rows):
    variations = XM.extract_variations(XM.attribute_blocks(files))
    assert rows(variations, "variation_name", "relationship_name") == [("Loose", None), ("Variation", "rel-1")]
    kept = spark.createDataFrame([("local_Shop", "rel-1")], "semantic_model_id STRING, relationship_name STRING")
    assert rows(drop_invalid_variations(variations, kept), "variation_name") == [("Variation",)]
    assert drop_invalid_variations(variations, kept.limit(0)).count() == 0


def test_lines_belong_to_blocks_by_indentation(files, rows):
    lines = XM.block_lines(XM.attribute_blocks(files)).where("kind = 'partition' and block_name = 'Calc'")
    assert [line.strip() for (line,) in rows(lines, "line")] == ["mode: import", "source = FILTER(Dates, Dates[Year] > 2000)"]


def test_a_large_file_stays_linear(spark):
    body = "".join(f"\tcolumn c{i}\n\t\tdataType: int64\n\n" for i in range(20_000))
    source = "\tpartition p = m\n\t\tmode: import\n\t\tsource =\n" + "\t\t\t\tx\n" * 100_000
    df = spark.createDataFrame([("w", "i", "i", "model", "definition/tables/T.tmdl", "table T\n\n" + body + source)], FILES_DDL)
    blocks = XM.attribute_blocks(df)
    assert XM.extract_columns(blocks).where("data_type = 'int64'").count() == 20_000
    assert len(XM.extract_partitions(blocks).first()["source_expression"]) == 200_000 - 1


def test_header_words_open_blocks_only_at_their_depth(spark, rows):
    text = (
        "table T\n\tmeasure M =\n\t\t\tVAR x = 1\n\t\t\tcolumn + x\n\t\t\tmeasure - x\n\t\t\tRETURN x\n\t\tformatString: 0\n\n"
        "\tcolumn A\n\t\tdataType: int64\n\n"
        "\tpartition T = m\n\t\tmode: import\n\t\tsource =\n\t\t\t\tlet\n\t\t\t\t  table = src{[Item=\"Sales\"]}[Data],\n"
        "\t\t\t\t  column = 5\n\t\t\t\tin table\n"
    )
    spaced = text.replace("\t", "  ").replace("\n", "\r\n")
    files = [("w", f"m{i}", "M", "model", "definition/tables/T.tmdl", t) for i, t in enumerate((text, spaced))]
    blocks = XM.attribute_blocks(spark.createDataFrame(files, FILES_DDL))
    for i in (0, 1):
        mine = blocks.where(f"semantic_model_id = 'm{i}'")
        assert rows(mine, "kind", "block_name") == [("column", "A"), ("measure", "M"), ("partition", "T"), ("table", "T")]
        assert XM.extract_measures(mine).first()["expression"] == "VAR x = 1\ncolumn + x\nmeasure - x\nRETURN x"
        source = 'let\ntable = src{[Item="Sales"]}[Data],\ncolumn = 5\nin table'
        assert XM.extract_partitions(mine).first()["source_expression"] == source


@pytest.mark.parametrize(
    ("value", "parts"),
    [
        ("Fact.Key", ("Fact", "Key")),
        ("'Dim 1'.'The ''Key'''", ("Dim 1", "The 'Key'")),
        ("'A.B'.C", ("A.B", "C")),
        ("one", (None, None)),
        ("a.b.c", (None, None)),
        ("a..b", (None, None)),
    ],
)
def test_relationship_ends(spark, value, parts):
    from pyspark.sql import functions as F

    from modelsieve.functions import definition_text as T

    frame = spark.createDataFrame([(value,)], "v STRING")
    assert tuple(frame.select(T.endpoint_part(F.col("v"), 1), T.endpoint_part(F.col("v"), 2)).first()) == parts


MIXED = """table T
  /// a note two blanks in
\tmeasure A = 1
\t    formatString: 0
    measure B =
\t\t\tcolumn + 1
        isHidden
  column C
\tdataType: int64
        sourceColumn: c
\t/// column D
\tannotation Look =
\t\tcolumn not this one
  partition P = m
\t\tmode: import
        source =
\t\t\t\tlet
\t\t\t\ttable = x,
                column y
\t\t\t\tin table
"""


def members(spark, text):
    files = spark.createDataFrame([("ws", "m", "M", "model", "definition/tables/T.tmdl", text)], FILES_DDL)
    return XM.attribute_blocks(files)


def test_members_by_an_indentation_stack(spark, rows):
    blocks = members(spark, MIXED)
    assert [(r["kind"], r["block_name"]) for r in blocks.orderBy("block_no").collect()] == [
        ("table", "T"), ("measure", "A"), ("measure", "B"), ("column", "C"), ("partition", "P"),
    ]
    assert rows(XM.extract_measures(blocks), "measure_name", "expression", "format_string", "is_hidden") == [
        ("A", "1", "0", False), ("B", "column + 1", None, True),
    ]
    assert rows(XM.extract_columns(blocks), "column_name", "data_type", "source_column") == [("C", "int64", "c")]
    assert rows(XM.extract_partitions(blocks), "partition_name", "mode", "source_expression") == [
        ("P", "import", "let\ntable = x,\ncolumn y\nin table"),
    ]


@pytest.mark.parametrize("first", ["  /// note", "   // note", "      ", "\t\t/// far in", ""])
@pytest.mark.parametrize("step", ["\t", "  ", "    ", " \t"])
def test_a_first_line_does_not_decide_the_depth_of_members(spark, rows, first, step):
    text = f"table T\n{first}\n{step}measure m = 1\n{step}{step}isHidden\n\n{step}column c\n{step}{step}dataType: string\n"
    assert rows(members(spark, text), "kind", "block_name") == [("column", "c"), ("measure", "m"), ("table", "T")]


def test_a_long_file_is_cut_in_one_pass(spark):
    text = "table T\n" + "".join(f"\tcolumn c{i}\n\t\tdataType: int64\n" for i in range(3000))
    assert members(spark, text).count() == 3001
