"""Catalog tables and definition files expressed over the star-schema test tables.

Every row is computed from rows of the given tables, so the catalog grows with the data:
parts become measures, columns and tables; customers become reports; order lines and events
become usage; suppliers become workspaces; nations become models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.operators.refs import calculated_table_dependencies, direct_dependencies
from modelsieve.plans.fixpoint import distinct_rows, materialize
from modelsieve.schemas import conform

Catalog = dict[str, DataFrame]

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table whose rows go into costly text work, dealt out evenly before the texts are built.

    A table of few files gives few scan tasks, so its short rows are dealt out by their key, the
    first column. The number is given, as adaptive execution would merge partitions by the size of the
    short rows.
    """
    df = load(spark, sf_dir, name)
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), df.columns[0])


def _sql(df: DataFrame, *columns: str) -> DataFrame:
    return df.selectExpr(*columns)


def type_name(index: str) -> str:
    """SQL text that turns a number into one of the part types."""
    names = ", ".join(f"'{t}'" for t in TYPES)
    return f"element_at(array({names}), cast({index} as int) + 1)"


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(spark, sf_dir, "part")
    expression = r"""concat(
        'VAR v_', p_partkey, ' = SUM(''', if(p_partkey % 2 = 1, upper(p_brand), p_brand), '''[', p_type, ']) // old: [m0]', chr(10),
        'RETURN v_', p_partkey,
        if(p_partkey >= 25, concat(if(p_partkey % 4 = 0, ' + [M', ' + [m'), (p_partkey div 50) * 25 + p_partkey % 25, ']'), ''),
        if(p_partkey % 3 = 0, concat(' + MAX(Dim_', p_type, '[Size_', p_size, '])'), ''),
        if(p_partkey % 7 = 0, concat(' + COUNTROWS(Dim_', p_type, ')'), ''),
        if(p_partkey % 13 = 0, concat(' + COUNTROWS(Calc_', p_size, ')'), ''),
        if(p_partkey % 11 = 0, concat(' + [Budget ', p_size, ']'), ''),
        ' & "[text]"', chr(10), 'lineageTag: ', p_partkey)"""
    return _sql(
        part,
        "concat('sm', p_partkey % 25) as semantic_model_id",
        "p_brand as table_name",
        "concat('m', p_partkey) as measure_name",
        f"{expression} as expression",
        "if(p_partkey % 2 = 0, '0.00', null) as format_string",
        "p_partkey % 9 = 0 as is_hidden",
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(
        _sql(
            load(spark, sf_dir, "nation"),
            "concat('sm', n_nationkey) as semantic_model_id",
            "concat('w', n_nationkey * 3) as workspace_id",
            "concat(n_name, '.SemanticModel') as name",
            "if(n_regionkey % 2 = 0, 'es-ES', 'en-US') as culture",
        ),
        "semantic_model",
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").withColumn("semantic_model_id", F.expr("concat('sm', p_partkey % 25)"))
    plain = _sql(
        part,
        "semantic_model_id",
        "stack(2, p_brand, false, concat('Dim_', p_type), p_type = 'SMALL') as (table_name, is_hidden)",
    ).distinct()
    plain = plain.withColumn("is_calculated", F.lit(False)).withColumn("source_code", F.lit(None).cast("string"))
    calculated = (
        part.groupBy("semantic_model_id", "p_size")
        .agg(F.min("p_type").alias("t"), F.min("p_partkey").alias("k"))
        .selectExpr(
            "semantic_model_id",
            "concat('Calc_', p_size) as table_name",
            "false as is_hidden",
            "true as is_calculated",
            "concat('FILTER(Dim_', t, ', Dim_', t, '[Key] > 0)', "
            "if(p_size % 4 <> 0, concat(chr(10), '+ COUNTROWS(Calc_', p_size - 1, ')'), ''), ' + [m', k, ']') as source_code",
        )
    )
    return conform(plain.unionByName(calculated), "semantic_model_table")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    rows = _sql(
        part,
        "concat('sm', p_partkey % 25) as semantic_model_id",
        """stack(6,
            p_brand, p_type, 'decimal', case p_type when 'PROMO' then 'SMALL' when 'SMALL' then 'Key' end,
            p_brand, 'Key', 'int64', cast(null as string),
            if(p_size > 45, p_brand, null), concat(p_type, ' (bins)'), 'string', cast(null as string),
            concat('Dim_', p_type), concat('Size_', p_size), 'int64', cast(null as string),
            concat('Dim_', p_type), 'Key', 'int64', cast(null as string),
            concat('Calc_', p_size), 'Value', 'double', cast(null as string)
            ) as (table_name, column_name, data_type, sort_by_column)""",
    )
    return conform(
        rows.where("table_name is not null").distinct().withColumn("is_hidden", F.col("column_name") == "Key"),
        "semantic_model_column",
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _sql(
        load(spark, sf_dir, "part"), "concat('sm', p_partkey % 25) as semantic_model_id", "p_brand", "p_type"
    ).distinct()
    return conform(
        _sql(
            pairs,
            "semantic_model_id",
            "concat('rel_', p_brand, '_', p_type) as relationship_name",
            "p_brand as from_table",
            "'Key' as from_column",
            "concat('Dim_', p_type) as to_table",
            "'Key' as to_column",
            "case p_type when 'LARGE' then 'oneToOne' when 'PROMO' then 'manyToMany' end as cardinality",
            "p_type <> 'SMALL' as is_active",
        ),
        "semantic_model_relationship",
    )


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(
        load(spark, sf_dir, "part").where("p_size > 45"),
        "concat('sm', p_partkey % 25) as semantic_model_id",
        "p_brand as table_name",
        "p_type as source_column",
        "p_brand as bin_table",
        "concat(p_type, ' (bins)') as bin_column",
    ).distinct()


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(
        load(spark, sf_dir, "part"),
        "concat('sm', p_partkey % 25) as semantic_model_id",
        "p_brand as table_name",
        "concat('part-', p_partkey) as partition_name",
        "'m' as source_type",
        "case p_partkey % 4 when 0 then 'import' when 1 then 'directQuery' when 2 then 'dual' end as mode",
        "concat('let', chr(10), '    a = ', p_partkey, if(p_size > 25, concat(chr(10), 'x', chr(10), 'y', chr(10), 'z'), ''), "
        "chr(10), 'in', chr(10), '    a') as source_expression",
    )


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(
        load(spark, sf_dir, "supplier"),
        "concat('w', s_suppkey) as id",
        "s_name as displayName",
        "if(s_suppkey % 3 = 0, null, concat('nation ', s_nationkey)) as description",
        "case s_suppkey % 4 when 0 then 'workspace' when 1 then 'Workspace' end as type",
        "if(s_suppkey % 2 = 0, concat('cap', s_nationkey), null) as capacityId",
        "if(s_acctbal > 5000, 'F64', null) as capacitySku",
        "cast(null as string) as domainId",
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").selectExpr("n_nationkey as c_nationkey", "n_name")
    return _sql(
        load(spark, sf_dir, "customer").join(nation, "c_nationkey"),
        "concat('r', c_custkey) as report_id",
        "n_name as name",
        "concat('w', c_custkey % 100) as workspace_id",
        "concat('sm', c_custkey % 30) as semantic_model_reference",
        "'p1' as active_page_name",
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey")
    return load(spark, sf_dir, "lineitem").join(orders, "l_orderkey")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(
        _sql(
            _lines(spark, sf_dir),
            "concat('r', o_custkey) as report_id",
            "concat('p', l_linenumber) as name",
            "concat('Page ', l_linenumber) as display_name",
            "720 as height",
            "1280 as width",
            "l_linenumber <> 7 as is_visible",
            "l_linenumber as position",
        ).distinct(),
        "report_page",
    )


def visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(
        _sql(
            _lines(spark, sf_dir),
            "concat('r', o_custkey) as report_id",
            "concat('p', l_linenumber) as page_name",
            "concat(l_returnflag, l_linestatus) as name",
            "case l_returnflag when 'R' then 'card' when 'A' then 'slicer' else 'tableEx' end as visual_type",
            "cast(l_linenumber * 10 as double) as x",
            "cast(0 as double) as y",
            "cast(100 as double) as width",
            "cast(100 as double) as height",
        ).distinct(),
        "report_visual",
    )


def measure_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer").selectExpr("c_custkey as o_custkey", "c_nationkey")
    part = load(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_brand")
    used = (
        _lines(spark, sf_dir)
        .join(customer, "o_custkey")
        .withColumn("k", F.expr("(l_partkey div 50) * 25 + c_nationkey"))
        .groupBy("o_custkey", "l_linenumber", "l_returnflag", "l_linestatus", "k")
        .agg(F.count(F.lit(1)).alias("usage_count"))
        .join(part, "k")
    )
    return _sql(
        used,
        "concat('r', o_custkey) as report_id",
        "concat('p', l_linenumber) as page_name",
        "concat(l_returnflag, l_linestatus) as visual_name",
        "p_brand as table_name",
        "concat('m', k) as measure_name",
        "usage_count",
    )


def column_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("k", F.expr("cast(get_json_object(props, '$.k') as int)"))
    return (
        _sql(
            events,
            "concat('r', user_id) as report_id",
            "event_type as page_name",
            "concat('v', event_id % 7) as visual_name",
            "concat('Brand#', k % 25 + 1) as table_name",
            f"{type_name('k % 6')} as column_name",
        )
        .groupBy("report_id", "page_name", "visual_name", "table_name", "column_name")
        .agg(F.count(F.lit(1)).alias("usage_count"))
    )


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(
        _sql(
            load(spark, sf_dir, "orders"),
            "concat('r', o_custkey) as report_id",
            "if(o_orderstatus = 'P', 'page', 'report') as level",
            "if(o_orderstatus = 'P', 'p1', null) as page_name",
            "concat('f', o_orderkey) as filter_name",
            f"concat('Dim_', {type_name('o_orderkey % 6')}) as table_name",
            "concat('Size_', o_orderkey % 50 + 1) as column_name",
        ),
        "report_filter",
    )


_BUILDERS = {
    "workspaces": workspaces,
    "semantic_model": models,
    "semantic_model_table": tables,
    "semantic_model_column": columns,
    "semantic_model_measure": measures,
    "semantic_model_relationship": relationships,
    "semantic_model_table_bins": bins,
    "semantic_model_partitions": partitions,
    "report": reports,
    "report_page": pages,
    "report_visual": visuals,
    "report_column_used": column_used,
    "report_measure_used": measure_used,
    "report_filter": filters,
}


class _Tables(Mapping):
    """Catalog tables that are set up when a query asks for them."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]) -> None:
        self._builders = builders
        self._built: Catalog = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def catalog(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """The catalog without the tables that are computed from expressions."""
    return _Tables({name: partial(build, spark, sf_dir) for name, build in _BUILDERS.items()})


def resolved_catalog(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """The catalog with direct measure dependencies and calculated-table dependencies."""
    cat = catalog(spark, sf_dir)
    builders: dict[str, Callable[[], DataFrame]] = {name: partial(cat.__getitem__, name) for name in cat}
    builders["measure_dependencies"] = lambda: materialize(direct_dependencies(cat), "direct")
    builders["calculated_table_dependencies"] = lambda: materialize(calculated_table_dependencies(cat), "calculated")
    return _Tables(builders)


def data_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part → supplier → nation → region as relationships of one model."""
    lines = load(spark, sf_dir, "lineitem")
    pairs = distinct_rows(lines.select("l_partkey", "l_suppkey"), lines.count())
    none = "cast(null as string) as cardinality"
    parts = [
        _sql(pairs, "concat('p', l_partkey) as from_table", "concat('s', l_suppkey) as to_table", none),
        _sql(
            load(spark, sf_dir, "supplier"),
            "concat('s', s_suppkey) as from_table",
            "concat('n', s_nationkey) as to_table",
            "if(s_suppkey % 5 = 0, 'oneToOne', 'manyToOne') as cardinality",
        ),
        _sql(load(spark, sf_dir, "nation"), "concat('n', n_nationkey) as from_table", "concat('g', n_regionkey) as to_table", none),
    ]
    edges = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return edges.withColumn("semantic_model_id", F.lit("data")).withColumn("is_active", F.lit(True))


def data_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand, looking up; nations of one region, looking both ways."""
    brand = load(spark, sf_dir, "part").where("p_brand = 'Brand#1'")
    nations = load(spark, sf_dir, "nation").where("n_regionkey = 0")
    seeds = _sql(brand, "concat('p', p_partkey) as table_name", "'ManyToOne' as direction").unionByName(
        _sql(nations, "concat('n', n_nationkey) as table_name", "'Both' as direction")
    )
    return seeds.withColumn("semantic_model_id", F.lit("data"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table definition file per part; a third is indented by blanks, a third has an odd first line."""
    content = r"""concat(
        'table ''', p_brand, '-', p_partkey, '''', chr(10), if(p_partkey % 3 = 2, concat('  /// a note on ', p_name, chr(10)), ''),
        if(p_size > 40, concat(chr(9), 'isHidden', chr(10)), ''),
        chr(9), 'lineageTag: t', p_partkey, chr(10), chr(10),
        chr(9), 'measure ''M ', p_partkey, ''' = SUM(''', p_brand, '''[', p_type, '])', chr(10),
        chr(9), chr(9), 'formatString: 0', chr(10),
        chr(9), chr(9), 'lineageTag: a', p_partkey, chr(10), chr(10),
        chr(9), 'measure n', p_partkey, ' =', chr(10),
        chr(9), chr(9), chr(9), 'VAR x = ', p_size, chr(10),
        chr(9), chr(9), chr(9), 'column + x', chr(10),
        chr(9), chr(9), chr(9), 'RETURN x + [M ', p_partkey, ']', chr(10),
        chr(9), chr(9), 'isHidden', chr(10), chr(10),
        chr(9), 'column ', p_type, chr(10),
        chr(9), chr(9), 'dataType: int64', chr(10),
        chr(9), chr(9), 'summarizeBy: none', chr(10),
        chr(9), chr(9), 'sourceColumn: src_', p_type, chr(10),
        chr(9), chr(9), 'sortByColumn: ''Size ', p_size, '''', chr(10), chr(10),
        chr(9), chr(9), 'variation Variation', chr(10),
        chr(9), chr(9), chr(9), 'isDefault', chr(10),
        chr(9), chr(9), chr(9), 'relationship: rel', p_size, chr(10),
        chr(9), chr(9), 'annotation __PBI_SemanticLinks = [{"LinkTarget":{"TableName":"G', p_size,
        '","TableItemName":"', p_type, ' (bins)","ObjectType":', if(p_partkey % 3 = 0, 4, 3), '},"LinkType":"UsedInGroup"}]',
        chr(10), chr(10),
        chr(9), 'column ''Size ', p_size, '''', chr(10),
        chr(9), chr(9), 'dataType: string', chr(10),
        chr(9), chr(9), 'isHidden', chr(10), chr(10),
        chr(9), 'partition ''', p_brand, '-', p_partkey, ''' = ', if(p_partkey % 5 = 0, 'calculated', 'm'), chr(10),
        chr(9), chr(9), 'mode: import', chr(10),
        chr(9), chr(9), 'source =', chr(10),
        chr(9), chr(9), chr(9), chr(9), 'let', chr(10),
        chr(9), chr(9), chr(9), chr(9), '    a = ', p_partkey, chr(10),
        chr(9), chr(9), chr(9), chr(9), '    table = a{[Item="Sales"]}[Data],', chr(10),
        chr(9), chr(9), chr(9), chr(9), 'in a', chr(10), chr(10),
        chr(9), 'annotation Kind = Table', chr(10))"""
    content = f"if(p_partkey % 3 = 1, replace({content}, chr(9), '    '), {content})"
    return _sql(
        spread(spark, sf_dir, "part"),
        "concat('sm', p_partkey % 25) as item_id",
        "concat('Model ', p_partkey % 25) as item_name",
        "'model' as item_kind",
        "concat('definition/tables/', p_brand, '-', p_partkey, '.tmdl') as rel_path",
        f"{content} as content",
    )


def supplier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model header and a relationship file per supplier."""
    header = r"""concat('model Model', chr(10), chr(9), 'culture: ', if(s_suppkey % 2 = 0, 'es-ES', 'en-US'), chr(10),
        chr(9), 'defaultPowerBIDataSourceVersion: powerBI_V3', chr(10),
        chr(9), 'dataAccessOptions', chr(10), chr(9), chr(9), 'legacyRedirects', chr(10),
        chr(9), chr(9), 'timeout: ', s_nationkey, chr(10), chr(10),
        'annotation Region = ', s_nationkey, chr(10), 'ref table X', chr(10))"""
    edges = r"""concat(
        'relationship r', s_suppkey, '-1', chr(10), chr(9), 'fromColumn: Fact.Key', s_nationkey, chr(10),
        chr(9), 'toColumn: ''Dim ', s_nationkey, '''.''The ''''Key''''''', chr(10), chr(10),
        chr(9), 'annotation A = B', chr(10), chr(10),
        'relationship r', s_suppkey, '-2', chr(10), chr(9), 'isActive: false', chr(10),
        chr(9), 'crossFilteringBehavior: bothDirections', chr(10),
        if(s_suppkey % 3 = 0, concat(chr(9), 'cardinality: manyToMany', chr(10)), ''),
        chr(9), 'fromColumn: Fact.A', chr(10), chr(9), 'toColumn: ', if(s_suppkey % 4 = 0, 'broken', 'Dim.B'), chr(10))"""
    return _sql(
        load(spark, sf_dir, "supplier"),
        "concat('sup', s_suppkey) as item_id",
        "s_name as item_name",
        "'model' as item_kind",
        "concat('w', s_nationkey) as workspace",
        "stack(2, 'definition/model.tmdl', " + header + ", 'definition/relationships.tmdl', " + edges + ") as (rel_path, content)",
    )


def _node(kind: str, ref: str, prop: str, more: str = "") -> str:
    return "'\"" + kind + "\":{\"Expression\":{\"SourceRef\":{" + ref + "}}" + more + ",\"Property\":\"'," + prop + ",'\"}'"


#: Parts of a node that reach five and nine levels down and hold a node of their own.
_DEEP = ',"More":{"a":{"b":[{"c":1}]}}'
_DEEPER = ',"More":{"a":{"b":{"c":{"d":{"e":{"f":[{"Column":{"Property":"Inner","Table":"In"}}]}}}}}}'


def visual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One visual document per order, plus page, report and reference documents per customer."""
    entity = "\"Entity\":\"T', o_custkey % 7, '\""
    source_d, source_e = '"Source":"d"', '"Source":"e"'
    doc = f"""concat(
        '{{"name":"v', o_orderkey, '","position":{{"x":', o_orderkey % 100, '.5,"y":10,"height":300}},',
        '"visual":{{"visualType":"', o_orderstatus, '","query":{{"queryState":{{"Y":{{"projections":[{{"field":{{',
        {_node("Measure", entity, "concat('M', o_orderkey % 11)")}, '}},"queryRef":"T', o_custkey % 7, '.M', o_orderkey % 11, '"}}]}},',
        '"Category":{{"projections":[{{"field":{{', {_node("Column", source_d, "concat('C', o_orderkey % 5)")},
        '}},"queryRef":"d.C', o_orderkey % 5, '"}}]}}}},"sortDefinition":{{"sort":[{{"field":{{',
        {_node("Column", entity, "'Sort'", _DEEP)}, '}},"direction":"Descending"}}]}}}},',
        '"objects":{{"text":[{{"properties":{{"text":{{"expr":{{"Literal":{{"Value":"''', o_orderpriority, '''"}}}}}}}}}}],',
        '"fill":[{{"properties":{{"c":{{"expr":{{', {_node("Column", entity, "'Fill'", _DEEPER)}, '}}}}}}}}]}}}},',
        '"prototypeQuery":{{"From":[{{"Name":"d","Entity":"Dim', o_custkey % 3, '"}}]}},',
        '"filterConfig":{{"filters":[{{"name":"f', o_orderkey, '","field":{{', {_node("Column", source_e, "'Flt'")},
        '}},"filter":{{"From":[{{"Name":"e","Entity":"E', o_custkey % 2, '"}}],"Where":[{{"Condition":',
        case o_orderkey % 4 when 0 then '{{"In":{{"Values":[]}}}}' when 1 then '{{"Not":{{"Expression":{{}}}}}}'
             when 2 then '{{"Comparison":{{"ComparisonKind":3}}}}' else '{{"Between":{{}}}}' end, '}}]}}}}]}}}}')"""
    return _sql(
        spread(spark, sf_dir, "orders"),
        "concat('r', o_custkey) as item_id",
        "concat('Report ', o_custkey) as item_name",
        "'report' as item_kind",
        "'ws' as workspace",
        "concat('definition/pages/', o_orderstatus, '/visuals/v', o_orderkey, '/visual.json') as rel_path",
        f"{doc} as content",
    )


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report, reference and page documents per customer."""
    reference = """if(c_custkey % 2 = 0,
        concat('{"datasetReference":{"byPath":{"path":"../Model ', c_nationkey, '.SemanticModel"}}}'),
        concat('{"datasetReference":{"byConnection":{"connectionString":"Data Source=\\\\"powerbi://api.powerbi.com/v1.0/myorg/ws', c_nationkey,
               '\\\\";semanticmodelid=abc-', c_nationkey, '"}}}'))"""
    report = """concat('{"$schema":"s","filterConfig":{"filters":[{"name":"rf","field":{"Aggregation":{"Expression":{"Column":',
        '{"Expression":{"SourceRef":{"Entity":"Seg"}},"Property":"', c_mktsegment, '"}},"Function":0}}}]}}')"""
    def page(code: str) -> str:
        return (
            "concat('{\"name\":\"page" + code + "\",\"displayName\":\"Page " + code + "\",\"height\":720,\"width\":1280,"
            "\"visibility\":', c_custkey % 2, '}')"
        )
    rows = ", ".join(
        [f"'definition.pbir', {reference}", f"'definition/report.json', {report}",
         "'definition/pages/pages.json', '{\"pageOrder\":[\"P\",\"O\",\"F\",\"X\"],\"activePageName\":\"O\"}'"]
        + [f"'definition/pages/{c}/page.json', {page(c)}" for c in ("O", "F", "P")]
    )
    return _sql(
        load(spark, sf_dir, "customer"),
        "concat('r', c_custkey) as item_id",
        "concat('Report ', c_custkey) as item_name",
        "'report' as item_kind",
        "'ws' as workspace",
        f"stack(6, {rows}) as (rel_path, content)",
    )


def legacy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One single-file report per supplier, with JSON inside strings."""
    config = (
        "concat('{\\\\\"name\\\\\":\\\\\"lv', s_suppkey, '\\\\\",\\\\\"singleVisual\\\\\":{\\\\\"visualType\\\\\":\\\\\"card\\\\\","
        "\\\\\"prototypeQuery\\\\\":{\\\\\"From\\\\\":[{\\\\\"Name\\\\\":\\\\\"a\\\\\",\\\\\"Entity\\\\\":\\\\\"Tab', s_nationkey, '\\\\\"}],"
        "\\\\\"Select\\\\\":[{\\\\\"Column\\\\\":{\\\\\"Expression\\\\\":{\\\\\"SourceRef\\\\\":{\\\\\"Source\\\\\":\\\\\"a\\\\\"}},"
        "\\\\\"Property\\\\\":\\\\\"Col', s_suppkey % 6, '\\\\\"}}]}}}')"
    )
    content = f"""concat('{{"sections":[{{"displayName":"First ', s_suppkey, '","config":"{{\\\\"visibility\\\\":', s_suppkey % 2,
        '}}","height":720,"width":1280,"visualContainers":[{{"x":', s_suppkey, '.25,"y":2,"width":300,"config":"', {config},
        '","filters":"[{{\\\\"name\\\\":\\\\"lf\\\\",\\\\"expression\\\\":{{\\\\"Measure\\\\":{{\\\\"Expression\\\\":{{\\\\"SourceRef\\\\":{{\\\\"Entity\\\\":\\\\"Tab\\\\"}}}},\\\\"Property\\\\":\\\\"Mes\\\\"}}}}}}]"}},',
        '{{"config":"{{}}"}}]}}]}}')"""
    return _sql(
        load(spark, sf_dir, "supplier"),
        "concat('leg', s_suppkey) as item_id",
        "s_name as item_name",
        "'report' as item_kind",
        "'ws' as workspace",
        "'report.json' as rel_path",
        f"{content} as content",
    )


STAR = {
    "lineitem": ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                 "l_returnflag l_linestatus l_shipdate").split(),
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(),
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice".split(),
    "supplier": "s_suppkey s_name s_nationkey s_acctbal".split(),
    "nation": "n_nationkey n_name n_regionkey".split(),
    "region": "r_regionkey r_name".split(),
}

STAR_KEYS = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
)


def star_columns() -> list[tuple[str, str]]:
    return [(t, c) for t, names in STAR.items() for c in names]


def _star_source(table: str, names: list[str]) -> str:
    """Query text of a star table: its odd columns are renamed, in two steps."""
    odd = names[1::2]
    pairs = [", ".join('{"%s", "%s"}' % pair for pair in step) for step in (
        [(c, f"tmp {c}") for c in odd], [(f"tmp {c}", f"src {c}") for c in odd])]
    return "\n".join([
        "let", 'Source = Sql.Database("server", "shop"),',
        f'dbo_{table} = Source{{[Schema="dbo",Item="{table}"]}}[Data],',
        f'#"Renamed, once" = Table.RenameColumns(dbo_{table},{{{pairs[0]}}}),',
        f'#"Typed = all" = Table.TransformColumnTypes(#"Renamed, once",{{{{"{names[0]}", Int64.Type}}}}),',
        f'Renamed = Table.RenameColumns(#"Typed = all",{{{pairs[1]}}})', "in", "Renamed",
    ])


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The star schema as a model whose reports (users) use columns that events name.

    The model has names of its own; the queries of its partitions say which table they read and how its
    columns were renamed.
    """
    model = F.lit("star").alias("semantic_model_id")
    table, column = "concat('The ', table_name, 's') as table_name", "concat(upper(column_name), ' of it') as column_name"
    given = spark.createDataFrame(
        [(i, t, c, f"src {c}" if STAR[t].index(c) % 2 else c) for i, (t, c) in enumerate(star_columns())],
        "i INT, table_name STRING, column_name STRING, source_column STRING",
    )
    listed = given.selectExpr("i", table, column, "source_column")
    keys = spark.createDataFrame(
        list(STAR_KEYS), "from_table STRING, from_column STRING, to_table STRING, to_column STRING"
    ).selectExpr(*(e for side in ("from", "to") for e in (
        f"concat('The ', {side}_table, 's') as {side}_table", f"concat(upper({side}_column), ' of it') as {side}_column")))
    partitions = spark.createDataFrame(
        [(t, _star_source(t, names)) for t, names in STAR.items()], "table_name STRING, source_expression STRING"
    ).selectExpr(table, "source_expression")
    events = load(spark, sf_dir, "events").withColumn("k", F.expr("cast(get_json_object(props, '$.k') as int)"))
    # Squares leave many columns unused, whatever the number of events.
    counted = events.selectExpr("user_id", "event_type", f"(k * k) % {len(star_columns())} as i").groupBy(
        "user_id", "event_type", "i"
    ).agg(F.count(F.lit(1)).alias("usage_count"))
    used = counted.join(listed, "i").selectExpr(
        "concat('r', user_id) as report_id", "event_type as page_name", "'v' as visual_name", "table_name", "column_name",
        "usage_count",
    )
    none = lambda name: conform(spark.createDataFrame([], "x INT"), name)
    return {
        "semantic_model": conform(spark.range(1).select(model, F.lit("star.SemanticModel").alias("name")), "semantic_model"),
        "semantic_model_table": conform(listed.select(model, "table_name").distinct(), "semantic_model_table"),
        "semantic_model_column": conform(listed.select(model, "table_name", "column_name", "source_column"), "semantic_model_column"),
        "semantic_model_partitions": conform(partitions.select(model, "table_name", F.lit("p").alias("partition_name"), "source_expression"), "semantic_model_partitions"),
        "semantic_model_measure": none("semantic_model_measure"),
        "semantic_model_relationship": conform(keys.select(model, "*"), "semantic_model_relationship"),
        "semantic_model_table_bins": none("semantic_model_table_bins"),
        "measure_dependencies": none("measure_dependencies"),
        "calculated_table_dependencies": none("calculated_table_dependencies"),
        "report": conform(
            load(spark, sf_dir, "customer").selectExpr("concat('r', c_custkey) as report_id", "'star' as name"), "report"
        ),
        "report_column_used": used,
        "report_measure_used": none("report_measure_used"),
    }
