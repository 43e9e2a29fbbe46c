"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.functions import expressions as X
from modelsieve.functions import names as N
from modelsieve.operators import extract_model as XM
from modelsieve.operators import extract_report as XR
from modelsieve.operators import graph, lineage, links, refs, search_index, subset, unused, usage
from modelsieve.operators.links import MODEL
from modelsieve.plans import encodings as E
from modelsieve.plans.fixpoint import materialize, scratch_dir
from modelsieve.plans.oracle import checksum_sql
from modelsieve.sources import catalog as C
from modelsieve.sources import definitions as D
from modelsieve.sources import manifests as S
from modelsieve.sources import reimport as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _over_catalog(name: str, operator: Callable[[E.Catalog], DataFrame]) -> None:
    """Register an operator that takes the catalog and needs no resolved expressions."""
    QUERIES[name] = lambda spark, sf_dir: operator(E.catalog(spark, sf_dir))


def _over_resolved(name: str, operator: Callable[[E.Catalog], DataFrame]) -> None:
    """Register an operator that needs the closed dependencies."""
    QUERIES[name] = lambda spark, sf_dir: operator(E.resolved_catalog(spark, sf_dir))


# Usage and links.


@query
def column_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = E.load(spark, sf_dir, "events").withColumn("k", F.expr("cast(get_json_object(props, '$.k') as int)"))
    occurrences = events.selectExpr(
        "concat('r', user_id) as report_id",
        "event_type as page_name",
        "concat('v', event_id % 7) as visual_name",
        "'column' as kind",
        f"concat('Brand#', k % 25 + 1, '.', {E.type_name('k % 6')}) as ref",
    )
    return usage.column_usage(occurrences)


@query
def measure_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = E.load(spark, sf_dir, "customer").selectExpr("c_custkey as o_custkey", "c_nationkey")
    part = E.load(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_brand")
    orders = E.load(spark, sf_dir, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey")
    lines = E.load(spark, sf_dir, "lineitem").join(orders, "l_orderkey").join(customer, "o_custkey")
    occurrences = (
        lines.withColumn("k", F.expr("(l_partkey div 50) * 25 + c_nationkey"))
        .join(part, "k")
        .selectExpr(
            "concat('r', o_custkey) as report_id",
            "concat('p', l_linenumber) as page_name",
            "concat(l_returnflag, l_linestatus) as visual_name",
            "'measure' as kind",
            "concat(p_brand, '.m', k) as ref",
        )
    )
    return usage.measure_usage(occurrences)


_over_catalog("fields_by_table", usage.fields_by_table)
_over_catalog("fields_by_page", lambda cat: usage.fields_by_table(cat, by_page=True))
_over_catalog("usage_by_report", usage.usage_by_report)
_over_catalog("usage_by_table", usage.usage_by_table)
_over_catalog("usage_by_visual", usage.usage_by_visual)
_over_catalog("usage_matrix", usage.usage_matrix)
_over_catalog("reports_per_table", usage.reports_per_table)
_over_catalog("model_usage_summary", usage.model_usage_summary)
_over_catalog("tables_without_usage", usage.tables_without_usage)
_over_catalog("model_kpis", usage.model_kpis)
_over_catalog("page_details", usage.page_details)
_over_catalog("workspace_counts", usage.workspace_counts)
_over_catalog("partition_mode_histogram", lambda cat: usage.partition_mode_histogram(cat["semantic_model_partitions"]))
_over_catalog("model_info", usage.model_info)
_over_catalog("first_relationships", usage.first_relationships)
_over_catalog("table_columns_listing", lambda cat: usage.table_details(cat, n=5)["columns"])
_over_catalog("partition_previews", lambda cat: usage.table_details(cat)["partitions"])
_over_catalog("visuals_per_page", usage.visuals_per_page)
_over_catalog("page_visual_fields", usage.page_visual_fields)
_over_catalog("linked_by_name_ratio", links.linked_by_name_ratio)
_over_catalog("reports_for_model", links.reports_for_model)
_over_catalog("model_for_report", links.model_for_report)
_over_catalog("reports_by_reference", lambda cat: links.report_links(cat, "reference"))
_over_catalog("model_with_workspace", links.model_with_workspace)
_over_catalog("sibling_counts", lambda cat: links.sibling_counts(cat["report"]))


@query
def sibling_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = E.load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max("c_custkey").alias("k"))
    asked = latest.select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("report_id"))
    return links.sibling_reports(E.reports(spark, sf_dir), asked)


@query
def resolve_model_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = E.load(spark, sf_dir, "customer").selectExpr(
        "concat('q', c_custkey) as request_id",
        "concat('sm', c_custkey % 50) as semantic_model_id",
        "if(c_nationkey % 3 = 0, concat('NATION_', c_nationkey, if(c_custkey % 2 = 0, '.SemanticModel', '')), 'none') as name",
    )
    return links.resolve_model_id(requests, E.models(spark, sf_dir))


# References.


@query
def clean_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spread(spark, sf_dir, "documents").select("doc_id", X.clean_expression(F.col("text")).alias("cleaned"))


_over_catalog("qualified_refs", lambda cat: refs.qualified_refs(cat["semantic_model_measure"], cat["semantic_model_table"]))
_over_catalog("measure_refs", lambda cat: refs.measure_refs(cat["semantic_model_measure"], cat["semantic_model_table"]))


@query
def functions_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("sum",), ("COUNTROWS",), ("FILTER",)], "name STRING")
    return refs.functions_used(E.measures(spark, sf_dir), known)


_over_catalog("variables_used", lambda cat: refs.variables_used(cat["semantic_model_measure"]))
_over_catalog("bare_table_refs", lambda cat: refs.bare_table_refs(cat["semantic_model_measure"], cat["semantic_model_table"]))
_over_catalog("direct_dependencies", refs.direct_dependencies)
_over_catalog("calculated_table_dependencies", refs.calculated_table_dependencies)


@query
def external_table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = E.tables(spark, sf_dir)
    included = tables.where(F.col("table_name").startswith("Brand"))
    return refs.external_table_refs(E.measures(spark, sf_dir), included, tables)


@query
def own_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = E.load(spark, sf_dir, "lineitem").selectExpr(
        "concat('sm', l_suppkey % 25) as semantic_model_id",
        "concat(l_returnflag, l_linestatus) as table_name",
        "concat('q', l_orderkey, '-', l_linenumber) as measure_name",
        "concat('DIVIDE(SUM(', l_returnflag, l_linestatus, '[Q', l_linenumber, ']), Other[X', l_suppkey, '])') as expression",
    )
    return refs.own_table_columns(measures)


@query
def search_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = refs.search_measures(E.measures(spark, sf_dir), "countrows(calc_")
    return found.select(MODEL, "table_name", "measure_name")


@query
def search_measures_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures that hold the name of a brand, of a part, or a few letters, through the trigram index."""
    path = f"{scratch_dir(spark)}/measure-grams-{uuid.uuid4().hex}"
    measures = E.measures(spark, sf_dir)
    search_index.write_index(measures, path)
    brands = E.load(spark, sf_dir, "part").selectExpr("concat(lower(p_brand), '[') as text")
    names = E.load(spark, sf_dir, "nation").selectExpr("concat('[m', n_nationkey, ']') as text")
    texts = brands.union(names).union(spark.range(1).selectExpr("explode(array('v_', 'CountRows(calc_')) as text")).distinct()
    return search_index.search(search_index.read_index(spark, path), measures, texts)


@query
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = E.spread(spark, sf_dir, "documents").selectExpr("doc_id", "'' as measure_name", "text as expression")
    return refs.search_measures(texts, "license").select("doc_id")


# Graph.


def _direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(refs.direct_dependencies(E.catalog(spark, sf_dir)), "direct")


@query
def measure_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.measure_closure(_direct(spark, sf_dir)).select(MODEL, "measure_name", "reached")


@query
def transitive_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitive_dependencies(_direct(spark, sf_dir))


def _earlier_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the measures: roots in a cycle with one that needs them, other references."""
    return E.measures(spark, sf_dir).withColumn("k", F.expr("cast(substr(measure_name, 2) as int)")).selectExpr(
        MODEL, "table_name", "measure_name",
        """concat_ws(' + ', 'SUM(Old[c])', if(k < 25, concat('[m', k + 25, ']'), if(k % 5 = 2, null, concat('[m', (k div 50) * 25 + k % 25, ']'))),
            if(k % 7 = 3, concat('[m', k % 25, ']'), null)) as expression""",
        "format_string", "is_hidden",
    )


@query
def reimport_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed dependencies of a stored catalog after the models of one region came again.

    The new measures add references, lack some, and break the cycles.
    """
    path = f"{scratch_dir(spark)}/reimported-{uuid.uuid4().hex}"
    whole = E.catalog(spark, sf_dir)
    tables = ("semantic_model", "semantic_model_table", "semantic_model_column")
    stored = {**{t: whole[t] for t in tables}, "semantic_model_measure": _earlier_measures(spark, sf_dir)}
    R.write_with_dependencies(stored, path, buckets=16)
    again = E.load(spark, sf_dir, "nation").where("n_regionkey = 1").selectExpr(f"concat('sm', n_nationkey) as {MODEL}")
    batch = {t: whole[t].join(again, MODEL, "left_semi") for t in (*tables, "semantic_model_measure")}
    R.reimport_models(spark, path, batch)
    return C.read_catalog(spark, path, views=False)["measure_dependencies"]


@query
def inherited_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = _direct(spark, sf_dir).unionByName(refs.function_dependencies(E.measures(spark, sf_dir)))
    closed = graph.transitive_dependencies(materialize(direct, "direct"))
    return closed.where("dependency_type = 'function'").select(MODEL, "measure_name", F.col("referenced_name").alias("function_name"))


@query
def table_dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.table_dependency_graph(graph.transitive_dependencies(_direct(spark, sf_dir)))


@query
def expand_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expand_tables(E.data_edges(spark, sf_dir), E.data_seeds(spark, sf_dir))


@query
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(E.data_edges(spark, sf_dir))


def _used_and_needed(cat: E.Catalog) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What reports use and what its measures need, both found once."""
    used = subset.used_objects(cat)
    return used, subset.required_by_measures(cat["measure_dependencies"], used["measures"])


def _start_tables(used: dict[str, DataFrame], needed: dict[str, DataFrame]) -> DataFrame:
    parts = [used["columns"], used["measures"], needed["tables"], needed["columns"]]
    rows = parts[0].select(*subset.TABLE)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*subset.TABLE))
    return rows.distinct()


_over_resolved(
    "close_calculated_tables",
    lambda cat: graph.close_calculated_tables(_start_tables(*_used_and_needed(cat)), cat["calculated_table_dependencies"])[0],
)


def _needed_columns(cat: E.Catalog) -> tuple[DataFrame, DataFrame]:
    used, needed = _used_and_needed(cat)
    closed, calc_columns = graph.close_calculated_tables(_start_tables(used, needed), cat["calculated_table_dependencies"])
    tables = materialize(closed, "tables")
    keys = graph.relationship_key_columns(graph.relationships_between(cat["semantic_model_relationship"], tables))
    columns = used["columns"].unionByName(needed["columns"]).unionByName(calc_columns).unionByName(keys)
    return graph.close_sort_by(columns, cat["semantic_model_column"]), tables


_over_resolved("close_sort_by", lambda cat: _needed_columns(cat)[0])
_over_resolved("pair_bins", lambda cat: graph.pair_bins(*_needed_columns(cat), cat["semantic_model_table_bins"])[0])
_over_resolved(
    "relationships_between",
    lambda cat: graph.relationships_between(cat["semantic_model_relationship"], _needed_columns(cat)[1]).select(
        MODEL, "relationship_name"
    ),
)
_over_catalog("relationship_key_columns", lambda cat: graph.relationship_key_columns(cat["semantic_model_relationship"]))


# Unused objects.

_over_resolved("unused_measures", unused.unused_measures)
_over_resolved("unused_columns", unused.unused_columns)
_over_resolved("unused_tables", unused.unused_tables)
_over_resolved("unused_summary", unused.unused_summary)
_over_resolved("reduction_preview", unused.reduction_preview)


# Subsets.


def _both(parts: dict[str, DataFrame]) -> DataFrame:
    columns = parts["columns"].select(MODEL, F.lit("column").alias("kind"), "table_name", F.col("column_name").alias("field"))
    measures = parts["measures"].select(MODEL, F.lit("measure").alias("kind"), "table_name", F.col("measure_name").alias("field"))
    return columns.unionByName(measures)


_over_catalog("used_objects", lambda cat: _both(subset.used_objects(cat)))
_over_catalog("used_objects_with_filters", lambda cat: _both(subset.used_objects(cat, include_filters=True)))


@query
def required_by_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = E.resolved_catalog(spark, sf_dir)
    needed = subset.required_by_measures(cat["measure_dependencies"], subset.used_objects(cat)["measures"])
    none = F.lit(None).cast("string")
    tables = needed["tables"].select(MODEL, F.lit("table").alias("kind"), "table_name", none.alias("name"))
    columns = needed["columns"].select(MODEL, F.lit("column").alias("kind"), "table_name", F.col("column_name").alias("name"))
    measures = needed["measures"].select(MODEL, F.lit("measure").alias("kind"), none.alias("table_name"), F.col("measure_name").alias("name"))
    return tables.unionByName(columns).unionByName(measures)


_over_resolved("minimal_model_tables", lambda cat: subset.minimal_model(cat)["tables"])
_over_resolved("minimal_model_columns", lambda cat: subset.minimal_model(cat)["columns"])
_over_resolved("minimal_model_measures", lambda cat: subset.minimal_model(cat)["measures"])
_over_resolved(
    "minimal_model_relationships",
    lambda cat: subset.minimal_model(cat)["relationships"].select(
        MODEL, "relationship_name", "from_table", "from_column", "to_table", "to_column"
    ),
)
_over_resolved("subset_summary", lambda cat: subset.subset_summary(subset.minimal_model(cat)))
_over_resolved(
    "removed_columns",
    lambda cat: subset.removed_columns(cat["semantic_model_column"], subset.minimal_model(cat)["columns"]),
)


@query
def subset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = E.resolved_catalog(spark, sf_dir)
    return subset.subset_manifest(subset.minimal_model(cat), subset.used_objects(cat)["measures"], "all reports")


@query
def subset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.subset_totals(subset.minimal_model(E.resolved_catalog(spark, sf_dir)))


@query
def clear_invalid_sort_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = E.resolved_catalog(spark, sf_dir)
    kept = subset.minimal_model(cat)["columns"]
    columns = cat["semantic_model_column"].join(kept, subset.COLUMN, "left_semi")
    return subset.clear_invalid_sort_by(columns.select(*subset.COLUMN, "sort_by_column"))


@query
def apply_element_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = E.catalog(spark, sf_dir)
    keys = graph.relationship_key_columns(cat["semantic_model_relationship"])
    kept = subset.apply_element_spec(cat, subset.report_based_specs(cat), key_columns=keys)
    return kept["columns"].select(*subset.COLUMN)


_over_catalog("report_based_specs", subset.report_based_specs)


@query
def drop_invalid_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    variations = XM.extract_variations(XM.attribute_blocks(E.part_files(spark, sf_dir)))
    kept = E.load(spark, sf_dir, "part").where("p_type = 'PROMO'").selectExpr(
        "concat('sm', p_partkey % 25) as semantic_model_id", "concat('rel', p_size) as relationship_name"
    )
    return subset.drop_invalid_variations(variations, kept).select(MODEL, "table_name", "relationship_name")


@query
def subset_from_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = E.catalog(spark, sf_dir)
    seeds = cat["semantic_model"].select(MODEL, F.lit("Brand#1").alias("table_name"), F.lit("ManyToOne").alias("direction"))
    return subset.subset_from_seeds(cat, seeds)["tables"].select(*subset.TABLE)


@query
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = E.load(spark, sf_dir, "events").selectExpr(
        "user_id as source_order",
        "event_id as position",
        "concat(event_type, if(user_id = 0 and event_id % 3 = 0, concat(' (', event_id % 50, ')'), '')) as name",
    )
    first, rest = pages.where("source_order = 0"), pages.where("source_order <> 0")
    return subset.merge_pages(first, rest).select("source_order", "position", "original_name", "name")


@query
def prune_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the star tables after the subset is applied: only kept columns are read."""
    cat = E.star_catalog(spark, sf_dir)
    kept = subset.minimal_model(cat)["columns"]
    physical = lineage.physical_columns(cat["semantic_model_column"], cat["semantic_model_partitions"])
    star = {name: E.load(spark, sf_dir, name) for name in E.STAR}
    profile = None
    for name, df in subset.prune_tables(star, kept, lineage=physical).items():
        # One pass over the table; its few totals are then turned into rows.
        sums = [f"count({c}) as n_{c}" for c in df.columns]
        sums += [f"cast(sum({checksum_sql(c)}) as bigint) as s_{c}" for c in df.columns]
        totals = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.expr(e) for e in sums])
        rows = ", ".join(f"'{c}', n_{c}, s_{c}" for c in df.columns)
        part = totals.selectExpr(
            f"'{name}' as table_name", "row_count", f"stack({len(df.columns)}, {rows}) as (column_name, filled, checksum)"
        )
        profile = part if profile is None else profile.unionByName(part)
    return profile


# Sources.


@query
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = E.load(spark, sf_dir, "documents").selectExpr(
        "concat('file:/data/src ', source, '/Doc ', doc_id, "
        "if(doc_id % 2 = 0, concat('.SemanticModel/definition/tables/', lang, '.tmdl'), '.Report/definition/report.json')) as path",
        "text as content",
    )
    return D.classify_files(files).select("workspace", "item_id", "item_kind", "rel_path", "content")


@query
def decode_definition_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = E.load(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "named_struct('parts', array("
        "named_struct('path', concat('files/', doc_id, '.txt'), 'payload', base64(encode(text, 'UTF-8')), 'payloadType', 'InlineBase64'),"
        "named_struct('path', 'link', 'payload', lang, 'payloadType', 'VirtualLink'))) as definition",
    )
    return D.decode_definition_parts(items)


@query
def explode_workspace_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = E.load(spark, sf_dir, "supplier").selectExpr(
        """concat('{"workspaces":[{"id":"w', s_suppkey, '","name":"', s_name, '","reports":[{"id":"r', s_suppkey, '-1","name":"Report 1"},',
        '{"id":"r', s_suppkey, '-2","name":"Report 2"}],"semantic_models":[{"id":"m', s_suppkey, '","name":"Model ', s_nationkey, '"}]},',
        '{"id":"empty","name":"none"}]}') as content"""
    )
    inventory = documents.select(F.from_json("content", D.INVENTORY_SCHEMA).alias("d")).select("d.*")
    return D.explode_workspace_inventory(inventory)


@query
def normalize_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.normalize_workspaces(E.workspaces(spark, sf_dir))


@query
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spread(spark, sf_dir, "documents").select("doc_id", N.safe_name(F.col("text")).alias("name"))


@query
def upsert_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = {"semantic_model_measure": E.measures(spark, sf_dir), "semantic_model": E.models(spark, sf_dir)}
    region = E.load(spark, sf_dir, "nation").where("n_regionkey = 1")
    items = region.selectExpr("concat('sm', n_nationkey) as semantic_model_id")
    batch = {
        "semantic_model": stored["semantic_model"].join(items, MODEL, "left_semi"),
        "semantic_model_measure": stored["semantic_model_measure"]
        .join(items, MODEL, "left_semi")
        .where(~F.col("expression").contains("[LARGE]"))
        .withColumn("expression", F.lit("new")),
    }
    result = C.upsert_catalog(stored, batch, MODEL, parent="semantic_model")
    return result["semantic_model_measure"].select(MODEL, "table_name", "measure_name", "expression")


def _copied(rows: DataFrame, nations: DataFrame, new_id: str, **changed: str) -> DataFrame:
    """Rows of the models of ``nations`` under another id, with some columns replaced."""
    ids = nations.selectExpr("concat('sm', n_nationkey) as stored", f"{new_id} as new_id")
    moved = rows.join(ids, F.col(MODEL) == F.col("stored")).withColumn(MODEL, F.col("new_id")).drop("stored", "new_id")
    return moved.withColumns({c: F.expr(e) for c, e in changed.items()})


@query
def stored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models and measures written, partly imported again, and read back.

    Region 1 comes again, half of it known by name only. Models of region 2 have a namesake in another
    workspace, and only that one comes again, by name. Of region 3, two new models come under one name.
    """
    path = f"{scratch_dir(spark)}/stored-catalog-{uuid.uuid4().hex}"
    models, measures, nations = E.models(spark, sf_dir), E.measures(spark, sf_dir), E.load(spark, sf_dir, "nation")
    region = [nations.where(f"n_regionkey = {i}") for i in range(4)]
    twins = _copied(models, region[2], "concat('twin', n_nationkey)", workspace_id="'elsewhere'")
    twin_measures = _copied(measures, region[2], "concat('twin', n_nationkey)", expression="'twin'")
    stored = {"semantic_model": models.unionByName(twins), "semantic_model_measure": measures.unionByName(twin_measures)}
    C.write_catalog(stored, path, buckets=16)
    again = "concat(if(n_nationkey % 2 = 0, 'sm', 'local_'), n_nationkey)"
    kept = measures.where(~F.col("expression").contains("[LARGE]"))
    batch_models = [
        _copied(models, region[1], again),
        _copied(models, region[2], "concat('local_', n_nationkey)", workspace_id="'elsewhere'"),
        *(_copied(models, region[3], f"concat('{x}', n_nationkey)") for x in "xy"),
    ]
    batch_measures = [
        _copied(kept, region[1], again, expression="'new'"),
        _copied(kept, region[2], "concat('local_', n_nationkey)", expression="'new twin'"),
        *(_copied(kept, region[3], f"concat('{x}', n_nationkey)", expression=f"'{x}'") for x in "xy"),
    ]
    batch = {"semantic_model": reduce(DataFrame.unionByName, batch_models), "semantic_model_measure": reduce(DataFrame.unionByName, batch_measures)}
    C.upsert_stored_catalog(spark, path, batch)
    cat = C.read_catalog(spark, path, views=False)
    return cat["semantic_model_measure"].join(cat["semantic_model"].select(MODEL, "workspace_id", "name"), MODEL).select(
        MODEL, "workspace_id", "name", "table_name", "measure_name", "expression"
    )


@query
def upsert_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = E.load(spark, sf_dir, "events").selectExpr(
        "concat('u', user_id) as id", "event_type as displayName", "event_id as updated_at", "event_id % 2 as half"
    )
    stored, batch = versions.where("half = 0").drop("half"), versions.where("half = 1").drop("half")
    return C.upsert_workspaces(stored, batch)


_over_catalog("table_counts", C.table_counts)


@query
def query_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.register_views({k: v for k, v in E.catalog(spark, sf_dir).items() if k.startswith("semantic_model")})
    return C.query_catalog(
        spark,
        """SELECT t.semantic_model_id, t.table_name, count(m.measure_name) AS measures
           FROM semantic_model_table t LEFT JOIN semantic_model_measure m
             ON m.semantic_model_id = t.semantic_model_id AND m.table_name = t.table_name
           GROUP BY t.semantic_model_id, t.table_name HAVING count(m.measure_name) > 1""",
    )


@query
def query_with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per measure, how many measures it reaches, and how many of them have a given beginning."""
    cat = E.catalog(spark, sf_dir)
    closed = materialize(graph.transitive_dependencies(_direct(spark, sf_dir)), "closed")
    C.register_functions(spark, {"semantic_model_measure": cat["semantic_model_measure"], "measure_dependencies": closed})
    return C.query_catalog(
        spark,
        """SELECT m.semantic_model_id, m.measure_name, count(r.reached) AS reached, count_if(startswith(r.reached, :beginning)) AS matching
           FROM semantic_model_measure m LEFT JOIN LATERAL reachable(m.semantic_model_id, m.measure_name) r
           GROUP BY m.semantic_model_id, m.measure_name""",
        {"beginning": "m1"},
    )


@query
def load_calc_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.load(spark, sf_dir, "part").selectExpr(
        "'w1' as workspace_id",
        """map('DATABASE_NAME', concat('NATION_', p_partkey % 40, '.SemanticModel'), 'object_name', p_name, 'OBJECT_TYPE', 'MEASURE',
            'REFERENCED_OBJECT_NAME', if(p_partkey % 2 = 0, p_brand, ''), 'referenced_object_name', p_type) as fields""",
    )
    return D.load_calc_dependencies(rows, E.models(spark, sf_dir))


@query
def subset_spec_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = E.load(spark, sf_dir, "customer").selectExpr(
        """concat('{"name":"S', c_custkey, '","base_model":"M', c_nationkey, '"',
            case c_custkey % 3 when 0 then concat(',"initial_tables":["', c_mktsegment, '","', c_name, '"]')
              when 1 then concat(',"initial_tables":[{"name":"', c_mktsegment, if(c_custkey % 2 = 0, '","search_direction":"Both"}]', '","direction":"Both"}]'))
              else concat(',"included_tables":["', c_mktsegment, '"]') end,
            if(c_custkey % 2 = 1, ',"recursive":false', ''), if(c_custkey % 5 = 0, ',"max_depth":3', ''), '}') as content"""
    )
    specs = S.parse_subset_specs(documents)
    return S.spec_seeds(specs).join(specs.select("name", "recursive", "max_depth"), "name")


# Extraction from definition text.


@query
def attribute_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = XM.block_lines(XM.attribute_blocks(E.part_files(spark, sf_dir)))
    return lines.groupBy(MODEL, "table_name", "kind", "block_name", "block_no").agg(F.count(F.lit(1)).alias("lines")).drop("block_no")


@query
def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XM.extract_model_catalog(E.part_files(spark, sf_dir))["semantic_model_table"]


def _part_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XM.attribute_blocks(E.part_files(spark, sf_dir))


@query
def extract_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XM.extract_columns(_part_blocks(spark, sf_dir)).drop("semantic_links")


@query
def extract_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XM.extract_measures(_part_blocks(spark, sf_dir))


@query
def extract_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XM.extract_partitions(_part_blocks(spark, sf_dir)).drop("block_no")


@query
def extract_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XM.extract_bins(XM.extract_columns(_part_blocks(spark, sf_dir)))


@query
def extract_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XM.extract_relationships(E.supplier_files(spark, sf_dir))


@query
def extract_model_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    options, notes = F.col("data_access_options"), F.col("annotations")
    return XM.extract_model_header(E.supplier_files(spark, sf_dir)).select(
        MODEL, "workspace_id", "name", "culture", "data_source_version", "source_query_culture",
        options["legacyRedirects"].alias("legacy_redirects"), options["timeout"].alias("timeout"),
        notes["Region"].alias("region"),
    )


# Extraction from report documents.


def _report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = E.report_files(spark, sf_dir).unionByName(E.visual_files(spark, sf_dir))
    return files.unionByName(E.legacy_files(spark, sf_dir))


@query
def extract_report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XR.extract_report_header(_report_items(spark, sf_dir)).drop("workspace_id", "filters")


@query
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XR.extract_pages(E.report_files(spark, sf_dir)).drop("folder", "filters", "display_option")


@query
def flatten_legacy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = XR.flatten_legacy_sections(E.legacy_files(spark, sf_dir))[0]
    return pages.select("report_id", "name", "display_name", "height", "width", "is_visible")


@query
def extract_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XR.extract_visuals(*XR.report_visuals(_report_items(spark, sf_dir))).drop("navigation_target")


@query
def resolve_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XR.visual_aliases(*XR.report_visuals(_report_items(spark, sf_dir)))


@query
def extract_field_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = XR.extract_field_refs(*XR.report_visuals(_report_items(spark, sf_dir)))
    return found.groupBy("report_id", "page_name", "visual_name", "kind", "ref").agg(F.count(F.lit(1)).alias("n"))


@query
def document_column_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XR.extract_report_catalog(_report_items(spark, sf_dir))["report_column_used"]


@query
def document_measure_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XR.extract_report_catalog(_report_items(spark, sf_dir))["report_measure_used"]


@query
def extract_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = XR.extract_report_header(_report_items(spark, sf_dir))
    visuals, pages = XR.report_visuals(_report_items(spark, sf_dir))
    return XR.extract_filters(headers, pages, visuals)
