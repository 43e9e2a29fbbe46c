"""Usage counts and roll-ups.

Usage rows are combined by (report, field) before they meet reports or models, so a report
or a table that holds most of the rows is reduced where it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelsieve.functions.names import field_part, table_part
from modelsieve.operators.links import MODEL, link_keys, report_links
from modelsieve.plans.fixpoint import join_by_pairs, materialize
from modelsieve.schemas import conform

_VISUAL = ("report_id", "page_name", "visual_name")


def _usage(refs: DataFrame, kind: str, distinct_refs: bool) -> DataFrame:
    table = f"report_{kind}_used"
    rows = refs.where((F.col("kind") == kind) & (F.instr("ref", ".") > 0))
    return conform(
        rows.groupBy(*_VISUAL, table_part(F.col("ref")).alias("table_name"), field_part(F.col("ref")).alias(f"{kind}_name"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("usage_count", F.lit(1) if distinct_refs else F.col("__n")),
        table,
    )


def column_usage(refs: DataFrame, distinct_refs: bool = False) -> DataFrame:
    """Occurrences of each column per visual; references without a table are left out."""
    return _usage(refs, "column", distinct_refs)


def measure_usage(refs: DataFrame, distinct_refs: bool = False) -> DataFrame:
    """Occurrences of each measure per visual."""
    return _usage(refs, "measure", distinct_refs)


def _usage_by_kind(cat: dict[str, DataFrame]) -> list[DataFrame]:
    columns = cat["report_column_used"].select(
        *_VISUAL, F.lit("column").alias("kind"), "table_name", F.col("column_name").alias("field"), "usage_count"
    )
    measures = cat["report_measure_used"].select(
        *_VISUAL, F.lit("measure").alias("kind"), "table_name", F.col("measure_name").alias("field"), "usage_count"
    )
    return [columns, measures]


def field_usage(cat: dict[str, DataFrame]) -> DataFrame:
    """Column and measure usage in one frame: visual, kind, table, field, usage_count."""
    columns, measures = _usage_by_kind(cat)
    return columns.unionByName(measures)


def fields_by_table(cat: dict[str, DataFrame], by_page: bool = False) -> DataFrame:
    """Distinct fields per table, for each report or each page."""
    keys = ["report_id", "page_name"] if by_page else ["report_id"]
    return field_usage(cat).select(*keys, "kind", "table_name", "field").distinct()


def _kind_sum(kind: str) -> F.Column:
    counted = F.coalesce("usage_count", F.lit(0))
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, counted)), F.lit(0)).cast("bigint")


def usage_by_report(cat: dict[str, DataFrame]) -> DataFrame:
    """Total column and measure usage per report, zero for reports without any."""
    totals = field_usage(cat).groupBy("report_id").agg(
        _kind_sum("column").alias("total_column_usage"), _kind_sum("measure").alias("total_measure_usage")
    )
    zero = F.lit(0).cast("bigint")
    return cat["report"].select("report_id", F.col("name").alias("report_name"), "workspace_id").join(
        totals, "report_id", "left"
    ).select(
        "report_id",
        "report_name",
        "workspace_id",
        F.coalesce("total_column_usage", zero).alias("total_column_usage"),
        F.coalesce("total_measure_usage", zero).alias("total_measure_usage"),
    )


def usage_by_table(cat: dict[str, DataFrame], link_by: str = "reference") -> DataFrame:
    """Per model and table: column usage, measure usage and number of reports."""
    per_report = field_usage(cat).groupBy("report_id", "table_name").agg(
        _kind_sum("column").alias("c"), _kind_sum("measure").alias("m")
    )
    # One row per (report, table) is left, so reports are counted without another distinct.
    return (
        per_report.join(report_links(cat, link_by), "report_id")
        .groupBy(MODEL, "table_name")
        .agg(
            F.sum("c").alias("column_usage"),
            F.sum("m").alias("measure_usage"),
            F.count(F.lit(1)).alias("reports"),
        )
    )


def usage_by_visual(cat: dict[str, DataFrame]) -> DataFrame:
    """Usage per visual and field."""
    return (
        field_usage(cat)
        .groupBy(*_VISUAL, "kind", "table_name", "field")
        .agg(F.sum(F.coalesce("usage_count", F.lit(0))).alias("usage_count"))
    )


def usage_matrix(cat: dict[str, DataFrame]) -> DataFrame:
    """table × report → number of distinct fields, in long form."""
    fields = field_usage(cat).select("table_name", "report_id", "field").distinct()
    return fields.groupBy("table_name", "report_id").agg(F.count(F.lit(1)).alias("fields"))


def reports_per_table(cat: dict[str, DataFrame]) -> DataFrame:
    """Number of reports that use each table."""
    pairs = field_usage(cat).select("table_name", "report_id").distinct()
    return pairs.groupBy("table_name").agg(F.count(F.lit(1)).alias("reports"))


def linked_usage(cat: dict[str, DataFrame], link_by: str = "name") -> DataFrame:
    """Distinct (model, kind, table, field) used by the reports of each model.

    Rows of each kind are made distinct once, by what reports and models have in common, which is far less
    than by report; that is combined where a report's rows meet its link.
    """
    reports, models = link_keys(cat, link_by)
    fields = ["kind", "table_name", "field"]
    links = reports.distinct()
    per_link = [
        used.select("report_id", *fields).join(links, "report_id").select("link", *fields).distinct() for used in _usage_by_kind(cat)
    ]
    return per_link[0].unionByName(per_link[1]).join(models, "link").select(MODEL, *fields).distinct()


def model_usage_summary(cat: dict[str, DataFrame], link_by: str = "reference") -> DataFrame:
    """Per model: tables, used tables and unused tables (not below zero)."""
    used = linked_usage(cat, link_by).select(MODEL, "table_name").distinct()
    rows = used.select(MODEL, F.lit(1).alias("used"), F.lit(0).alias("total")).unionByName(
        cat["semantic_model_table"].select(MODEL, F.lit(0).alias("used"), F.lit(1).alias("total"))
    )
    models = cat["semantic_model"].select(MODEL).distinct()
    counts = rows.groupBy(MODEL).agg(F.sum("total").alias("t"), F.sum("used").alias("u"))
    zero = F.lit(0).cast("bigint")
    total, used_count = F.coalesce("t", zero), F.coalesce("u", zero)
    return models.join(counts, MODEL, "left").select(
        MODEL,
        total.alias("total_tables"),
        used_count.alias("used_tables"),
        F.greatest(total - used_count, zero).alias("unused_tables"),
    )


def tables_without_usage(cat: dict[str, DataFrame], link_by: str = "reference") -> DataFrame:
    """Tables of a model that no linked report uses directly."""
    used = linked_usage(cat, link_by).select(MODEL, "table_name").distinct()
    return cat["semantic_model_table"].select(MODEL, "table_name").join(used, [MODEL, "table_name"], "left_anti")


def model_kpis(cat: dict[str, DataFrame], link_by: str = "name") -> DataFrame:
    """Per model: columns, measures, tables, relationships, reports using it and their pages."""
    reports, models = link_keys(cat, link_by)
    page_counts = cat["report_page"].groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))
    reached = (
        reports.join(page_counts, "report_id", "left")
        .groupBy("link")
        .agg(F.count(F.lit(1)).alias("reports"), F.sum(F.coalesce("n", F.lit(0))).alias("pages"))
        .join(models, "link")
    )
    parts = {
        "columns": cat["semantic_model_column"].select(MODEL, F.lit(1).alias("n")),
        "measures": cat["semantic_model_measure"].select(MODEL, F.lit(1).alias("n")),
        "tables": cat["semantic_model_table"].select(MODEL, F.lit(1).alias("n")),
        "relationships": cat["semantic_model_relationship"].select(MODEL, F.lit(1).alias("n")),
        "reports_using_model": reached.select(MODEL, F.col("reports").alias("n")),
        "pages": reached.select(MODEL, F.col("pages").alias("n")),
    }
    rows = cat["semantic_model"].select(MODEL, F.lit("").alias("kpi"), F.lit(0).cast("bigint").alias("n"))
    for kpi, df in parts.items():
        rows = rows.unionByName(df.select(MODEL, F.lit(kpi).alias("kpi"), F.col("n").cast("bigint").alias("n")))
    known = cat["semantic_model"].select(MODEL).distinct()
    counted = rows.groupBy(MODEL).agg(
        *[F.coalesce(F.sum(F.when(F.col("kpi") == kpi, F.col("n"))), F.lit(0).cast("bigint")).alias(kpi) for kpi in parts]
    )
    return counted.join(known, MODEL, "left_semi")


def page_columns(cat: dict[str, DataFrame]) -> DataFrame:
    """Distinct columns per page."""
    return cat["report_column_used"].select("report_id", "page_name", "table_name", "column_name").distinct()


def page_measures(cat: dict[str, DataFrame], link_by: str = "name") -> DataFrame:
    """Distinct measures per page with the expression in the report's model, if it has one.

    Models are reduced to what they link by first: where several models of one name have the measure,
    the least expression stands for them, and no page is paired with each of them.
    """
    reports, models = link_keys(cat, link_by)
    used = cat["report_measure_used"].select("report_id", "page_name", "measure_name").distinct()
    expressions = (
        cat["semantic_model_measure"]
        .where(F.coalesce("expression", F.lit("")) != "")
        .select(MODEL, "measure_name", "expression")
        .join(models, MODEL)
        .groupBy("link", "measure_name")
        .agg(F.min("expression").alias("expression"))
    )
    return (
        used.join(reports, "report_id", "left")
        .join(expressions, ["link", "measure_name"], "left")
        .select("report_id", "page_name", "measure_name", "expression")
    )


def page_sources(cat: dict[str, DataFrame], link_by: str = "name") -> DataFrame:
    """Partition sources of the tables whose columns a page uses; equal ones of models of one name once.

    Rows are pairs of pages and partitions, of which a table may have many, so they set the number of tasks.
    """
    reports, models = link_keys(cat, link_by)
    used = cat["report_column_used"].select("report_id", "page_name", "table_name").distinct()
    sources = (
        cat["semantic_model_partitions"]
        .where(F.coalesce("source_expression", F.lit("")) != "")
        .select(MODEL, "table_name", "partition_name", "source_expression")
        .join(models, MODEL)
        .select("link", "table_name", "partition_name", "source_expression")
        .distinct()
    )
    linked = materialize(used.join(reports, "report_id"), "page-tables")
    found = join_by_pairs(linked, materialize(sources, "table-sources"), ["link", "table_name"])
    return found.select("report_id", "page_name", "table_name", "partition_name", "source_expression")


def page_details(cat: dict[str, DataFrame], link_by: str = "name") -> DataFrame:
    """Everything a page needs in long form: kind (column, measure, source), table, name, text."""
    none = F.lit(None).cast("string")
    parts = [
        page_columns(cat).select("report_id", "page_name", F.lit("column").alias("kind"), "table_name",
                                 F.col("column_name").alias("name"), none.alias("text")),
        page_measures(cat, link_by).select("report_id", "page_name", F.lit("measure").alias("kind"),
                                           none.alias("table_name"), F.col("measure_name").alias("name"),
                                           F.col("expression").alias("text")),
        page_sources(cat, link_by).select("report_id", "page_name", F.lit("source").alias("kind"), "table_name",
                                          F.col("partition_name").alias("name"), F.col("source_expression").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def workspace_counts(cat: dict[str, DataFrame]) -> DataFrame:
    """Reports and models per workspace: non-empty ones first, each group by name."""
    reports = cat["report"].groupBy(F.col("workspace_id").alias("id")).agg(F.count(F.lit(1)).alias("r"))
    models = cat["semantic_model"].groupBy(F.col("workspace_id").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("bigint")
    return (
        cat["workspaces"]
        .select("id", "displayName")
        .join(reports, "id", "left")
        .join(models, "id", "left")
        .select("id", "displayName", F.coalesce("r", zero).alias("reports"), F.coalesce("m", zero).alias("models"))
        .withColumn("is_empty", (F.col("reports") == 0) & (F.col("models") == 0))
        .orderBy("is_empty", "displayName", "id")
    )


def partition_mode_histogram(partitions: DataFrame) -> DataFrame:
    """Partitions per storage mode (import, directquery, dual, other) with a total row."""
    mode = F.lower(F.coalesce("mode", F.lit("unknown")))
    known = F.when(mode.isin("import", "directquery", "dual"), mode).otherwise("other")
    return (
        partitions.select(known.alias("mode"))
        .rollup("mode")
        .agg(F.count(F.lit(1)).alias("partitions"))
        .select(F.coalesce("mode", F.lit("total")).alias("mode"), "partitions")
    )


def model_info(cat: dict[str, DataFrame]) -> DataFrame:
    """Per table: number of columns, measures and partitions."""
    keys = [MODEL, "table_name"]
    rows = None
    for kind, table in (
        ("columns", "semantic_model_column"),
        ("measures", "semantic_model_measure"),
        ("partitions", "semantic_model_partitions"),
    ):
        part = cat[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("columns", "measures", "partitions")]
    )
    zero = F.lit(0).cast("bigint")
    return (
        cat["semantic_model_table"]
        .select(*keys)
        .join(counts, keys, "left")
        .select(*keys, *[F.coalesce(k, zero).alias(k) for k in ("columns", "measures", "partitions")])
    )


def first_relationships(cat: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """First ``n`` relationships of each model by name (a ranked limit, cut before the shuffle)."""
    order = Window.partitionBy(MODEL).orderBy("relationship_name", "from_table", "from_column", "to_table", "to_column")
    return (
        cat["semantic_model_relationship"]
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= n)
        .select(MODEL, "position", "relationship_name", "from_table", "from_column", "to_table", "to_column")
    )


def table_columns_listing(cat: dict[str, DataFrame], n: int = 20) -> DataFrame:
    """First ``n`` columns of each table with their type, and how many more there are."""
    keys = [MODEL, "table_name"]
    order = Window.partitionBy(*keys).orderBy("column_name")
    columns = cat["semantic_model_column"].select(*keys, "column_name", "data_type")
    sizes = columns.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more_columns"))
    top = columns.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
    return top.join(sizes, keys).select(*keys, "position", "column_name", "data_type", "more_columns")


def partition_previews(partitions: DataFrame, lines: int = 5) -> DataFrame:
    """Partitions with the first lines of their source and the number of lines."""
    split = F.split(F.coalesce("source_expression", F.lit("")), "\n")
    blank = F.coalesce("source_expression", F.lit("")) == ""
    return partitions.select(
        MODEL,
        "table_name",
        "partition_name",
        F.coalesce("source_type", F.lit("N/A")).alias("source_type"),
        F.coalesce("mode", F.lit("N/A")).alias("mode"),
        F.when(~blank, F.array_join(F.slice(split, 1, lines), "\n")).alias("preview"),
        F.when(blank, 0).otherwise(F.size(split)).cast("bigint").alias("source_lines"),
    )


def table_details(cat: dict[str, DataFrame], table: str | None = None, n: int = 20) -> dict[str, DataFrame]:
    """Column listing, measures and partition previews, of one table name or of all tables."""
    parts = {
        "columns": table_columns_listing(cat, n),
        "measures": cat["semantic_model_measure"].select(MODEL, "table_name", "measure_name", "expression"),
        "partitions": partition_previews(cat["semantic_model_partitions"]),
    }
    if table is None:
        return parts
    return {name: df.where(F.col("table_name") == table) for name, df in parts.items()}


def visuals_per_page(cat: dict[str, DataFrame]) -> DataFrame:
    """Number of visuals and page size per page, zero for pages without visuals."""
    counts = cat["report_visual"].groupBy("report_id", "page_name").agg(F.count(F.lit(1)).alias("n"))
    pages = cat["report_page"].select(
        "report_id", F.col("name").alias("page_name"), F.coalesce("display_name", "name").alias("display_name"), "width", "height"
    )
    return pages.join(counts, ["report_id", "page_name"], "left").select(
        "report_id", "page_name", "display_name", "width", "height", F.coalesce("n", F.lit(0).cast("bigint")).alias("visuals")
    )


def page_visual_fields(cat: dict[str, DataFrame]) -> DataFrame:
    """Per visual: type, position and each distinct field; visuals without fields give one row."""
    fields = field_usage(cat).select(*_VISUAL, "kind", "table_name", "field").distinct()
    visuals = cat["report_visual"].select(
        "report_id", "page_name", F.col("name").alias("visual_name"), "visual_type", "x", "y", "width", "height"
    )
    return visuals.join(fields, list(_VISUAL), "left")
