"""Catalog rows from model definition files.

Input is a frame of files (see ``sources.definitions``): ``item_id``, ``item_name``,
``rel_path``, ``content``. A file stays in its row until its blocks are cut out, so these
jobs have no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.functions import definition_text as D
from modelsieve.functions.names import MODEL_SUFFIX
from modelsieve.schemas import conform

_TABLE_FILE = r"^definition/tables/([^/]+)\.tmdl$"
_RELATIONSHIP_FILE = r"^definition/relationships\.tmdl$"
_MODEL_FILE = r"^definition/model\.tmdl$"

LINKS_ANNOTATION = "__PBI_SemanticLinks"
SEMANTIC_LINKS = "ARRAY<STRUCT<LinkType: STRING, LinkTarget: STRUCT<TableName: STRING, TableItemName: STRING, ObjectType: INT>>>"


def attribute_blocks(files: DataFrame) -> DataFrame:
    """Blocks of definition files in text order.

    Output: ``semantic_model_id``, ``rel_path``, ``table_name`` (file stem for table files),
    ``block_no``, ``kind``, ``block_name``, ``block`` (piece up to the next header, with the
    header) and ``body`` (the lines that belong to the header by indentation).
    """
    blocks = files.select(
        F.col("item_id").alias("semantic_model_id"),
        "rel_path",
        F.nullif(F.regexp_extract("rel_path", _TABLE_FILE, 1), F.lit("")).alias("table_name"),
        F.posexplode(D.split_blocks(F.col("content"))).alias("block_no", "block"),
    )
    kind = D.block_kind(F.col("block"))
    name = F.lit(None).cast("string")
    for k in D.KINDS:
        name = F.when(F.col("kind") == k, D.block_name(F.col("block"), k)).otherwise(name)
    return (
        blocks.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumn("block_name", name)
        .withColumn("body", D.block_body(F.col("block")))
        .select("semantic_model_id", "rel_path", "table_name", "block_no", "kind", "block_name", "block", "body")
    )


def block_lines(blocks: DataFrame) -> DataFrame:
    """Each text line below a header with the block it belongs to."""
    lines = F.split(F.regexp_replace(F.translate("body", "\u0001", "\n"), r"^\n", ""), "\n")
    return (
        blocks.where(F.col("body") != "")
        .select("semantic_model_id", "rel_path", "table_name", "block_no", "kind", "block_name",
                F.posexplode(lines).alias("line_no", "line"))
        .where(F.trim(F.regexp_replace("line", r"\s", " ")) != "")
    )


def _of_kind(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.where((F.col("kind") == kind) & F.col("table_name").isNotNull())


def extract_columns(blocks: DataFrame) -> DataFrame:
    """Column rows, with ``source_column`` and the raw ``semantic_links`` annotation."""
    text = F.col("body")
    links = F.try_element_at(D.annotations(text), F.lit(LINKS_ANNOTATION))
    return _of_kind(blocks, "column").select(
        "semantic_model_id",
        "table_name",
        F.coalesce("block_name", F.lit("")).alias("column_name"),
        D.property_text(text, "dataType").alias("data_type"),
        D.property_text(text, "sourceColumn").alias("source_column"),
        D.property_text(text, "formatString").alias("format_string"),
        D.property_text(text, "summarizeBy").alias("summarize_by"),
        D.property_text(text, "sortByColumn").alias("sort_by_column"),
        D.property_flag(text, "isHidden").alias("is_hidden"),
        F.when(links.startswith("["), links).alias("semantic_links"),
    )


def extract_measures(blocks: DataFrame) -> DataFrame:
    """Measure rows with their expression text."""
    text = F.col("body")
    return conform(
        _of_kind(blocks, "measure").select(
            "semantic_model_id",
            "table_name",
            F.coalesce(F.trim(D.nullable_measure_name(F.col("block"))), F.lit("")).alias("measure_name"),
            D.measure_expression(F.col("block")).alias("expression"),
            D.property_text(text, "formatString").alias("format_string"),
            D.property_flag(text, "isHidden").alias("is_hidden"),
        ),
        "semantic_model_measure",
    )


def extract_partitions(blocks: DataFrame) -> DataFrame:
    """Partition rows; ``block_no`` keeps the order within the table."""
    return _of_kind(blocks, "partition").select(
        "semantic_model_id",
        "table_name",
        F.col("block_name").alias("partition_name"),
        D.header_value(F.col("block")).alias("source_type"),
        D.property_text(F.col("body"), "mode").alias("mode"),
        D.partition_source(F.col("block")).alias("source_expression"),
        "block_no",
    )


def flag_calculated_tables(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """Table rows with ``is_calculated`` and the source of the first calculated partition."""
    first = (
        partitions.where(F.col("source_type") == "calculated")
        .groupBy("semantic_model_id", "table_name")
        .agg(F.min(F.struct("block_no", "source_expression")).alias("__first"))
    )
    return conform(
        tables.join(first, ["semantic_model_id", "table_name"], "left")
        .withColumn("is_calculated", F.col("__first").isNotNull())
        .withColumn("source_code", F.col("__first.source_expression")),
        "semantic_model_table",
    )


def extract_tables(files: DataFrame) -> DataFrame:
    """One row per table file: name from the file, hidden flag from the table's own lines."""
    first = F.get(F.filter(D.split_blocks(F.col("content")), lambda b: D.block_kind(b) == "table"), 0)
    table_name = F.regexp_extract("rel_path", _TABLE_FILE, 1)
    return files.where(F.col("rel_path").rlike(_TABLE_FILE)).select(
        F.col("item_id").alias("semantic_model_id"),
        table_name.alias("table_name"),
        F.coalesce(D.property_flag(first, "isHidden"), F.lit(False)).alias("is_hidden"),
    )


def extract_relationships(files: DataFrame) -> DataFrame:
    """Relationship rows; rows with an end that cannot be read are dropped."""
    blocks = files.where(F.col("rel_path").rlike(_RELATIONSHIP_FILE)).select(
        F.col("item_id").alias("semantic_model_id"), F.explode(D.split_blocks(F.col("content"))).alias("block")
    )
    text = F.col("block")
    raw_end = {side: D.property_text(text, f"{side}Column") for side in ("from", "to")}
    rows = blocks.where(D.block_kind(text) == "relationship").select(
        "semantic_model_id",
        F.trim(F.regexp_extract(text, r"^\s*relationship\s+([^\n]+)", 1)).alias("relationship_name"),
        *[
            D.endpoint_part(raw_end[side], part).alias(f"{side}_{what}")
            for side in ("from", "to")
            for part, what in ((1, "table"), (2, "column"))
        ],
        D.property_text(text, "cardinality").alias("cardinality"),
        D.property_text(text, "crossFilteringBehavior").alias("cross_filtering_behavior"),
        D.property_text(text, "securityFilteringBehavior").alias("security_filtering_behavior"),
        D.property_flag(text, "isActive", default=True).alias("is_active"),
    )
    readable = F.col("from_table").isNotNull() & F.col("to_table").isNotNull()
    return conform(rows.where(readable), "semantic_model_relationship")


def extract_model_header(files: DataFrame) -> DataFrame:
    """Model rows; the name falls back to the folder name."""
    text = D.protect_fences(F.col("content"))
    options = D.object_entries(text, "dataAccessOptions")
    notes = D.annotations(text)
    return conform(
        files.where(F.col("rel_path").rlike(_MODEL_FILE)).select(
            F.col("item_id").alias("semantic_model_id"),
            (F.col("workspace") if "workspace" in files.columns else F.lit(None)).alias("workspace_id"),
            F.coalesce(
                D.property_text(text, "name"), F.concat(F.col("item_name"), F.lit(MODEL_SUFFIX))
            ).alias("name"),
            D.property_text(text, "culture").alias("culture"),
            D.property_text(text, "defaultPowerBIDataSourceVersion").alias("data_source_version"),
            D.property_text(text, "sourceQueryCulture").alias("source_query_culture"),
            options.alias("data_access_options"),
            notes.alias("annotations"),
        ),
        "semantic_model",
    )


def extract_bins(columns: DataFrame) -> DataFrame:
    """Pairs (source column, derived group) from the ``semantic_links`` of columns."""
    link = F.explode(F.from_json("semantic_links", SEMANTIC_LINKS)).alias("link")
    target = F.col("link.LinkTarget")
    return (
        columns.where(F.col("semantic_links").isNotNull())
        .select("semantic_model_id", "table_name", "column_name", link)
        .where((F.col("link.LinkType") == "UsedInGroup") & (target["ObjectType"] == 4))
        .where((F.coalesce(target["TableName"], F.lit("")) != "") & (F.coalesce(target["TableItemName"], F.lit("")) != ""))
        .select(
            "semantic_model_id",
            "table_name",
            F.col("column_name").alias("source_column"),
            target["TableName"].alias("bin_table"),
            target["TableItemName"].alias("bin_column"),
        )
    )


def extract_variations(blocks: DataFrame) -> DataFrame:
    """Variation blocks of columns with the relationship they follow (null when none is given)."""
    return (
        _of_kind(blocks, "column")
        .select(
            "semantic_model_id",
            "table_name",
            F.col("block_name").alias("column_name"),
            F.explode(D.nested_blocks(F.col("body"), "variation")).alias("v"),
        )
        .select(
            "semantic_model_id",
            "table_name",
            "column_name",
            D.block_name(F.col("v"), "variation").alias("variation_name"),
            D.property_text(F.col("v"), "relationship").alias("relationship_name"),
        )
    )


def extract_model_catalog(files: DataFrame) -> dict[str, DataFrame]:
    """All model tables of the catalog from definition files."""
    models = files.where(F.col("item_kind") == "model") if "item_kind" in files.columns else files
    blocks = attribute_blocks(models.where(F.col("rel_path").rlike(_TABLE_FILE)))
    columns = extract_columns(blocks)
    partitions = extract_partitions(blocks)
    return {
        "semantic_model": extract_model_header(models),
        "semantic_model_table": flag_calculated_tables(extract_tables(models), partitions),
        "semantic_model_column": conform(columns, "semantic_model_column"),
        "semantic_model_measure": extract_measures(blocks),
        "semantic_model_partitions": conform(partitions, "semantic_model_partitions"),
        "semantic_model_relationship": extract_relationships(models),
        "semantic_model_table_bins": extract_bins(columns),
    }
