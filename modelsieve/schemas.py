"""Fixed schemas of the catalog tables (natural keys, no surrogate ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DDL: dict[str, str] = {
    "workspaces": (
        "id STRING, displayName STRING, description STRING, type STRING, "
        "capacityId STRING, domainId STRING"
    ),
    "semantic_model": (
        "semantic_model_id STRING, workspace_id STRING, name STRING, culture STRING, "
        "data_source_version STRING, source_query_culture STRING, "
        "data_access_options MAP<STRING, STRING>, annotations MAP<STRING, STRING>"
    ),
    "semantic_model_table": (
        "semantic_model_id STRING, table_name STRING, is_hidden BOOLEAN, "
        "is_calculated BOOLEAN, source_code STRING"
    ),
    "semantic_model_column": (
        "semantic_model_id STRING, table_name STRING, column_name STRING, data_type STRING, "
        "summarize_by STRING, is_hidden BOOLEAN, format_string STRING, sort_by_column STRING, source_column STRING"
    ),
    "semantic_model_measure": (
        "semantic_model_id STRING, table_name STRING, measure_name STRING, expression STRING, "
        "format_string STRING, is_hidden BOOLEAN"
    ),
    "semantic_model_relationship": (
        "semantic_model_id STRING, relationship_name STRING, from_table STRING, "
        "from_column STRING, to_table STRING, to_column STRING, cardinality STRING, "
        "cross_filtering_behavior STRING, security_filtering_behavior STRING, is_active BOOLEAN"
    ),
    "semantic_model_table_bins": (
        "semantic_model_id STRING, table_name STRING, source_column STRING, "
        "bin_table STRING, bin_column STRING"
    ),
    "semantic_model_partitions": (
        "semantic_model_id STRING, table_name STRING, partition_name STRING, "
        "source_type STRING, mode STRING, source_expression STRING"
    ),
    "measure_direct_dependencies": (
        "semantic_model_id STRING, measure_name STRING, measure_table STRING, "
        "dependency_type STRING, referenced_name STRING, referenced_table STRING"
    ),
    "measure_dependencies": (
        "semantic_model_id STRING, measure_name STRING, measure_table STRING, "
        "dependency_type STRING, referenced_name STRING, referenced_table STRING"
    ),
    "calculated_table_dependencies": (
        "semantic_model_id STRING, calculated_table_name STRING, dependency_type STRING, "
        "referenced_name STRING, referenced_table STRING"
    ),
    "calc_dependencies_workspace": (
        "workspace_id STRING, semantic_model_id STRING, database_name STRING, "
        "object_name STRING, object_type STRING, referenced_object_name STRING, "
        "referenced_object_type STRING, referenced_database_name STRING, "
        "expression_text STRING, calc_dependency_type STRING"
    ),
    "report": (
        "report_id STRING, name STRING, workspace_id STRING, "
        "semantic_model_reference STRING, active_page_name STRING"
    ),
    "report_page": (
        "report_id STRING, name STRING, display_name STRING, display_option STRING, "
        "height INT, width INT, is_visible BOOLEAN, position INT"
    ),
    "report_visual": (
        "report_id STRING, page_name STRING, name STRING, visual_type STRING, "
        "x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, text_content STRING, "
        "navigation_target STRING"
    ),
    "report_column_used": (
        "report_id STRING, page_name STRING, visual_name STRING, table_name STRING, "
        "column_name STRING, usage_count BIGINT"
    ),
    "report_measure_used": (
        "report_id STRING, page_name STRING, visual_name STRING, table_name STRING, "
        "measure_name STRING, usage_count BIGINT"
    ),
    "report_filter": (
        "report_id STRING, level STRING, page_name STRING, visual_name STRING, "
        "filter_name STRING, table_name STRING, column_name STRING, filter_description STRING"
    ),
}


def struct_of(table: str) -> T.StructType:
    """The ``StructType`` of one catalog table."""
    return T.StructType.fromDDL(DDL[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` on a catalog schema: cast known columns, add missing ones as null.

    This is the additive schema migration of the catalog: a table written before a
    column existed reads with that column as null.
    """
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in struct_of(table).fields
        ]
    )


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty DataFrame with the schema of a catalog table."""
    return spark.createDataFrame([], struct_of(table))
