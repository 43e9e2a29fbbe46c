"""Physical tables and columns behind the tables and columns of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.functions import source_steps as S
from modelsieve.operators.links import MODEL

TABLE = [MODEL, "table_name"]


def partition_sources(partitions: DataFrame) -> DataFrame:
    """Per partition with a readable query: physical schema and table, and the renamings on the way."""
    read = partitions.select(*TABLE, "partition_name", S.source_of(F.col("source_expression")).alias("s"))
    return read.select(*TABLE, "partition_name", "s.*").where("source_table is not null")


def physical_columns(columns: DataFrame, partitions: DataFrame) -> DataFrame:
    """Model column → physical column: model, ``table_name``, ``column_name``, ``schema_name``,
    ``source_table``, ``source_name``.

    A column without a source column (a calculated one) has no row; a table with several
    partitions has a row per physical table.
    """
    sources = partition_sources(partitions)
    named = columns.where(F.coalesce("source_column", F.lit("")) != "").select(*TABLE, "column_name", "source_column")
    return (
        named.join(sources, TABLE)
        .select(
            *TABLE, "column_name", "schema_name", "source_table",
            S.physical_name(F.col("renames"), F.col("source_column")).alias("source_name"),
        )
        .distinct()
    )


def physical_subset(kept: DataFrame, lineage: DataFrame) -> DataFrame:
    """Kept columns in terms of the data: model, ``table_name`` and ``column_name`` of the physical tables.

    Columns of tables without any known source keep their names; kept columns that are calculated
    in a table with a source need nothing of the data by themselves.
    """
    found = kept.select(*TABLE, "column_name").distinct().join(lineage, [*TABLE, "column_name"])
    physical = found.select(MODEL, F.col("source_table").alias("table_name"), F.col("source_name").alias("column_name"))
    unknown = kept.select(*TABLE, "column_name").join(lineage.select(*TABLE).distinct(), TABLE, "left_anti")
    return physical.unionByName(unknown).distinct()
