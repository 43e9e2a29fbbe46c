"""Objects of a model that nobody uses.

``cat["measure_dependencies"]`` may hold the direct rows or the closed ones. What all measures of a
model reach together is what they name directly, so columns and tables need no closure; measures
are followed from the used ones only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.operators.graph import reachable_measures, relationship_key_columns
from modelsieve.operators.links import MODEL
from modelsieve.operators.usage import linked_usage, model_kpis
from modelsieve.plans.fixpoint import materialize


def _linked(cat: dict[str, DataFrame], link_by: str, linked: DataFrame | None) -> DataFrame:
    return linked_usage(cat, link_by) if linked is None else linked


def used_measures_closed(
    cat: dict[str, DataFrame], link_by: str = "name", linked: DataFrame | None = None
) -> DataFrame:
    """Measure names used by the reports of a model, and the measures those depend on.

    ``linked`` is the result of ``linked_usage`` where the caller has it already.
    """
    used = (
        _linked(cat, link_by, linked)
        .where(F.col("kind") == "measure")
        .select(MODEL, F.col("field").alias("measure_name"))
        .distinct()
    )
    return reachable_measures(cat["measure_dependencies"], used)


def unused_measures(
    cat: dict[str, DataFrame], link_by: str = "name", linked: DataFrame | None = None
) -> DataFrame:
    """Measures that no linked report uses, directly or through another measure."""
    return (
        cat["semantic_model_measure"]
        .select(MODEL, "table_name", "measure_name", "expression")
        .join(used_measures_closed(cat, link_by, linked), [MODEL, "measure_name"], "left_anti")
        .select(MODEL, "table_name", "measure_name", "expression")
    )


def unused_columns(
    cat: dict[str, DataFrame], link_by: str = "name", linked: DataFrame | None = None
) -> DataFrame:
    """Columns that no linked report, no measure of the model and no relationship uses."""
    in_reports = (
        _linked(cat, link_by, linked)
        .where(F.col("kind") == "column")
        .select(MODEL, "table_name", F.col("field").alias("column_name"))
    )
    in_measures = (
        cat["measure_dependencies"]
        .where((F.col("dependency_type") == "column") & (F.coalesce("referenced_table", F.lit("")) != ""))
        .select(MODEL, F.col("referenced_table").alias("table_name"), F.col("referenced_name").alias("column_name"))
    )
    in_relationships = relationship_key_columns(cat["semantic_model_relationship"])
    used = in_reports.unionByName(in_measures).unionByName(in_relationships).distinct()
    return (
        cat["semantic_model_column"]
        .select(MODEL, "table_name", "column_name", "data_type", "is_hidden")
        .join(used, [MODEL, "table_name", "column_name"], "left_anti")
        .select(MODEL, "table_name", "column_name", "data_type", "is_hidden")
    )


def unused_tables(
    cat: dict[str, DataFrame], link_by: str = "name", linked: DataFrame | None = None
) -> DataFrame:
    """Tables that nothing reaches: no usage, no measure and no relationship to a used table.

    A relationship with one used end keeps both of its tables, for one step.
    """
    deps = cat["measure_dependencies"]
    used = (
        _linked(cat, link_by, linked)
        .select(MODEL, "table_name")
        .unionByName(
            deps.where(F.col("dependency_type") == "table").select(MODEL, F.col("referenced_name").alias("table_name"))
        )
        .unionByName(
            deps.where((F.col("dependency_type") == "column") & (F.coalesce("referenced_table", F.lit("")) != "")).select(
                MODEL, F.col("referenced_table").alias("table_name")
            )
        )
        .distinct()
    )
    ends = cat["semantic_model_relationship"].select(MODEL, "from_table", "to_table").distinct()
    # Each end that is used keeps the other end.
    kept = [
        ends.join(used.withColumnRenamed("table_name", a), [MODEL, a], "left_semi").select(
            MODEL, F.col(b).alias("table_name")
        )
        for a, b in (("from_table", "to_table"), ("to_table", "from_table"))
    ]
    reached = used.unionByName(kept[0]).unionByName(kept[1]).distinct()
    return (
        cat["semantic_model_table"]
        .select(MODEL, "table_name", "is_hidden")
        .join(reached, [MODEL, "table_name"], "left_anti")
        .select(MODEL, "table_name", "is_hidden")
    )


def unused_summary(cat: dict[str, DataFrame], link_by: str = "name") -> DataFrame:
    """Unused columns, measures and tables: per table, and per model (table name null)."""
    linked = materialize(linked_usage(cat, link_by), "linked-usage")
    parts = [
        df.select(MODEL, "table_name", F.lit(kind).alias("kind"))
        for kind, df in (
            ("column", unused_columns(cat, link_by, linked)),
            ("measure", unused_measures(cat, link_by, linked)),
            ("table", unused_tables(cat, link_by, linked)),
        )
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    per_table = rows.groupBy(MODEL, "table_name").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"unused_{k}s") for k in ("column", "measure", "table")]
    )
    names = ["unused_columns", "unused_measures", "unused_tables"]
    return (
        per_table.rollup(MODEL, "table_name")
        .agg(*[F.sum(n).alias(n) for n in names])
        .where(F.col(MODEL).isNotNull())
    )


def reduction_preview(cat: dict[str, DataFrame], link_by: str = "name") -> DataFrame:
    """Used, total and removed tables, columns and measures per model."""
    totals = model_kpis(cat, link_by).select(MODEL, "tables", "columns", "measures")
    removed = unused_summary(cat, link_by).where(F.col("table_name").isNull()).drop("table_name")
    zero = F.lit(0).cast("bigint")
    result = totals.join(removed, MODEL, "left")
    out = [F.col(MODEL)]
    for kind in ("tables", "columns", "measures"):
        gone = F.coalesce(f"unused_{kind}", zero)
        out += [
            (F.col(kind) - gone).alias(f"used_{kind}"),
            F.col(kind).alias(f"total_{kind}"),
            gone.alias(f"removed_{kind}"),
        ]
    return result.select(*out)
