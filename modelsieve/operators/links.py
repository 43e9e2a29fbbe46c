"""Which report belongs to which model, workspace and siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.functions.names import MODEL_SUFFIX, model_name_of_report

MODEL = "semantic_model_id"


def reports_by_name(reports: DataFrame, models: DataFrame) -> DataFrame:
    """(report_id, semantic_model_id) where the model is named like the report plus suffix."""
    names = models.select(MODEL, F.col("name").alias("__model_name"))
    return (
        reports.select("report_id", model_name_of_report(F.col("name")).alias("__model_name"))
        .join(names, "__model_name")
        .select("report_id", MODEL)
    )


def reports_by_reference(reports: DataFrame, models: DataFrame) -> DataFrame:
    """(report_id, semantic_model_id) where the report refers to the model's id."""
    return (
        reports.select("report_id", F.col("semantic_model_reference").alias(MODEL))
        .join(models.select(MODEL).distinct(), MODEL)
        .select("report_id", MODEL)
    )


def report_links(cat: dict[str, DataFrame], link_by: str = "name") -> DataFrame:
    """Report → model by naming convention (``name``) or by id (``reference``)."""
    if link_by == "name":
        return reports_by_name(cat["report"], cat["semantic_model"])
    if link_by == "reference":
        return reports_by_reference(cat["report"], cat["semantic_model"])
    raise ValueError(f"unknown link rule: {link_by}")


def link_keys(cat: dict[str, DataFrame], link_by: str = "name") -> tuple[DataFrame, DataFrame]:
    """What reports and models have in common: (report_id, link) and (model id, link).

    Rows of reports are reduced by ``link`` before models join, so a name that a thousand reports
    and a thousand models bear does not give a million pairs.
    """
    if link_by == "name":
        key, model = model_name_of_report(F.col("name")), F.col("name")
    elif link_by == "reference":
        key, model = F.col("semantic_model_reference"), F.col(MODEL)
    else:
        raise ValueError(f"unknown link rule: {link_by}")
    return (
        cat["report"].select("report_id", key.alias("link")),
        cat["semantic_model"].select(MODEL, model.alias("link")).distinct(),
    )


def reports_for_model(cat: dict[str, DataFrame], model_name: str | None = None) -> DataFrame:
    """Reports of one model, or of all models, by naming convention."""
    models = cat["semantic_model"].select(MODEL, F.col("name").alias("model_name"))
    if model_name is not None:
        models = models.where(F.col("model_name") == model_name)
    reports = cat["report"].select(
        "report_id", F.col("name").alias("report_name"), model_name_of_report(F.col("name")).alias("model_name")
    )
    return reports.join(models, "model_name").select(MODEL, "model_name", "report_id", "report_name")


def model_for_report(cat: dict[str, DataFrame], report_name: str | None = None) -> DataFrame:
    """Model of one report, or of every report; null when no model has the name."""
    reports = cat["report"]
    if report_name is not None:
        reports = reports.where(F.col("name") == report_name)
    models = cat["semantic_model"].groupBy(F.col("name").alias("model_name")).agg(F.min(MODEL).alias(MODEL))
    named = reports.select("report_id", F.col("name").alias("report_name"), model_name_of_report(F.col("name")).alias("__n"))
    return named.join(models, F.col("__n") == F.col("model_name"), "left").drop("__n")


def model_with_workspace(cat: dict[str, DataFrame]) -> DataFrame:
    """Models with the display name of their workspace, null when it is unknown."""
    ws = cat["workspaces"].select(F.col("id").alias("workspace_id"), F.col("displayName").alias("workspace_name"))
    return (
        cat["semantic_model"]
        .select(MODEL, F.col("name").alias("model_name"), "workspace_id")
        .join(ws, "workspace_id", "left")
        .select(MODEL, "model_name", "workspace_name")
    )


def sibling_reports(reports: DataFrame, of: DataFrame) -> DataFrame:
    """Other reports on the same model, for the reports in ``of`` (report_id).

    The output is one row per asked report and sibling, so ask for few reports; use
    :func:`sibling_counts` for all.
    """
    asked = reports.join(of.select("report_id").distinct(), "report_id", "left_semi").select(
        "report_id", "semantic_model_reference"
    )
    others = reports.select(
        F.col("report_id").alias("sibling_id"), F.col("name").alias("sibling_name"), "semantic_model_reference"
    )
    return asked.join(others, "semantic_model_reference").where(F.col("report_id") != F.col("sibling_id"))


def sibling_counts(reports: DataFrame) -> DataFrame:
    """Number of other reports on the same model, per report, without listing pairs."""
    sizes = reports.groupBy("semantic_model_reference").agg(F.count(F.lit(1)).alias("__n"))
    return reports.join(sizes, "semantic_model_reference").select(
        "report_id", "semantic_model_reference", (F.col("__n") - 1).alias("siblings")
    )


def resolve_model_id(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Model id for requests (request_id, semantic_model_id, name): id, else name, else first.

    The suffix is added to a name that lacks it. The first model is the smallest id.
    """
    by_id = models.select(F.col(MODEL).alias("__by_id")).distinct()
    by_name = models.groupBy(F.col("name").alias("__name")).agg(F.min(MODEL).alias("__by_name"))
    wanted = F.when(F.col("name").endswith(MODEL_SUFFIX), F.col("name")).otherwise(
        F.concat("name", F.lit(MODEL_SUFFIX))
    )
    first = models.agg(F.min(MODEL)).scalar()
    return (
        requests.withColumn("__name", wanted)
        .join(by_id, F.col(MODEL) == F.col("__by_id"), "left")
        .join(by_name, "__name", "left")
        .select(
            "request_id",
            F.coalesce("__by_id", "__by_name", first).alias("resolved_id"),
            F.when(F.col("__by_id").isNotNull(), "id").when(F.col("__by_name").isNotNull(), "name").otherwise("first").alias("resolved_by"),
        )
    )


def linked_by_name_ratio(cat: dict[str, DataFrame]) -> DataFrame:
    """How many reports find a model by naming convention."""
    names = cat["semantic_model"].select(F.col("name").alias("__n")).distinct().withColumn("__hit", F.lit(1))
    return (
        cat["report"]
        .select(model_name_of_report(F.col("name")).alias("__n"))
        .join(names, "__n", "left")
        .agg(F.count("__hit").alias("linked_reports"), F.count(F.lit(1)).alias("total_reports"))
    )
