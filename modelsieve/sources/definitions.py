"""Reading definition files, payloads and workspace inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.functions.names import MODEL_SUFFIX, REPORT_SUFFIX

FILES_DDL = "workspace STRING, item_id STRING, item_name STRING, item_kind STRING, rel_path STRING, content STRING"

_ITEM = r"^(.*/)?([^/]+)(\.SemanticModel|\.Report)/(.+)$"


def classify_files(files: DataFrame) -> DataFrame:
    """Turn (path, content) rows into definition files of items.

    The item is the folder that ends in ``.SemanticModel`` or ``.Report``; its parent folder
    is the workspace. Other files are dropped. Item ids of local folders are
    ``local_<workspace>/<name>``, so items of one name in two workspaces stay apart.
    """
    suffix = F.regexp_extract("path", _ITEM, 3)
    workspace = F.regexp_extract(F.regexp_extract("path", _ITEM, 1), r"([^/]+)/$", 1)
    return (
        files.where(F.col("path").rlike(_ITEM))
        .select(
            workspace.alias("workspace"),
            F.concat(F.lit("local_"), workspace, F.lit("/"), F.regexp_extract("path", _ITEM, 2)).alias("item_id"),
            F.regexp_extract("path", _ITEM, 2).alias("item_name"),
            F.when(suffix == MODEL_SUFFIX, "model").when(suffix == REPORT_SUFFIX, "report").alias("item_kind"),
            F.regexp_extract("path", _ITEM, 4).alias("rel_path"),
            F.regexp_replace(F.col("content"), "^﻿", "").alias("content"),
        )
    )


def scan_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Definition files below a workspace root, one row per file, read in parallel."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{tmdl,json,pbir,pbism}")
        .load(path)
        .select("path", F.col("content").cast("string").alias("content"))
    )
    return classify_files(raw)


def decode_definition_parts(items: DataFrame) -> DataFrame:
    """File rows of item-definition payloads.

    ``items`` has a column ``definition`` with ``parts`` (path, payload, payloadType); all
    other columns are kept. Parts that are not inline base64 are dropped; a payload that is not
    valid base64 gives a null content, so that one damaged part does not stop the job.
    """
    keep = [c for c in items.columns if c != "definition"]
    return (
        items.select(*keep, F.explode("definition.parts").alias("__part"))
        .where(F.col("__part.payloadType") == "InlineBase64")
        .select(
            *keep,
            F.col("__part.path").alias("rel_path"),
            F.try_to_binary("__part.payload", F.lit("base64")).cast("string").alias("content"),
        )
    )


_ENTRY = "ARRAY<STRUCT<id: STRING, name: STRING>>"
INVENTORY_SCHEMA = (
    f"workspaces ARRAY<STRUCT<id: STRING, name: STRING, reports: {_ENTRY}, semantic_models: {_ENTRY}>>"
)


def read_workspace_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory documents (one JSON object per file)."""
    return spark.read.schema(INVENTORY_SCHEMA).option("multiLine", True).json(path)


def explode_workspace_inventory(inventory: DataFrame) -> DataFrame:
    """Rows (workspace_id, workspace_name, kind, item_id, item_name) of nested inventories."""
    ws = inventory.select(F.explode("workspaces").alias("w")).select("w.*")

    def items(field: str, kind: str) -> F.Column:
        entries = F.coalesce(F.col(field), F.from_json(F.lit("[]"), _ENTRY))
        return F.transform(
            entries,
            lambda e: F.struct(F.lit(kind).alias("kind"), e["id"].alias("item_id"), e["name"].alias("item_name")),
        )

    both = F.concat(items("reports", "report"), items("semantic_models", "semantic_model"))
    return ws.select(
        F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"), F.explode(both).alias("i")
    ).select("workspace_id", "workspace_name", "i.*")


def normalize_workspaces(df: DataFrame) -> DataFrame:
    """Workspace rows with defaults and the capacity rules applied.

    Input columns: id, displayName, description, type, capacityId, capacitySku, domainId.
    """
    blank = F.lit("")
    has_capacity = F.coalesce("capacityId", blank) != ""
    has_sku = F.coalesce("capacitySku", blank) != ""
    kind = F.when(has_capacity & ~has_sku & (F.coalesce("type", F.lit("workspace")) == "workspace"), "ppu")
    return df.select(
        "id",
        F.coalesce("displayName", blank).alias("displayName"),
        F.coalesce("description", blank).alias("description"),
        F.coalesce(kind, "type", F.lit("Workspace")).alias("type"),
        "capacityId",
        "domainId",
        (has_capacity & has_sku).alias("isOnDedicatedCapacity"),
    )


_CALC_FIELDS = (
    ("database_name", "database_name"),
    ("object_name", "object_name"),
    ("object_type", "object_type"),
    ("referenced_object_name", "referenced_object_name"),
    ("referenced_object_type", "referenced_object_type"),
    ("referenced_database_name", "referenced_database_name"),
    ("expression_text", "expression_text"),
    ("calc_dependency_type", "calc_dependency_type"),
)


def load_calc_dependencies(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Engine dependency rows with a model id looked up by database name.

    ``rows`` has ``workspace_id`` and a map ``fields`` whose keys are upper or lower case;
    the upper-case key wins unless it is empty. Unknown databases get a null model id.
    ``models``: (semantic_model_id, name).
    """

    def field(name: str) -> F.Column:
        upper = F.try_element_at("fields", F.lit(name.upper()))
        return F.coalesce(F.nullif(upper, F.lit("")), F.try_element_at("fields", F.lit(name)))

    flat = rows.select("workspace_id", *[field(source).alias(target) for source, target in _CALC_FIELDS])
    flat = flat.withColumn("expression_text", F.coalesce("expression_text", F.lit("")))
    ids = models.groupBy(F.col("name").alias("database_name")).agg(F.max("semantic_model_id").alias("semantic_model_id"))
    return flat.join(ids, "database_name", "left").select(
        "workspace_id", "semantic_model_id", *[target for _, target in _CALC_FIELDS]
    )
