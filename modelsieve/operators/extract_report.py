"""Catalog rows from report documents, for the folder layout and the older single file.

Both layouts are brought to the same three frames first: reports, pages and visuals with
their JSON text. Everything after that is shared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.functions import report_json as J
from modelsieve.functions.names import MODEL_SUFFIX
from modelsieve.operators.usage import column_usage, measure_usage
from modelsieve.plans.fixpoint import materialize
from modelsieve.schemas import conform

_KEYS = ("report_id", "folder")
_VISUAL_FILE = r"^definition/pages/([^/]+)/visuals/[^/]+/visual\.json$"
_PAGE_FILE = r"^definition/pages/([^/]+)/page\.json$"

_CONTAINER = (
    "STRUCT<config: STRING, filters: STRING, x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
)
_SECTION = (
    "STRUCT<name: STRING, displayName: STRING, filters: STRING, config: STRING, visibility: INT, "
    f"height: DOUBLE, width: DOUBLE, visualContainers: ARRAY<{_CONTAINER}>>"
)


def _json(column: str, path: str) -> F.Column:
    return F.get_json_object(column, path)


def _report_id() -> F.Column:
    return F.col("item_id").alias("report_id")


_MAIN = ("definition/report.json", "report.json")


def _superseded(files: DataFrame) -> DataFrame:
    """Reports that have both main files: the folder layout wins over the single file."""
    has = [F.max((F.col("rel_path") == path).cast("int")).alias(f"has_{i}") for i, path in enumerate(_MAIN)]
    found = files.where(F.col("rel_path").isin(*_MAIN)).groupBy("item_id").agg(*has)
    return found.where("has_0 = 1 AND has_1 = 1").select(_report_id())


def _without_superseded(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Small rows taken from main files (with ``rel_path``), one main file per report."""
    old = _superseded(files).withColumn("rel_path", F.lit(_MAIN[1]))
    return rows.join(old, ["report_id", "rel_path"], "left_anti").drop("rel_path")


def report_format(content: F.Column) -> F.Column:
    """``pbir`` when the document names a schema, else ``legacy``."""
    keys = F.json_object_keys(content)
    return F.when(F.array_contains(keys, "$schema"), "pbir").otherwise("legacy")


def _setting(connection: F.Column, name: str) -> F.Column:
    """Value of a ``name=value`` entry of a connection string, without quotes."""
    entries = F.filter(
        F.split(connection, ";"), lambda e: F.lower(F.trim(F.substring_index(e, "=", 1))) == name
    )
    value = F.trim(F.substring(F.get(entries, 0), F.instr(F.get(entries, 0), "=") + 1, F.length(connection)))
    return F.translate(value, '"', "")


def extract_report_header(files: DataFrame) -> DataFrame:
    """Report rows: format, model name and model id from the reference, active page."""
    fmt = report_format(F.col("content"))
    first_section = F.coalesce(
        _json("content", "$.sections[0].name"), F.when(_json("content", "$.sections[0]").isNotNull(), "Page 1")
    )
    # Fields are taken out where the documents are read; only these go through the joins.
    main = files.where(F.col("rel_path").isin(*_MAIN)).select(
        _report_id(),
        "rel_path",
        F.col("item_name").alias("name"),
        F.col("workspace").alias("workspace_id"),
        fmt.alias("report_format"),
        first_section.alias("__first"),
        F.coalesce(
            _json("content", "$.filterConfig.filters"), F.when(fmt == "legacy", _json("content", "$.filters"))
        ).alias("filters"),
    )
    connection = _json("content", "$.datasetReference.byConnection.connectionString")
    # Where a source lies: protocol, host, version and tenant come before the name.
    source = F.split(_setting(connection, "data source"), "/")
    by_connection = F.array_join(F.slice(source, 6, F.greatest(F.size(source), F.lit(1))), "/")
    folder = F.element_at(F.split(_json("content", "$.datasetReference.byPath.path"), "/"), -1)
    by_path = F.when(folder.endswith(MODEL_SUFFIX), F.substring(folder, F.lit(1), F.length(folder) - len(MODEL_SUFFIX)))
    refs = files.where(F.col("rel_path") == "definition.pbir").select(
        _report_id(),
        F.nullif(F.when(connection.isNotNull(), by_connection).otherwise(by_path), F.lit("")).alias("model_name"),
        F.nullif(_setting(connection, "semanticmodelid"), F.lit("")).alias("semantic_model_reference"),
    )
    order = files.where(F.col("rel_path") == "definition/pages/pages.json").select(
        _report_id(), _json("content", "$.activePageName").alias("__active")
    )
    return (
        _without_superseded(main, files)
        .join(refs, "report_id", "left")
        .join(order, "report_id", "left")
        .select(
            "report_id",
            "name",
            "workspace_id",
            "semantic_model_reference",
            "model_name",
            "report_format",
            F.when(F.col("report_format") == "pbir", F.col("__active")).otherwise(F.col("__first")).alias(
                "active_page_name"
            ),
            "filters",
        )
    )


def extract_pages(files: DataFrame) -> DataFrame:
    """Pages of the folder layout, in ``pageOrder``; pages missing from the order are left out."""
    order = files.where(F.col("rel_path") == "definition/pages/pages.json").select(
        _report_id(), F.posexplode(F.from_json(_json("content", "$.pageOrder"), "ARRAY<STRING>")).alias("position", "folder")
    )
    pages = files.where(F.col("rel_path").rlike(_PAGE_FILE)).select(
        _report_id(), F.regexp_extract("rel_path", _PAGE_FILE, 1).alias("folder"), "content"
    )
    return order.join(pages, ["report_id", "folder"]).select(
        "report_id",
        "folder",
        _json("content", "$.name").alias("name"),
        _json("content", "$.displayName").alias("display_name"),
        _json("content", "$.displayOption").alias("display_option"),
        _json("content", "$.height").try_cast("double").try_cast("int").alias("height"),
        _json("content", "$.width").try_cast("double").try_cast("int").alias("width"),
        (F.coalesce(_json("content", "$.visibility"), F.lit("0")) != "1").alias("is_visible"),
        "position",
        _json("content", "$.filterConfig.filters").alias("filters"),
    )


def flatten_legacy_sections(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and visual documents of the older single-file layout.

    ``config`` and ``filters`` are JSON inside strings. The position comes from the container
    when the config has none, and the container's filters become the visual's filters.
    """
    docs = files.where(F.col("rel_path").isin(*_MAIN)).where(report_format(F.col("content")) == "legacy")
    sections = docs.select(
        _report_id(), "rel_path", F.posexplode(F.from_json(_json("content", "$.sections"), f"ARRAY<{_SECTION}>")).alias("position", "s")
    )
    # The section takes the part that a page folder has in the other layout.
    folder = F.concat_ws(" ", "rel_path", F.lit("section"), F.col("position").cast("string"))
    page_name = F.coalesce("s.name", F.concat(F.lit("Page "), (F.col("position") + 1).cast("string")))
    visibility = F.coalesce("s.visibility", _json("s.config", "$.visibility").try_cast("int"), F.lit(0))
    pages = sections.select(
        "report_id",
        "rel_path",
        folder.alias("folder"),
        page_name.alias("name"),
        F.coalesce("s.displayName", page_name).alias("display_name"),
        F.lit(None).cast("string").alias("display_option"),
        F.col("s.height").try_cast("int").alias("height"),
        F.col("s.width").try_cast("int").alias("width"),
        (visibility != 1).alias("is_visible"),
        "position",
        F.col("s.filters").alias("filters"),
    )
    containers = sections.select(
        "report_id", folder.alias("folder"), F.posexplode("s.visualContainers").alias("n", "c")
    )
    entries = F.coalesce(F.from_json("c.config", "MAP<STRING, STRING>"), F.create_map().cast("map<string,string>"))
    visuals = containers.select(
        "report_id",
        "folder",
        F.coalesce("c.config", F.lit("{}")).alias("doc"),
        F.coalesce(F.try_element_at(entries, F.lit("name")), F.concat(F.lit("visual_"), F.col("n").cast("string"))).alias(
            "name"
        ),
        F.when(F.size(F.from_json("c.filters", "ARRAY<STRING>")) > 0, F.col("c.filters")).alias("container_filters"),
        F.when(
            ~F.map_contains_key(entries, "position"),
            F.struct(
                F.coalesce("c.x", F.lit(0.0)).alias("x"),
                F.coalesce("c.y", F.lit(0.0)).alias("y"),
                F.coalesce("c.width", F.lit(100.0)).alias("width"),
                F.coalesce("c.height", F.lit(100.0)).alias("height"),
            ),
        ).alias("container_position"),
    )
    return _without_superseded(pages, files), visuals


def visual_documents(files: DataFrame, legacy: DataFrame) -> DataFrame:
    """Visuals of both layouts, one document per row, without a shuffle.

    A visual knows the ``folder`` of its page. The page name is attached to the small extracted
    rows by :func:`with_page_names`, so documents are never moved.
    """
    modern = files.where(F.col("rel_path").rlike(_VISUAL_FILE)).select(
        _report_id(),
        F.regexp_extract("rel_path", _VISUAL_FILE, 1).alias("folder"),
        J.parsed(F.col("content"), "STRUCT<name: STRING>")["name"].alias("name"),
        F.col("content").alias("doc"),
        _json("content", "$.filterConfig.filters").alias("filters"),
        F.lit(None).cast("struct<x:double,y:double,width:double,height:double>").alias("container_position"),
    )
    older = legacy.select(
        "report_id",
        "folder",
        "name",
        "doc",
        F.coalesce("container_filters", _json("doc", "$.filterConfig.filters")).alias("filters"),
        "container_position",
    )
    return modern.unionByName(older)


def with_page_names(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with the name of their page; rows of folders that are no page of the report go."""
    names = pages.select("report_id", "folder", F.col("name").alias("page_name"))
    return rows.join(names, ["report_id", "folder"]).drop("folder")


def report_visuals(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visual documents and pages of all reports, whichever layout they have."""
    legacy_pages, legacy_visuals = flatten_legacy_sections(files)
    pages = extract_pages(files).unionByName(legacy_pages)
    return visual_documents(files, legacy_visuals), pages


_LITERAL = "STRUCT<expr: STRUCT<Literal: STRUCT<Value: STRING>>>"
_SHOWN = (
    "STRUCT<position: STRUCT<x: STRING, y: STRING, width: STRING, height: STRING>, singleVisual: STRUCT<visualType: STRING>, "
    f"visual: STRUCT<visualType: STRING, objects: STRUCT<text: ARRAY<STRUCT<properties: STRUCT<text: {_LITERAL}>>>>, "
    f"visualContainerObjects: STRUCT<visualLink: ARRAY<STRUCT<properties: STRUCT<navigationSection: {_LITERAL}>>>>>>"
)


def _last_literal(entries: F.Column, prop: str) -> F.Column:
    present = F.filter(entries, lambda e: e["properties"][prop].isNotNull())
    value = F.try_element_at(present, F.lit(-1))["properties"][prop]["expr"]["Literal"]["Value"]
    return F.when(F.size(present) > 0, J.literal_text(F.coalesce(value, F.lit(""))))


def extract_visuals(visuals: DataFrame, pages: DataFrame) -> DataFrame:
    """Visual rows: type, position (defaults 0, 0, 100, 100), text and navigation target."""
    shown = visuals.select(*_KEYS, "name", "container_position", J.parsed(F.col("doc"), _SHOWN).alias("v"))

    def position(name: str, default: float) -> F.Column:
        return F.coalesce(F.col(f"container_position.{name}"), F.col(f"v.position.{name}").try_cast("double"), F.lit(default))

    found = shown.select(
        *_KEYS,
        "name",
        F.coalesce("v.visual.visualType", "v.singleVisual.visualType").alias("visual_type"),
        position("x", 0.0).alias("x"),
        position("y", 0.0).alias("y"),
        position("width", 100.0).alias("width"),
        position("height", 100.0).alias("height"),
        _last_literal(F.col("v.visual.objects.text"), "text").alias("text_content"),
        _last_literal(F.col("v.visual.visualContainerObjects.visualLink"), "navigationSection").alias("navigation_target"),
    )
    return conform(with_page_names(found, pages), "report_visual")


_FROM = f"STRUCT<`From`: {J.ALIASES}>"
_QUERY = f"STRUCT<prototypeQuery: {_FROM}, singleVisual: STRUCT<prototypeQuery: {_FROM}>>"


def visual_aliases(visuals: DataFrame, pages: DataFrame) -> DataFrame:
    """Alias → entity rows of the query of each visual."""
    parsed = visuals.select(*_KEYS, F.col("name").alias("visual_name"), J.parsed(F.col("doc"), _QUERY).alias("v"))
    found = parsed.select(*_KEYS, "visual_name", F.explode(J.query_aliases(F.col("v"))).alias("alias", "entity"))
    return with_page_names(found, pages)


def extract_field_refs(visuals: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per field reference occurrence: ``report_id, page_name, visual_name, kind, ref``.

    See :func:`report_json.document_refs` for what counts.
    """
    refs = visuals.select(*_KEYS, F.col("name").alias("visual_name"), F.explode(J.document_refs(F.col("doc"), F.col("filters"))).alias("r"))
    return with_page_names(refs.select(*_KEYS, "visual_name", "r.kind", "r.ref"), pages)


def unreadable_documents(files: DataFrame) -> DataFrame:
    """``report_id, rel_path`` of JSON documents that are no JSON objects; nothing is extracted from these."""
    documents = files.where(F.col("rel_path").rlike(r"\.json$") | (F.col("rel_path") == "definition.pbir"))
    return documents.where(~J.is_readable(F.col("content"))).select(_report_id(), "rel_path")


def filter_rows(owners: DataFrame, level: str) -> DataFrame:
    """Filters of reports, pages or visuals.

    ``owners`` has ``report_id``, ``folder`` or ``page_name``, perhaps ``visual_name`` and ``filters`` (JSON
    array text); where that is null, a visual's ``doc`` may have filters that are nested too deeply for it.
    """
    owns = "doc" in owners.columns
    parts = J.filter_parts(F.col("filters"), J.own_filters(F.col("doc")) if owns else None)
    names = [c for c in owners.columns if c not in ("filters", "doc")]
    with_any = owners if owns else owners.where("filters is not null")
    return with_any.select(*names, F.inline(parts)).withColumn("level", F.lit(level))


def extract_filters(reports: DataFrame, pages: DataFrame, visuals: DataFrame) -> DataFrame:
    """Filters of reports, pages and visuals in one frame with a ``level`` column."""
    at_report = filter_rows(reports.select("report_id", F.lit(None).cast("string").alias("page_name"), "filters"), "report")
    at_page = filter_rows(pages.select("report_id", F.col("name").alias("page_name"), "filters"), "page")
    owners = visuals.select(*_KEYS, F.col("name").alias("visual_name"), "filters", "doc")
    at_visual = with_page_names(filter_rows(owners, "visual"), pages)
    found = (conform(rows, "report_filter") for rows in (at_report, at_page, at_visual))
    return reduce(DataFrame.unionByName, found)


def extract_report_catalog(files: DataFrame) -> dict[str, DataFrame]:
    """All report tables of the catalog from definition files.

    The field references are written once, as two tables come from them.
    """
    found = files.where(F.col("item_kind") == "report") if "item_kind" in files.columns else files
    headers = extract_report_header(found)
    visuals, pages = report_visuals(found)
    refs = materialize(extract_field_refs(visuals, pages), "field-refs")
    return {
        "report": conform(headers, "report"),
        "report_page": conform(pages, "report_page"),
        "report_visual": extract_visuals(visuals, pages),
        "report_column_used": column_usage(refs),
        "report_measure_used": measure_usage(refs),
        "report_filter": extract_filters(headers, pages, visuals),
    }
