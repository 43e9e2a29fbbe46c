"""The smallest model that a set of reports, or a set of seed tables, needs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.operators.graph import (
    close_calculated_tables,
    close_sort_by,
    expand_tables,
    missing_seeds,
    pair_bins,
    reachable_measures,
    relationship_key_columns,
    relationships_between,
)
from modelsieve.operators.lineage import physical_subset
from modelsieve.operators.links import MODEL, link_keys
from modelsieve.operators.ranking import running_count
from modelsieve.operators.refs import external_table_refs
from modelsieve.operators.usage import linked_usage
from modelsieve.plans.fixpoint import materialize
from modelsieve.sources.catalog import one_item

TABLE = [MODEL, "table_name"]
COLUMN = [MODEL, "table_name", "column_name"]
MEASURE = [MODEL, "table_name", "measure_name"]
Catalog = dict[str, DataFrame]


def used_objects(cat: Catalog, link_by: str = "name", include_filters: bool = False) -> dict[str, DataFrame]:
    """Distinct columns and measures that the reports of each model use.

    Fields of report and page filters count only with ``include_filters``.
    """
    used = linked_usage(cat, link_by)
    if include_filters:
        reports, models = link_keys(cat, link_by)
        # By what reports and models have in common first, so that no report is paired with each model of a name.
        per_report = cat["report_filter"].select("report_id", "table_name", F.col("column_name").alias("field")).distinct()
        per_link = per_report.join(reports, "report_id").select("link", "table_name", "field").distinct()
        fields = per_link.join(models, "link").select(MODEL, "table_name", "field").distinct()
        columns = cat["semantic_model_column"].select(MODEL, "table_name", F.col("column_name").alias("field"), F.lit("column").alias("kind"))
        measures = cat["semantic_model_measure"].select(MODEL, "table_name", F.col("measure_name").alias("field"), F.lit("measure").alias("kind"))
        known = fields.join(columns.unionByName(measures), [MODEL, "table_name", "field"])
        used = used.unionByName(known.select(*used.columns)).distinct()
    used = materialize(used, "used-objects")
    return {
        "columns": used.where(F.col("kind") == "column").select(*TABLE, F.col("field").alias("column_name")),
        "measures": used.where(F.col("kind") == "measure").select(*TABLE, F.col("field").alias("measure_name")),
    }


def required_by_measures(dependencies: DataFrame, used_measures: DataFrame) -> dict[str, DataFrame]:
    """Tables, columns and measures that the used measures need, through any number of steps.

    ``dependencies`` may be direct or closed rows.
    """
    names = reachable_measures(dependencies, used_measures.select(MODEL, "measure_name").distinct())
    needed = materialize(
        dependencies.join(names, [MODEL, "measure_name"], "left_semi")
        .select(MODEL, "dependency_type", "referenced_name", "referenced_table")
        .distinct(),
        "required",
    )
    kind = F.col("dependency_type")
    has_table = F.coalesce("referenced_table", F.lit("")) != ""
    measures = needed.where(kind == "measure")
    tables = needed.where(kind == "table").select(MODEL, F.col("referenced_name").alias("table_name"))
    homes = measures.where(has_table).select(MODEL, F.col("referenced_table").alias("table_name"))
    return {
        "tables": tables.unionByName(homes).distinct(),
        "columns": needed.where((kind == "column") & has_table)
        .select(MODEL, F.col("referenced_table").alias("table_name"), F.col("referenced_name").alias("column_name"))
        .distinct(),
        "measures": measures.select(MODEL, F.col("referenced_name").alias("measure_name")).distinct(),
    }


def _keep_listed(objects: DataFrame, kept: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """Objects of kept tables: the listed ones, or all of a table without any listed one."""
    inside = objects.join(kept, TABLE, "left_semi")
    partial = listed.select(*TABLE).distinct()
    return inside.join(listed, key, "left_semi").unionByName(inside.join(partial, TABLE, "left_anti"))


class MinimalModel(Mapping):
    """``tables``, ``columns``, ``measures`` and ``relationships``, each set up when it is asked for.

    Only what several parts read is written as a table.
    """

    parts = ("tables", "columns", "measures", "relationships")

    def __init__(self, cat: Catalog, link_by: str, include_filters: bool) -> None:
        self.cat, self.link_by, self.include_filters = cat, link_by, include_filters

    def __getitem__(self, part: str) -> DataFrame:
        if part not in self.parts:
            raise KeyError(part)
        return getattr(self, part)

    def __iter__(self) -> Iterator[str]:
        return iter(self.parts)

    def __len__(self) -> int:
        return len(self.parts)

    @cached_property
    def _used(self) -> dict[str, DataFrame]:
        return used_objects(self.cat, self.link_by, self.include_filters)

    @cached_property
    def _report_tables(self) -> DataFrame:
        return self._used["columns"].select(*TABLE).unionByName(self._used["measures"].select(*TABLE)).distinct()

    @cached_property
    def _needed(self) -> dict[str, DataFrame]:
        return required_by_measures(self.cat["measure_dependencies"], self._used["measures"])

    @cached_property
    def _closed(self) -> tuple[DataFrame, DataFrame]:
        needed = self._needed
        start = self._report_tables.unionByName(needed["tables"]).unionByName(needed["columns"].select(*TABLE))
        return close_calculated_tables(start.distinct(), self.cat["calculated_table_dependencies"])

    @cached_property
    def _listed_measures(self) -> DataFrame:
        model_measure = self.cat["semantic_model_measure"].select(*MEASURE)
        chained = model_measure.join(self._needed["measures"], [MODEL, "measure_name"], "left_semi")
        return self._used["measures"].unionByName(chained).distinct()

    @cached_property
    def _reached(self) -> DataFrame:
        return materialize(self._closed[0].unionByName(self._listed_measures.select(*TABLE)).distinct(), "tables")

    @cached_property
    def relationships(self) -> DataFrame:
        return relationships_between(self.cat["semantic_model_relationship"], self._reached)

    @cached_property
    def _with_bins(self) -> tuple[DataFrame, DataFrame]:
        columns = (
            self._used["columns"]
            .unionByName(self._needed["columns"])
            .unionByName(self._closed[1])
            .unionByName(relationship_key_columns(self.relationships))
        )
        sorted_columns = close_sort_by(columns, self.cat["semantic_model_column"])
        all_columns, all_tables = pair_bins(sorted_columns, self._reached, self.cat["semantic_model_table_bins"])
        return materialize(all_columns, "columns"), all_tables

    @cached_property
    def _kept(self) -> DataFrame:
        return self.cat["semantic_model_table"].select(*TABLE).join(self._with_bins[1], TABLE, "left_semi").distinct()

    @cached_property
    def tables(self) -> DataFrame:
        # One row per table and mark, summed up at once.
        marks = [
            rows.select(*TABLE, F.lit(mark).alias("__mark"))
            for mark, rows in (
                ("kept", self._kept),
                ("report", self._report_tables),
                ("columns", self._with_bins[0]),
                ("measures", self._listed_measures),
            )
        ]
        has = {
            mark: F.max(F.col("__mark") == mark).alias(f"__{mark}") for mark in ("kept", "report", "columns", "measures")
        }
        rows = marks[0].unionByName(marks[1]).unionByName(marks[2]).unionByName(marks[3])
        return (
            rows.groupBy(*TABLE)
            .agg(*has.values())
            .where("__kept")
            .select(
                *TABLE,
                F.when(F.col("__report"), "report").otherwise("dax-dep").alias("provenance"),
                (~F.col("__columns")).alias("keeps_all_columns"),
                (~F.col("__measures")).alias("keeps_all_measures"),
            )
        )

    @cached_property
    def columns(self) -> DataFrame:
        model_column = self.cat["semantic_model_column"].select(*COLUMN)
        return _keep_listed(model_column, self._kept, self._with_bins[0], COLUMN).distinct()

    @cached_property
    def measures(self) -> DataFrame:
        model_measure = self.cat["semantic_model_measure"].select(*MEASURE)
        return _keep_listed(model_measure, self._kept, self._listed_measures, MEASURE).distinct()


def minimal_model(
    cat: Catalog, model: str | None = None, link_by: str = "name", include_filters: bool = False
) -> MinimalModel:
    """Tables, columns, measures and relationships that the reports of a model need.

    All models of the catalog at once, or one model id, of a stored catalog by its bucket alone. A kept table that nothing names a
    column (or measure) of keeps all of them; ``tables`` shows that in ``keeps_all_columns``
    and ``keeps_all_measures``. ``provenance`` is ``report`` for tables that reports use
    directly and ``dax-dep`` for tables that come in through dependencies.
    """
    if model is not None:
        cat = one_item(cat, MODEL, model)
    return MinimalModel(cat, link_by, include_filters)


def subset_from_seeds(
    cat: Catalog,
    seeds: DataFrame,
    recursive: bool = True,
    max_depth: int = 10,
    specs: DataFrame | None = None,
    active_only: bool = False,
) -> dict[str, DataFrame]:
    """Subset around seed tables (semantic_model_id, table_name, direction).

    Tables come from the relationship search (or are the seeds only), plus outside tables that
    measures of included tables name; such a table keeps the named columns unless ``specs``
    covers it. Seeds that the model lacks are returned under ``missing_seeds``.
    """
    model_tables = cat["semantic_model_table"].select(*TABLE).distinct()
    edges = cat["semantic_model_relationship"]
    if recursive:
        included = expand_tables(edges, seeds, max_depth, model_tables, active_only).select(*TABLE)
    else:
        included = seeds.select(*TABLE).distinct().join(model_tables, TABLE, "left_semi")
    included = materialize(included, "included")
    outside = materialize(external_table_refs(cat["semantic_model_measure"], included, model_tables), "outside")
    final = included.unionByName(outside.select(*TABLE)).distinct()
    kept = model_tables.join(final, TABLE, "left_semi")
    relationships = relationships_between(edges, final)
    auto = outside
    if specs is not None:
        auto = auto.join(specs.select(*TABLE).distinct(), TABLE, "left_anti")
    marker = auto.select(*TABLE).distinct().withColumn("element", F.lit(None).cast("string"))
    rows = marker.unionByName(auto.withColumnRenamed("column_name", "element"))
    rows = rows.withColumn("mode", F.lit("include")).withColumn("kind", F.lit("column"))
    all_specs = rows if specs is None else rows.unionByName(specs.select(*rows.columns))
    elements = apply_element_spec(cat, all_specs, kept, relationship_key_columns(relationships))
    return {
        "tables": kept.join(outside.select(*TABLE).distinct().withColumn("__auto", F.lit(True)), TABLE, "left").select(
            *TABLE, F.coalesce("__auto", F.lit(False)).alias("added_by_measure")
        ),
        "columns": elements["columns"],
        "measures": elements["measures"],
        "relationships": relationships,
        "missing_seeds": missing_seeds(seeds, model_tables),
    }


def _apply_kind(objects: DataFrame, specs: DataFrame, kind: str, name: str, always: DataFrame | None) -> DataFrame:
    key = [*TABLE, name]
    mine = specs.where(F.col("kind") == kind)
    modes = mine.groupBy(*TABLE).agg(F.max("mode").alias("__mode"))
    listed = (
        mine.where(F.col("element").isNotNull())
        .select(*TABLE, F.col("element").alias(name))
        .distinct()
        .withColumn("__listed", F.lit(True))
    )
    rows = objects.join(modes, TABLE, "left").join(listed, key, "left")
    protected = F.lit(False)
    if always is not None:
        rows = rows.join(always.select(*key).distinct().withColumn("__key", F.lit(True)), key, "left")
        protected = F.col("__key").isNotNull()
    is_listed = F.col("__listed").isNotNull()
    keep = (
        F.when(F.col("__mode").isNull(), True)
        .when(F.col("__mode") == "exclude", ~is_listed | protected)
        .otherwise(is_listed | protected)
    )
    return rows.where(keep).select(*objects.columns)


def apply_element_spec(
    cat: Catalog, specs: DataFrame, tables: DataFrame | None = None, key_columns: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Columns and measures that include/exclude lists keep.

    ``specs`` is in long form: semantic_model_id, table_name, mode, kind, element; a row with
    a null element says that the list exists. A kind without a list keeps everything.
    ``key_columns`` (ends of kept relationships) are kept in both modes.
    """
    columns = cat["semantic_model_column"]
    measures = cat["semantic_model_measure"]
    if tables is not None:
        columns = columns.join(tables.select(*TABLE).distinct(), TABLE, "left_semi")
        measures = measures.join(tables.select(*TABLE).distinct(), TABLE, "left_semi")
    kept = _apply_kind(columns, specs, "column", "column_name", key_columns)
    return {
        "columns": clear_invalid_sort_by(kept),
        "measures": _apply_kind(measures, specs, "measure", "measure_name", None),
    }


def removed_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns that the subset dropped, one row each."""
    return before.select(*COLUMN).distinct().join(after.select(*COLUMN).distinct(), COLUMN, "left_anti")


def clear_invalid_sort_by(columns: DataFrame) -> DataFrame:
    """Null out ``sort_by_column`` where that column is not kept."""
    kept = columns.select(*TABLE, F.col("column_name").alias("sort_by_column")).distinct().withColumn("__ok", F.lit(True))
    return columns.join(kept, [*TABLE, "sort_by_column"], "left").select(
        *[
            F.when(F.col("__ok"), F.col("sort_by_column")).alias("sort_by_column") if c == "sort_by_column" else F.col(c)
            for c in columns.columns
        ]
    )


def drop_invalid_variations(variations: DataFrame, relationships: DataFrame) -> DataFrame:
    """Variations whose relationship is kept; those without a relationship go."""
    return variations.join(
        relationships.select(MODEL, "relationship_name").distinct(), [MODEL, "relationship_name"], "left_semi"
    ).select(*variations.columns)


def prune_tables(
    tables: Mapping[str, DataFrame], kept: DataFrame, model: str | None = None, lineage: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Apply a subset to the data itself: kept tables with their kept columns only.

    ``kept`` holds (table_name, column_name) of the model. ``tables`` bear these names, or with ``lineage``
    (see :func:`lineage.physical_columns`) the physical ones that the model's columns come from. What comes to the driver is at most one row per
    column of the given schemas; the data is pruned in the scan.
    """
    spark = kept.sparkSession
    if model is not None:
        kept = kept.where(F.col(MODEL) == model)
    if lineage is not None:
        kept = physical_subset(kept, lineage)
    schema = spark.createDataFrame(
        [(name, column) for name, df in tables.items() for column in df.columns],
        "table_name STRING, column_name STRING",
    )
    names = schema.join(kept.select("table_name", "column_name").distinct(), ["table_name", "column_name"], "left_semi")
    wanted: dict[str, set[str]] = {}
    for row in names.collect():
        wanted.setdefault(row["table_name"], set()).add(row["column_name"])
    return {
        name: df.select(*[c for c in df.columns if c in wanted[name]]) for name, df in tables.items() if name in wanted
    }


def report_based_specs(cat: Catalog, link_by: str = "name") -> DataFrame:
    """Include lists from the columns that reports use, in long form.

    A used field that is a measure of the table counts as a measure; any other one counts as a
    column, known or not. Tables that the model lacks are ignored.
    """
    used = linked_usage(cat, link_by).where(F.col("kind") == "column").select(*TABLE, F.col("field").alias("element"))
    used = used.join(cat["semantic_model_table"].select(*TABLE).distinct(), TABLE, "left_semi")
    columns = cat["semantic_model_column"].select(*TABLE, F.col("column_name").alias("element")).distinct()
    measures = cat["semantic_model_measure"].select(*TABLE, F.col("measure_name").alias("element")).distinct()
    key = [*TABLE, "element"]
    rows = (
        used.join(columns.withColumn("__column", F.lit(True)), key, "left")
        .join(measures.withColumn("__measure", F.lit(True)), key, "left")
        .select(
            *TABLE,
            F.lit("include").alias("mode"),
            F.when(F.col("__column").isNull() & F.col("__measure"), "measure").otherwise("column").alias("kind"),
            "element",
        )
    )
    markers = rows.select(*TABLE, "mode", "kind").distinct().withColumn("element", F.lit(None).cast("string"))
    return rows.unionByName(markers)


def merge_pages(target: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pages of a target report followed by pages of source reports.

    Both frames: ``name``, ``source_order``, ``position`` (and ``keys`` that tell targets apart). The
    target's pages stay as they are, also if they share a name. Source pages come in the order of
    ``source_order`` and ``position``; one whose name is present already, in the target or in an
    earlier source page as it is named then, becomes ``name (k)`` with the smallest k from 2 on
    that is not present. Pages without a name are only appended. The result has ``original_name``
    and the new ``name``.

    Names of generated form make the names of sources depend on each other along chains such as
    ``A``, ``A (2)``, ``A (2) (2)``. Each round settles the names at one depth of such a chain: names whose
    base (the name without its last number) is no name of a page. The next round sees their
    results. Within a name all pages are numbered at once, however many there are.
    """
    first = F.lit(-1).cast("bigint")
    arrival = ["source_order", "position"]
    pages = target.withColumn("source_order", first).unionByName(
        sources.withColumn("source_order", F.col("source_order").cast("bigint")), allowMissingColumns=True
    )
    columns = [*pages.columns, "original_name"]
    pages = pages.withColumn("original_name", F.col("name"))
    is_named = F.coalesce("name", F.lit("")) != ""
    done = pages.where(~is_named | (F.col("source_order") == -1))
    fixed = done.where(is_named).select(*keys, "name", *arrival)
    open_pages = materialize(pages.where(is_named & (F.col("source_order") != -1)), "open-pages")
    return _settle(done, fixed, open_pages, list(keys), arrival).select(*columns)


#: A name that ends in a number as this operator gives them.
_NUMBER = r"(?:[2-9]|[1-9][0-9]+)"


def _settle(
    done: DataFrame, fixed: DataFrame, open_pages: DataFrame, keys: list[str], arrival: list[str]
) -> DataFrame:
    """Names of the open pages, depth by depth; ``fixed`` has the names of the target."""
    group = [*keys, "name"]
    endings = F.regexp_extract("name", rf"((?: \({_NUMBER}\))*)$", 1)
    open_pages = open_pages.withColumn("__depth", F.size(F.split(endings, r"\(")) - 1)
    deepest = open_pages.agg(F.max("__depth")).first()[0]
    if deepest is None:
        return done
    # Names "base (k)" that pages bear from the start, with the first arrival of each.
    numbered = (
        fixed.unionByName(open_pages.select(*group, *arrival))
        .groupBy(*group)
        .agg(F.min(F.struct(*arrival)).alias("__first"))
        .withColumn("__k", F.nullif(F.regexp_extract("name", rf" \(({_NUMBER})\)$", 1), F.lit("")).try_cast("bigint"))
        .where(F.col("__k").isNotNull())
        .select(*keys, F.regexp_replace("name", rf" \({_NUMBER}\)$", "").alias("name"), "__k", "__first.*")
    )
    held = fixed.select(*group).distinct()
    for depth in range(deepest + 1):
        here = open_pages.where(F.col("__depth") == depth).drop("__depth")
        ranked = running_count(here, group, arrival, name="__rank")
        ranked = ranked.join(held.withColumn("__held", F.lit(True)), group, "left")
        # The first page keeps its name unless an earlier page has it.
        ranked = ranked.withColumn("__rank", F.col("__rank") - F.when(F.col("__held"), 0).otherwise(1)).drop("__held")
        numbers = _numbers(ranked.where("__rank > 0"), numbered, group, arrival)
        ranked = ranked.join(numbers, [*group, "__rank"], "left")
        new = F.concat("name", F.lit(" ("), F.col("__number").cast("string"), F.lit(")"))
        named = materialize(ranked.withColumn("name", F.coalesce(new, F.col("name"))), "named-pages")
        done = done.unionByName(named.drop("__rank", "__number"))
        held = held.union(named.where("__number is not null").select(*group))
    return done


def _numbers(renamed: DataFrame, numbered: DataFrame, group: list[str], arrival: list[str]) -> DataFrame:
    """Number of the r-th renamed page of each name (``__rank``)."""
    # A number that a page bears is skipped if that page arrives before the renamed page whose turn
    # it would be. How many renamed pages arrive before it decides that.
    seen = running_count(
        renamed.select(*group, *arrival, F.lit(None).cast("bigint").alias("__k")).unionByName(numbered),
        group,
        arrival,
        flag=F.col("__k").isNull(),
        name="__before",
    ).where(F.col("__k").isNotNull())
    skipped = F.aggregate(
        F.array_sort(F.collect_list(F.struct("__k", "__before"))),
        F.array().cast("array<bigint>"),
        lambda taken, n: F.when(
            n["__k"] - 1 - F.size(taken) > n["__before"], F.array_append(taken, n["__k"])
        ).otherwise(taken),
    )
    marks = seen.groupBy(*group).agg(skipped.alias("__skipped")).select(
        *group, F.posexplode("__skipped").alias("__index", "__k")
    )
    marks = marks.select(*group, (F.col("__k") - 2 - F.col("__index")).alias("__at"), F.lit(0).alias("__is_page"))
    slots = renamed.select(*group, F.col("__rank").alias("__at"), F.lit(1).alias("__is_page"))
    # At equal places a page comes before a mark: only marks strictly before it count.
    merged = running_count(
        slots.unionByName(marks.select(*slots.columns)).withColumn("__sort", 1 - F.col("__is_page")),
        group,
        ["__at", "__sort"],
        flag=F.col("__is_page") == 0,
        name="__marks",
    ).where(F.col("__is_page") == 1)
    return merged.select(*group, F.col("__at").alias("__rank"), (F.col("__at") + 1 + F.col("__marks")).alias("__number"))


def subset_summary(minimal: Mapping[str, DataFrame]) -> DataFrame:
    """Per kept table: number of columns and measures and where the table came from."""
    extra = [c for c in minimal["tables"].columns if c not in TABLE]
    counts = []
    for kind in ("columns", "measures"):
        counts.append(minimal[kind].groupBy(*TABLE).agg(F.count(F.lit(1)).alias(kind)))
    zero = F.lit(0).cast("bigint")
    return (
        minimal["tables"]
        .join(counts[0], TABLE, "left")
        .join(counts[1], TABLE, "left")
        .select(*TABLE, *extra, F.coalesce("columns", zero).alias("columns"), F.coalesce("measures", zero).alias("measures"))
    )


def subset_totals(minimal: Mapping[str, DataFrame]) -> DataFrame:
    """Per model: number of kept tables and relationships."""
    rows = minimal["tables"].select(MODEL, F.lit(1).alias("t"), F.lit(0).alias("r")).unionByName(
        minimal["relationships"].select(MODEL, F.lit(0).alias("t"), F.lit(1).alias("r"))
    )
    return rows.groupBy(MODEL).agg(F.sum("t").alias("tables"), F.sum("r").alias("relationships"))


def subset_manifest(minimal: Mapping[str, DataFrame], used_measures: DataFrame, name: str) -> DataFrame:
    """Record of a subset, one row per entry, ready for ``write_subset_manifest``.

    Sections: ``report_table`` (used by reports), ``dax_extra_table`` (added by dependencies),
    ``used_measure`` (used by reports), ``chained_measure`` (kept for other measures) and
    ``relationship``. ``used_measures`` comes from :func:`used_objects`.
    """
    none = F.lit(None).cast("string")
    tables = minimal["tables"].select(
        MODEL,
        F.when(F.col("provenance") == "report", "report_table").otherwise("dax_extra_table").alias("section"),
        "table_name",
        none.alias("entry"),
    )
    direct = used_measures.select(*MEASURE).distinct().withColumn("__used", F.lit(True))
    measures = (
        minimal["measures"]
        .join(direct, MEASURE, "left")
        .select(
            MODEL,
            F.when(F.col("__used"), "used_measure").otherwise("chained_measure").alias("section"),
            "table_name",
            F.col("measure_name").alias("entry"),
        )
    )
    relationships = minimal["relationships"].select(
        MODEL, F.lit("relationship").alias("section"), F.col("from_table").alias("table_name"), F.col("relationship_name").alias("entry")
    )
    rows = tables.unionByName(measures).unionByName(relationships)
    return rows.select(F.lit(name).alias("subset_name"), F.lit("from_db").alias("method"), "*")
