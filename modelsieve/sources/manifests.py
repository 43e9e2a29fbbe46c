"""Subset manifests and subset specifications as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPEC = "STRUCT<columns: ARRAY<STRING>, measures: ARRAY<STRING>, hierarchies: ARRAY<STRING>, mode: STRING>"
_SEED = "STRUCT<name: STRING, search_direction: STRING, direction: STRING>"


def write_subset_manifest(tables: DataFrame, path: str) -> None:
    """Write manifest rows as JSON lines, one folder per call."""
    tables.write.mode("overwrite").json(path)


def read_subset_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read manifest rows back with their schema."""
    return spark.read.schema(schema).json(path)


def parse_subset_specs(documents: DataFrame, text: str = "content") -> DataFrame:
    """Subset specifications from JSON text, old forms included.

    One row per document: ``name``, ``base_model``, ``recursive`` (default true), ``max_depth``
    (default 10), ``seeds`` (array of table and direction) and ``table_elements``. Seeds come
    from ``initial_tables`` as objects or plain names, in any mix, else from ``included_tables``. The
    direction is ``search_direction``, else the older ``direction``, else ManyToOne.
    """
    doc = F.col(text)

    def value(path: str) -> F.Column:
        return F.get_json_object(doc, path)

    initial, included = value("$.initial_tables"), value("$.included_tables")
    default = F.lit("ManyToOne")

    def seed(entry: F.Column) -> F.Column:
        # Each entry is an object or a plain name, whatever the others are.
        fields = F.from_json(F.when(F.ltrim(entry).startswith("{"), entry), _SEED)
        return F.struct(
            F.when(fields.isNull(), entry).otherwise(fields["name"]).alias("table_name"),
            F.coalesce(fields["search_direction"], fields["direction"], default).alias("direction"),
        )

    entries = F.from_json(F.coalesce(initial, included, F.lit("[]")), "ARRAY<STRING>")
    seeds = F.filter(F.transform(entries, seed), lambda s: s["table_name"].isNotNull())
    keep = [c for c in documents.columns if c != text]
    return documents.select(
        *keep,
        value("$.name").alias("name"),
        value("$.base_model").alias("base_model"),
        F.coalesce(value("$.recursive").try_cast("boolean"), F.lit(True)).alias("recursive"),
        F.coalesce(value("$.max_depth").try_cast("int"), F.lit(10)).alias("max_depth"),
        seeds.alias("seeds"),
        F.from_json(F.coalesce(value("$.table_elements"), F.lit("{}")), f"MAP<STRING, {_SPEC}>").alias(
            "table_elements"
        ),
    )


def load_subset_spec(spark: SparkSession, path: str) -> DataFrame:
    """Specifications stored as one JSON document per file."""
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")
    return parse_subset_specs(files)


def spec_seeds(specs: DataFrame) -> DataFrame:
    """One row per seed: name, base_model, table_name, direction."""
    return specs.select("name", "base_model", F.explode("seeds").alias("s")).select("name", "base_model", "s.*")


def spec_elements(specs: DataFrame, keep: list[str]) -> DataFrame:
    """Element lists in long form, ready for ``apply_element_spec``.

    One row (``element`` null) per list that is present, and one row per listed element.
    """
    tables = specs.select(*keep, F.explode("table_elements").alias("table_name", "s"))
    rows = []
    for kind in ("column", "measure"):
        listed = tables.where(F.col(f"s.{kind}s").isNotNull())
        rows.append(
            listed.select(
                *keep,
                "table_name",
                F.coalesce("s.mode", F.lit("include")).alias("mode"),
                F.lit(kind).alias("kind"),
                F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col(f"s.{kind}s"))).alias("element"),
            )
        )
    return rows[0].unionByName(rows[1])
