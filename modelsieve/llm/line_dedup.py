"""Line dedup by distinct-site spread.

A line that occurs on many sites is boilerplate, however often one site repeats its own lines. Each
scan task merges a HyperLogLog sketch of the sites of every line hash, and the sketches merge again
after the shuffle, so a line found on a third of all rows costs one row per task. Where the estimate
lies near the threshold, within the sketch's error and at least one site, the distinct sites are
counted exactly. A line on ``min_sites`` or more sites stays only where it occurs first, in the
document with the smallest id; all its other occurrences go. Only hashes are joined; texts meet the
numbers of their removed lines once.

Lines are compared without blanks, tabs, form feeds and carriage returns at their ends, by 96 bits of hash. Blank lines stay and are never
boilerplate. A null site counts as one site of its own.

Defined cases: a null text counts as empty; it has one blank line and stays as it is (null in
``clean_documents``). Null ids rank before others. Rows that repeat id and text are one document:
the first occurrence stays in all of them. A text that loses all its lines becomes empty; its row
stays. An empty table gives an empty result. Columns other than id, text, site (and ``n_chars``,
which follows the text) are passed through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.llm.common import text_of, written

MIN_SITES = 10
#: Registers of a sketch, as a power of two.
REGISTERS = 12
#: Characters at the ends of a line that do not count: blank, tab, form and line feeds, carriage return.
ENDS = " \t\x0b\x0c\r"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str | None) -> DataFrame:
    site = F.coalesce(F.col(site_col).cast("string"), F.lit("")) if site_col else F.lit("")
    body = text_of(text_col)
    lines = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(body).alias("text_key"),
        site.alias("site"),
        F.posexplode(F.split(body, "\n")).alias("at", "line"),
    )
    line = F.trim("line", F.lit(ENDS))
    return lines.where(line != "").select("id", "text_key", "site", "at", F.xxhash64(line).alias("k1"), F.hash(line).alias("k2"))


def boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    registers: int = REGISTERS,
) -> DataFrame:
    """Hashes of the lines on ``min_sites`` or more sites with their first ``id`` and place; a written table."""
    lines = _lines(docs, id_col, text_col, site_col)
    spread = written(
        lines.groupBy("k1", "k2")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(registers))).alias("sites"),
            F.min(F.struct("id", "at")).alias("first"),
            F.count(F.lit(1)).alias("times"),
        )
        # Fewer occurrences than sites asked for cannot be spread that far.
        .where(F.col("times") >= min_sites)
        .drop("times"),
        "line-spread",
    )
    error = max(1, round(min_sites * 3 * 1.04 / 2 ** (registers / 2)))
    sure = spread.where(F.col("sites") > min_sites + error)
    near = spread.where(F.col("sites").between(min_sites - error, min_sites + error))
    exact = (
        lines.select("k1", "k2", "site")
        .join(near.select("k1", "k2"), ["k1", "k2"], "left_semi")
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("exactly"))
        .where(F.col("exactly") >= min_sites)
    )
    kept = near.join(exact.drop("exactly"), ["k1", "k2"], "left_semi")
    return written(sure.unionByName(kept).select("k1", "k2", "first"), "boilerplate")


def removed_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key`` and the numbers of the lines that go, per text."""
    lines = _lines(docs, id_col, text_col, None).drop("site")
    here = F.struct("id", "at")
    return (
        lines.join(found, ["k1", "k2"])
        .where(~here.eqNullSafe(F.col("first")))
        .groupBy("id", "text_key")
        .agg(F.collect_set("at").alias("gone"))
    )


def _rewritten(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``row`` of ``docs`` with its ``id`` and ``body`` and the numbers of the removed lines, ``gone`` (null if none go)."""
    found = boilerplate(docs, id_col=id_col, text_col=text_col, **options)
    gone = removed_lines(docs, found, id_col, text_col).withColumnsRenamed({"id": "gone_id", "text_key": "gone_key"})
    # The row is one column, so that its own columns may have any names.
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.xxhash64(text_of(text_col)).alias("text_key")
    )
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    return rows.join(gone, same, "left").select("row", "id", "body", "gone")


def _cleaned() -> Column:
    """The text without its removed lines: what lies between one and the next, in one pass."""
    lines = F.split(text_of("body"), "\n")
    cuts = F.concat(F.array(F.lit(-1)), F.array_sort("gone"), F.array(F.size(lines)))

    def between(i: Column) -> Column:
        before, after = F.get(cuts, i - 1), F.get(cuts, i)
        return F.slice(lines, before + 2, after - before - 1)

    rest = F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), between))
    return F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(rest, "\n"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All documents with their columns; texts without boilerplate lines, ``n_chars`` to match."""
    texts = _rewritten(docs, id_col, text_col, **options).withColumn("clean", _cleaned())
    changed = F.col("gone").isNotNull()

    def column(name: str) -> Column:
        given = F.col("row").getField(name)
        if name == text_col:
            return F.col("clean").alias(name)
        if name == "n_chars":
            return F.when(changed, F.length("clean")).otherwise(given).cast(docs.schema[name].dataType).alias(name)
        return given.alias(name)

    return texts.select(*map(column, docs.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, ``n_lines``, ``n_removed``, ``n_chars`` and ``text_sha256`` of what is left."""
    columns = [c for c in (id_col, text_col, options.get("site_col", "source")) if c in docs.columns]
    texts = _rewritten(docs.select(*columns), id_col, text_col, **options)
    clean = F.coalesce(_cleaned(), F.lit(""))
    return texts.select(
        F.col("id").alias(id_col),
        F.size(F.split(text_of("body"), "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.length(clean).cast("bigint").alias("n_chars"),
        F.sha2(clean, 256).alias("text_sha256"),
    )
