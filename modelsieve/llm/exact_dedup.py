"""Exact duplicates by skew-safe combining.

Equal texts are combined three times: within each task of the scan, within salted groups of a
digest, and over the salts. Every stage groups by the digest *and* the whole normalised text, so
texts that merely share a digest stay apart; digests meet without their texts. A text that makes up a
third of all rows leaves one row per scan task after the first stage and one row per salt after the
second. With one salt (``SALTS``) the stage between is left out and each text moves once.

Defined cases: a null text counts as empty; texts are equal if they are identical after each run
of blanks (space, tab, line and form feeds, carriage return) is replaced by one space. The
smallest id of a group stays. Null ids rank last: a group without any id keeps all its rows, with
a null ``keep_id``. Rows that repeat both id and text are one document and share its verdict. An
empty table gives an empty result. Only the id and text columns are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.llm.common import text_of, written

BLANKS = r"[\x20\x09-\x0D]+"
#: No stage between.
SALTS = 1
#: Salted groups of a digest in :func:`exact_groups`.
GROUP_SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = GROUP_SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    base = docs.select(F.col(id_col).alias("id"), normalised(text_of(text_col)).alias("body"))
    base = base.withColumn("digest", digest(F.col("body")))
    winners = _winners(base, salts)
    # Per digest, without the texts. More than one text under a digest is a collision.
    per_digest = winners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    found = written(per_digest, "exact-digests")
    decided = base.select("id", "digest", sha256(F.col("body")).alias("text_sha256")).join(
        found.where("texts = 1").drop("texts"), "digest"
    )
    collided = found.where("texts > 1")
    columns = ("id", "keep_id", "group_size", "text_sha256")
    result = decided.select(*columns)
    if not collided.isEmpty():
        apart = base.join(collided.select("digest"), "digest", "left_semi").join(winners, ["digest", "body"])
        result = result.unionByName(apart.withColumn("text_sha256", sha256(F.col("body"))).select(*columns))
    return result.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def _winners(base: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: digest, text, smallest id and number of rows."""
    if salts == 1:
        return base.groupBy("digest", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    salted = (
        base.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    # Dealt by the digest alone, the texts of a digest meet in one task and need no further shuffle.
    return (
        salted.repartition("digest")
        .groupBy("digest", "body")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns; rows that repeat id and text stay once."""
    kept = exact_groups(docs, id_col, text_col, **options).where("kept")
    kept = kept.select(F.col(id_col).alias("keep"), "text_sha256").distinct()
    # The row is one column, so that its own columns may have any names.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), sha256(normalised(text_of(text_col))).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("keep")) & (F.col("digest") == F.col("text_sha256"))
    return rows.dropDuplicates(["id", "digest"]).join(kept, same, "left_semi").select("row.*")
