"""Re-import of models into a stored catalog, with the references of their measures kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.operators.graph import maintain_dependencies, transitive_dependencies
from modelsieve.operators.refs import direct_dependencies
from modelsieve.plans.fixpoint import materialize
from modelsieve.sources import catalog as C

MODEL = "semantic_model_id"
DIRECT, CLOSED = "measure_direct_dependencies", "measure_dependencies"


def write_with_dependencies(cat: C.Catalog, path: str, buckets: int = C.BUCKETS, **options: bool) -> None:
    """Write a catalog with the direct and the closed references of its measures."""
    direct = materialize(direct_dependencies(cat, **options), "direct")
    C.write_catalog({**cat, DIRECT: direct, CLOSED: transitive_dependencies(direct)}, path, buckets)


def reimport_models(spark: SparkSession, path: str, batch: C.Catalog, **options: bool) -> None:
    """Replace the models of ``batch`` and bring the stored references in line with them.

    The batch names its models in ``semantic_model``. Texts are read for these models only, and
    closed rows are derived again only for measures that the changes reach (see
    :func:`graph.maintain_dependencies`). Buckets without a re-imported model are neither read nor
    written, and all tables are prepared before the first is rewritten. ``options`` are those of
    ``direct_dependencies``.
    """
    stored = C.read_catalog(spark, path, ("semantic_model", DIRECT, CLOSED), views=False)
    models = batch["semantic_model"].dropDuplicates([MODEL])
    keys = C.match_items(stored["semantic_model"], models, MODEL).select(F.col(MODEL).alias("__key"), "stored_key")
    keys = materialize(keys, "reimport-keys")

    def renamed(rows: DataFrame) -> DataFrame:
        moved = rows.join(keys, rows[MODEL] == keys["__key"]).withColumn(MODEL, F.col("stored_key"))
        return moved.select(*rows.columns)

    again = {t: renamed(df) if MODEL in df.columns else df for t, df in batch.items()}
    old = stored.of_each(MODEL, keys.select(F.col("stored_key").alias(MODEL)))
    before, closed = materialize(old[DIRECT], "direct-before"), materialize(old[CLOSED], "closed-before")
    after = materialize(direct_dependencies(C.complete(spark, again), **options), "direct-after")
    C.upsert_stored_catalog(spark, path, {**again, DIRECT: after, CLOSED: maintain_dependencies(closed, before, after)})


def stale_models(spark: SparkSession, path: str) -> DataFrame:
    """Models whose stored direct references are not what their stored texts yield.

    Reads every text; for checks after a job that ended between the steps of a re-import.
    """
    cat = C.read_catalog(spark, path, views=False)
    columns = cat[DIRECT].columns
    sides = [direct_dependencies(cat).select(*columns), cat[DIRECT].distinct()]
    differ = sides[0].exceptAll(sides[1]).unionByName(sides[1].exceptAll(sides[0]))
    return differ.select(MODEL).distinct()
