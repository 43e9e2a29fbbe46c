"""Re-import as files arrive: the batch upsert, run on each micro-batch of a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modelsieve.sources.catalog import Catalog, upsert_stored_catalog


def item_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of item payloads (JSON lines), one row per item with its whole definition."""
    return spark.readStream.schema(schema).json(path)


def upsert_stream(
    items: DataFrame,
    extract: Callable[[DataFrame], Catalog],
    catalog_path: str,
    checkpoint: str,
    buckets: int | None = None,
    item: str = "item_id",
    version: str | None = None,
) -> StreamingQuery:
    """Keep a stored catalog up to date: each micro-batch replaces the items it holds.

    The upsert replaces whole items, so a batch that runs twice after a failure leaves the
    same catalog. Where a batch may hold several versions of an item, ``version`` names the column
    that orders them: the rows of the latest one are stored.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if version is not None:
            last = batch.groupBy(item).agg(F.max(version).alias("__last")).withColumnRenamed(item, "__item")
            same = (F.col(item) == F.col("__item")) & (F.col(version) == F.col("__last"))
            batch = batch.join(last, same, "left_semi")
        upsert_stored_catalog(batch.sparkSession, catalog_path, extract(batch), buckets)

    return (
        items.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
