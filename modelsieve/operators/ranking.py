"""Running counts within groups that may be larger than a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelsieve.plans.fixpoint import materialize


def running_count(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    flag: Column | None = None,
    name: str = "running",
) -> DataFrame:
    """Number of flagged rows of the same group up to and including each row.

    A plain window puts a whole group into one task. Here rows are spread by ranges of
    (group, order), so a huge group covers many tasks; each task counts its own part, and the
    counts of the earlier parts, one row per group and part, are added afterwards.
    """
    flagged = F.lit(1) if flag is None else F.when(flag, 1).otherwise(0)
    spread = df.withColumn("__flag", flagged).repartitionByRange(*group, *order).withColumn(
        "__part", F.spark_partition_id()
    )
    # Written once: the part numbers must be the same for the rows and for their counts.
    rows = materialize(spread, "running-count")
    here = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy(*group, "__part").agg(F.sum("__flag").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return (
        rows.withColumn("__local", F.sum("__flag").over(here))
        .join(offsets, [*group, "__part"])
        .withColumn(name, F.col("__local") + F.col("__offset"))
        .drop("__local", "__offset", "__part", "__flag")
    )
