"""Connected components of a graph of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.llm.common import written


#: Edges of which one task takes care. Small graphs need few tasks and files in each round.
EDGES_PER_TASK = 50_000


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b``; the label is the smallest node.

    Each round takes the smallest label among a node and its neighbours and then the label of
    that label, so chains shorten by more than half. Rounds are written tables, and only the
    number of changes reaches the driver. Neighbours are combined before the shuffle. The number
    of edges sets the number of tasks, as far as shuffles have as many partitions.
    """
    edges = edges.where("a != b")
    both = written(edges.union(edges.select("b", "a")).toDF("u", "v").distinct(), "edges")
    tasks = max(1, math.ceil(both.count() / EDGES_PER_TASK))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.coalesce(tasks) if tasks < int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows

    first = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"))
    labels = written(dealt(first), "labels")
    while True:
        around = (
            dealt(both.join(labels.withColumnRenamed("node", "v"), "v")).groupBy("u").agg(F.min("label").alias("near"))
        ).withColumnRenamed("u", "node")
        lowered = dealt(labels.join(around, "node")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        targets = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = lowered.join(targets, "label").select("node", F.least("label", "next").alias("label"), "old")
        rounds = written(dealt(jumped).withColumn("changed", F.col("label") != F.col("old")).drop("old"), "labels")
        labels = rounds.drop("changed")
        if rounds.where("changed").isEmpty():
            return labels
