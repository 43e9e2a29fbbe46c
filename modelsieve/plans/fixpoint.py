"""Semi-naive iteration with lineage cut through tables in the shared checkpoint folder.

Every round is written as Parquet under ``spark.checkpoint.dir``. A written table survives
the loss of executors, carries exact size statistics (so the planner broadcasts a frontier
only when its files are small) and lets the next round start from a scan instead of from
the whole history of the loop.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUND = "round"


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the scratch folder once and return a scan of the written table."""
    path = _fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of which one task of :func:`distinct_rows` makes a set.
ROWS_PER_TASK = 1_000_000


def distinct_rows(df: DataFrame, n: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Distinct rows of a frame of about ``n`` rows, in so many tasks that the set of each stays bounded.

    The number of shuffle partitions is fixed, so that a plain distinct of more rows makes larger sets.
    """
    tasks = math.ceil(n / per_task)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.distinct()
    return df.repartition(tasks, *df.columns).distinct()


#: Rows of a key that one side brings to a task of :func:`join_by_pairs` at a time; their pairs are its square.
ROWS_PER_SIDE = 3000
#: Tasks are counted by the driver, which holds something for each.
MOST_TASKS = 10_000


def join_by_pairs(left: DataFrame, right: DataFrame, key: Sequence[str], per_side: int | None = None) -> DataFrame:
    """Inner join of two written frames on ``key``, in tasks by the number of pairs.

    Where a key has many rows on both sides, few bytes make many pairs, and tasks that are dealt out by the
    bytes they read are few. The rows of a key are split by hash into parts of about ``per_side`` rows on either
    side, and each part meets each part of the other side in one place.
    """
    key, per_side = list(key), per_side or ROWS_PER_SIDE
    sizes = left.groupBy(*key).agg(F.count(F.lit(1)).alias("__l")).join(
        right.groupBy(*key).agg(F.count(F.lit(1)).alias("__r")), key
    )
    sizes = materialize(sizes, "pair-sizes")
    pairs = sizes.agg(F.sum(F.col("__l").cast("double") * F.col("__r"))).first()[0] or 0
    tasks = min(math.ceil(pairs / per_side**2), MOST_TASKS)
    if tasks <= 1:
        return left.join(right, key)
    parts = sizes.select(*key, *(F.ceil(F.col(c) / per_side).cast("bigint").alias(c) for c in ("__l", "__r")))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(parts, key).withColumn("__own", F.pmod(F.xxhash64(*df.columns), F.col(own)))
        rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        rows = rows.select(*df.columns, F.col("__own").alias(own), F.col("__other").alias(other))
        return rows.repartition(tasks, *key, "__l", "__r")

    return dealt(left, "__l", "__r").join(dealt(right, "__r", "__l"), [*key, "__l", "__r"]).drop("__l", "__r")


class RoundTable:
    """Rows of a loop, one ``round=<n>`` folder per iteration."""

    def __init__(self, spark: SparkSession, schema: T.StructType, label: str = "rounds") -> None:
        self.spark = spark
        self.schema = schema
        self.path = _fresh(spark, label)
        self.rounds = 0

    def append(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Write the next round; a scan of it and its number of rows, counted while writing."""
        folder = f"{self.path}/{ROUND}={self.rounds}"
        seen = Observation()
        df.select(*self.schema.names).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(folder)
        self.rounds += 1
        return self.spark.read.schema(self.schema).parquet(folder), seen.get.get("n", 0)

    def all(self) -> DataFrame:
        """Scan of every round so far, with the round number as a partition column."""
        schema = T.StructType([*self.schema.fields, T.StructField(ROUND, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)


def grow(
    seed: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    key: Sequence[str] | None = None,
    max_rounds: int | None = None,
    label: str = "grow",
    seed_is_distinct: bool = False,
) -> DataFrame:
    """Least fixpoint of ``step`` over ``seed``.

    ``step`` maps the rows found in the last round to candidate rows. Candidates whose
    ``key`` was seen before are dropped by an anti-join, so each row enters the frontier
    once and the loop ends on cyclic inputs. The result carries the round in which a row
    was first found (0 = seed).
    """
    key = list(key or seed.columns)
    columns = seed.columns
    table = RoundTable(seed.sparkSession, seed.schema, label)
    frontier, n = table.append(seed if seed_is_distinct else seed.dropDuplicates(key))
    while n and (max_rounds is None or table.rounds <= max_rounds):
        candidates = step(frontier).select(*columns)
        candidates = candidates.distinct() if set(key) == set(columns) else candidates.dropDuplicates(key)
        frontier, n = table.append(candidates.join(table.all().select(*key), key, "left_anti"))
    return table.all()



def grow_by_doubling(
    edges: DataFrame, group: Sequence[str], source: Sequence[str], target: Sequence[str], label: str = "doubling"
) -> DataFrame:
    """All pairs (source, target) that edges connect, with the smallest number of steps.

    ``edges`` is distinct. The first column of ``source`` and of ``target`` names a node within ``group``; further
    columns travel along with it. A round joins the pairs that are exactly as far apart as the last round
    could reach to all pairs so far, which doubles the reach: a chain of a thousand edges takes ten
    rounds. On a shortest path, the node at that distance splits it into two shortest paths, so no
    pair is missed, the sums are the true distances, and cycles end the loop like dead ends.
    """
    key = [*group, *source, *target]
    table = RoundTable(edges.sparkSession, edges.select(*key, F.lit(1).alias("steps")).schema, label)
    newest, n = table.append(edges.select(*key, F.lit(1).alias("steps")))
    reach = 1
    while n:
        known = table.all().drop(ROUND)
        onward = known.select(
            *group,
            F.col(source[0]).alias(target[0]),
            *(F.col(c).alias(f"__{c}") for c in target),
            F.col("steps").alias("__steps"),
        )
        farthest = newest.where(F.col("steps") == reach).select(*group, *source, target[0], "steps")
        joined = farthest.distinct().join(onward, [*group, target[0]]).select(
            *group, *source, *(F.col(f"__{c}").alias(c) for c in target), (F.col("steps") + F.col("__steps")).alias("steps")
        )
        found = joined.groupBy(*key).agg(F.min("steps").alias("steps")).join(known.select(*key), key, "left_anti")
        newest, n = table.append(found)
        reach *= 2
    return table.all().drop(ROUND)
