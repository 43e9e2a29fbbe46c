"""Closures over the reference graph and the relationship graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.plans.fixpoint import ROUND, distinct_rows, grow, grow_by_doubling, materialize
from modelsieve.schemas import conform

MODEL = "semantic_model_id"
DIRECTIONS = ("ManyToOne", "OneToMany", "Both")


def reachable_measures(dependencies: DataFrame, measures: DataFrame) -> DataFrame:
    """``measures`` (model, measure name) and all measures they reach, each once.

    ``dependencies`` may be direct or closed. The work grows with the measures, not with pairs.
    """
    hops = dependencies.where(F.col("dependency_type") == "measure").select(
        MODEL, "measure_name", F.col("referenced_name").alias("__next")
    )
    return grow(
        measures.select(MODEL, "measure_name"),
        lambda frontier: frontier.join(hops, [MODEL, "measure_name"]).select(MODEL, F.col("__next").alias("measure_name")),
        label="reachable-measures",
    ).select(MODEL, "measure_name")


def _measure_pairs(direct: DataFrame) -> DataFrame:
    """(measure, reached measure) pairs with their steps; home tables travel along, so no join brings them back."""
    blank = F.lit("")
    edges = (
        direct.where(F.col("dependency_type") == "measure")
        .select(
            MODEL,
            "measure_name",
            F.coalesce("measure_table", blank).alias("measure_table"),
            F.col("referenced_name").alias("reached"),
            F.coalesce("referenced_table", blank).alias("reached_table"),
        )
        .distinct()
    )
    return grow_by_doubling(
        edges, [MODEL], ["measure_name", "measure_table"], ["reached", "reached_table"], label="measure-closure"
    )


def measure_closure(direct: DataFrame) -> DataFrame:
    """All (measure, reached measure) pairs with the number of steps, cycles included."""
    return _measure_pairs(direct).select(MODEL, "measure_name", "reached", "steps")


_ROW = [MODEL, "measure_name", "measure_table", "dependency_type", "referenced_name", "referenced_table"]


def transitive_dependencies(direct: DataFrame) -> DataFrame:
    """Dependencies of every measure including those of all measures it reaches.

    Column and table rows of a reached measure are inherited; a reached measure becomes a
    measure row. The closure visits each pair once and so ends on cyclic references.
    """
    pairs = _measure_pairs(direct)
    reached = pairs.select(
        MODEL,
        "measure_name",
        "measure_table",
        F.lit("measure").alias("dependency_type"),
        F.col("reached").alias("referenced_name"),
        F.col("reached_table").alias("referenced_table"),
    )
    leaves = (
        direct.where(F.col("dependency_type") != "measure")
        .select(MODEL, F.col("measure_name").alias("reached"), "dependency_type", "referenced_name", "referenced_table")
        .distinct()
    )
    inherited = pairs.join(leaves, [MODEL, "reached"]).select(*reached.columns)
    owner = F.coalesce("measure_table", F.lit("")).alias("measure_table")
    own = direct.where(F.col("dependency_type") != "measure").select(*_ROW[:2], owner, *_ROW[3:])
    return conform(reached.unionByName(inherited).unionByName(own), "measure_dependencies").distinct()


def changed_measures(before: DataFrame, after: DataFrame) -> DataFrame:
    """Measures (model, name) whose direct rows are not the same any more, found by counting supports."""
    support = before.select(*_ROW, F.lit(-1).alias("n")).unionByName(after.select(*_ROW, F.lit(1).alias("n")))
    # A row that both sides have, however often each has it, cancels out.
    sides = support.groupBy(*_ROW).agg(F.max("n").alias("now"), F.min("n").alias("then"))
    return sides.where("now <> -then").select(MODEL, "measure_name").distinct()


def maintain_dependencies(closed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``transitive_dependencies(after)`` from ``transitive_dependencies(before)``, by delete and re-derive.

    Only measures that changed or that reach a changed one are affected: a way through a changed
    reference first leads to the measure that has it, over references that were there before, so the
    closed rows name all of them in one join. Their rows are deleted and derived again from the
    references among themselves; where such a way leaves the affected measures it never comes back,
    and the closed rows of the measure there are taken over as they are. Work grows with the rows
    of affected measures, whatever the size of the rest. Cycles that a change breaks or closes are
    affected as a whole.
    """
    changed = materialize(changed_measures(before, after), "changed-measures")
    is_measure = F.col("dependency_type") == "measure"
    reaching = closed.where(is_measure).join(
        changed.withColumnRenamed("measure_name", "referenced_name"), [MODEL, "referenced_name"], "left_semi"
    )
    affected = materialize(
        changed.unionByName(reaching.select(MODEL, "measure_name")).distinct(), "affected-measures"
    )
    kept = closed.select(*_ROW).join(affected, [MODEL, "measure_name"], "left_anti")
    home = F.when(is_measure, F.coalesce("referenced_table", F.lit(""))).otherwise(F.col("referenced_table"))
    rows = after.select(*_ROW[:5], home.alias("referenced_table")).distinct()
    own = materialize(rows.join(affected, [MODEL, "measure_name"], "left_semi"), "affected-rows")
    inside = affected.withColumnRenamed("measure_name", "referenced_name")
    among = own.where(is_measure).join(inside, [MODEL, "referenced_name"], "left_semi")
    pairs = _measure_pairs(among).select(MODEL, "measure_name", "measure_table", "reached")
    selves = own.select(MODEL, "measure_name", F.coalesce("measure_table", F.lit("")).alias("measure_table"), F.col("measure_name").alias("reached"))
    ways = materialize(pairs.unionByName(selves).distinct(), "affected-ways")

    def along(rows: DataFrame) -> DataFrame:
        """Rows of reached measures as rows of the measures that reach them."""
        theirs = rows.select(MODEL, F.col("measure_name").alias("reached"), *_ROW[3:]).distinct()
        return ways.join(theirs, [MODEL, "reached"]).select(*_ROW)

    exits = own.where(is_measure).join(inside, [MODEL, "referenced_name"], "left_anti")
    beyond = (
        exits.select(MODEL, "measure_name", F.col("referenced_name").alias("__exit"))
        .distinct()
        .join(kept.select(MODEL, F.col("measure_name").alias("__exit"), *_ROW[3:]).distinct(), [MODEL, "__exit"])
        .select(MODEL, "measure_name", F.lit(None).cast("string").alias("measure_table"), *_ROW[3:])
    )
    again = along(own.unionByName(beyond))
    return conform(kept.unionByName(again.distinct()), "measure_dependencies")


def table_dependency_graph(dependencies: DataFrame) -> DataFrame:
    """Owner table → other tables that its measures name, alone or with a column, without self edges."""
    return (
        dependencies.where((F.col("dependency_type") == "table") & (F.coalesce("measure_table", F.lit("")) != ""))
        .select(MODEL, F.col("measure_table").alias("table_name"), F.col("referenced_name").alias("depends_on"))
        .where(F.col("table_name") != F.col("depends_on"))
        .distinct()
    )


def _walkable(edges: DataFrame, active_only: bool) -> DataFrame:
    """Edges the search may follow: cardinality names a many side (missing = many to one)."""
    many = F.lower(F.coalesce("cardinality", F.lit("manyToOne"))).contains("many")
    kept = edges.where(many & F.col("from_table").isNotNull() & F.col("to_table").isNotNull())
    if active_only:
        kept = kept.where("is_active")
    return kept.select(MODEL, "from_table", "to_table").distinct()


def expand_tables(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int = 10,
    tables: DataFrame | None = None,
    active_only: bool = False,
) -> DataFrame:
    """Tables within ``max_depth`` relationships of the seeds, with their smallest depth.

    ``seeds``: (semantic_model_id, table_name, direction). The direction holds for the first
    step; tables that were found go on from the many side to the one side. With ``tables``,
    seeds that the model does not have are left out (see :func:`missing_seeds`).
    """
    walk = materialize(_walkable(edges, active_only), "walk")
    forward = walk.select(MODEL, F.col("from_table").alias("table_name"), F.col("to_table").alias("__next"))
    backward = walk.select(MODEL, F.col("to_table").alias("table_name"), F.col("from_table").alias("__next"))
    start = seeds.select(MODEL, "table_name", "direction").distinct()
    if tables is not None:
        start = start.join(tables.select(MODEL, "table_name").distinct(), [MODEL, "table_name"], "left_semi")

    def one_step(nodes: DataFrame, hops: DataFrame) -> DataFrame:
        return nodes.join(hops, [MODEL, "table_name"]).select(MODEL, F.col("__next").alias("table_name"))

    nodes = start.select(MODEL, "table_name").distinct()
    if max_depth < 1:
        return nodes.withColumn("depth", F.lit(0))
    first = (
        one_step(start.where(F.col("direction").isin("ManyToOne", "Both")), forward)
        .unionByName(one_step(start.where(F.col("direction").isin("OneToMany", "Both")), backward))
        .distinct()
        .join(nodes, [MODEL, "table_name"], "left_anti")
    )
    # Seeds take part as visited rows, so a walk that returns to a seed stops there.
    visited_seeds = nodes.withColumn("__seed", F.lit(True))
    level = first.withColumn("__seed", F.lit(False)).unionByName(visited_seeds)
    found = grow(
        level,
        lambda frontier: one_step(frontier.where(~F.col("__seed")), forward).withColumn("__seed", F.lit(False)),
        key=(MODEL, "table_name"),
        max_rounds=max_depth - 1,
        label="expand-tables",
    )
    depth = F.when(F.col("__seed"), F.lit(0)).otherwise(F.col(ROUND) + 1)
    return found.select(MODEL, "table_name", depth.alias("depth"))


def missing_seeds(seeds: DataFrame, tables: DataFrame) -> DataFrame:
    """Seeds that name no table of their model."""
    return seeds.join(tables.select(MODEL, "table_name").distinct(), [MODEL, "table_name"], "left_anti")


def neighbours(edges: DataFrame, table: str | None = None) -> DataFrame:
    """Tables one relationship away, in either direction; for one table or for all.

    For all, the relationships are written once, and their number sets the number of tasks.
    """
    edges = edges.select(MODEL, "from_table", "to_table").where(F.col("from_table").isNotNull() & F.col("to_table").isNotNull())
    if table is None:
        edges = materialize(edges, "edges")
    pairs = edges.select(MODEL, F.col("from_table").alias("table_name"), F.col("to_table").alias("neighbour")).unionByName(
        edges.select(MODEL, F.col("to_table").alias("table_name"), F.col("from_table").alias("neighbour"))
    )
    if table is not None:
        return pairs.where(F.col("table_name") == table).distinct()
    return distinct_rows(pairs, 2 * edges.count())


def close_calculated_tables(tables: DataFrame, calc_deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables that included calculated tables need, until no change; and the columns they name."""
    needed = materialize(
        calc_deps.where(
            (F.col("dependency_type") == "table")
            | ((F.col("dependency_type") == "column") & (F.coalesce("referenced_table", F.lit("")) != ""))
        )
        .select(
            MODEL,
            F.col("calculated_table_name").alias("table_name"),
            F.when(F.col("dependency_type") == "table", F.col("referenced_name"))
            .otherwise(F.col("referenced_table"))
            .alias("__next"),
            F.when(F.col("dependency_type") == "column", F.col("referenced_name")).alias("column_name"),
        )
        .distinct(),
        "calculated-needs",
    )
    hops = needed.select(MODEL, "table_name", "__next").distinct()
    closed = grow(
        tables.select(MODEL, "table_name").distinct(),
        lambda frontier: frontier.join(hops, [MODEL, "table_name"]).select(MODEL, F.col("__next").alias("table_name")),
        label="calculated-tables",
    ).select(MODEL, "table_name")
    columns = (
        needed.where(F.col("column_name").isNotNull())
        .join(closed, [MODEL, "table_name"], "left_semi")
        .select(MODEL, F.col("__next").alias("table_name"), "column_name")
        .distinct()
    )
    return closed, columns


def close_sort_by(columns: DataFrame, model_column: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Included columns plus the columns they sort by, if the table has them, along whole chains."""
    exists = model_column.select(MODEL, "table_name", F.col("column_name").alias("sort_by_column"))
    hops = materialize(
        model_column.where(F.coalesce("sort_by_column", F.lit("")) != "")
        .select(MODEL, "table_name", "column_name", "sort_by_column")
        .join(exists, [MODEL, "table_name", "sort_by_column"], "left_semi")
        .distinct(),
        "sort-by-edges",
    )
    return grow(
        columns.select(MODEL, "table_name", "column_name").distinct(),
        lambda frontier: frontier.join(hops, [MODEL, "table_name", "column_name"]).select(
            MODEL, "table_name", F.col("sort_by_column").alias("column_name")
        ),
        max_rounds=max_rounds,
        label="sort-by",
    ).select(MODEL, "table_name", "column_name")


def pair_bins(columns: DataFrame, tables: DataFrame, bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass over grouped columns.

    An included source brings its bin if the bin's table is included; an included bin brings
    its source column and the source's table. Returns (columns, tables).
    """
    have = columns.select(MODEL, "table_name", "column_name").distinct()
    inside = tables.select(MODEL, "table_name").distinct()
    b = bins.select(MODEL, "table_name", "source_column", "bin_table", "bin_column").distinct()
    source_in = b.join(
        have.withColumnRenamed("column_name", "source_column"), [MODEL, "table_name", "source_column"], "left_semi"
    ).join(inside, [MODEL, "table_name"], "left_semi")
    bin_keys = have.withColumnRenamed("table_name", "bin_table").withColumnRenamed("column_name", "bin_column")
    bin_tables = inside.withColumnRenamed("table_name", "bin_table")
    add_bins = source_in.join(bin_tables, [MODEL, "bin_table"], "left_semi").select(
        MODEL, F.col("bin_table").alias("table_name"), F.col("bin_column").alias("column_name")
    )
    add_sources = (
        b.join(bin_keys, [MODEL, "bin_table", "bin_column"], "left_semi")
        .join(bin_tables, [MODEL, "bin_table"], "left_semi")
        .select(MODEL, "table_name", F.col("source_column").alias("column_name"))
    )
    all_columns = have.unionByName(add_bins).unionByName(add_sources).distinct()
    all_tables = inside.unionByName(add_sources.select(MODEL, "table_name")).distinct()
    return all_columns, all_tables


def relationships_between(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Relationships with both ends among ``tables``."""
    inside = tables.select(MODEL, "table_name").distinct()
    return edges.join(inside.withColumnRenamed("table_name", "from_table"), [MODEL, "from_table"], "left_semi").join(
        inside.withColumnRenamed("table_name", "to_table"), [MODEL, "to_table"], "left_semi"
    )


def relationship_key_columns(edges: DataFrame, keys: Sequence[str] = (MODEL,)) -> DataFrame:
    """Distinct (table, column) ends of relationships."""
    ends = [
        edges.select(*keys, F.col(f"{side}_table").alias("table_name"), F.col(f"{side}_column").alias("column_name"))
        for side in ("from", "to")
    ]
    blank = F.lit("")
    return (
        ends[0]
        .unionByName(ends[1])
        .where((F.coalesce("table_name", blank) != "") & (F.coalesce("column_name", blank) != ""))
        .distinct()
    )
