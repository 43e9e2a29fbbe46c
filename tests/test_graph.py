import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from modelsieve.operators import graph
from modelsieve.plans.fixpoint import grow_by_doubling


def frame(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def direct_frame(spark, edges, leaves=()):
    data = [("m", a, "T" + a, "measure", b, "T" + b) for a, b in edges]
    data += [("m", a, "T" + a, "column", c, "X") for a, c in leaves]
    return frame(
        spark,
        data,
        "semantic_model_id STRING, measure_name STRING, measure_table STRING, dependency_type STRING, "
        "referenced_name STRING, referenced_table STRING",
    )


def brute_closure(edges):
    nodes = {a for a, _ in edges}
    result = set()
    for start in nodes:
        seen, todo = set(), [start]
        while todo:
            here = todo.pop()
            for a, b in edges:
                if a == here and b not in seen:
                    seen.add(b)
                    todo.append(b)
        result |= {(start, x) for x in seen}
    return result


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_measure_closure_on_graphs_with_cycles(spark, rows, seed):
    rng = random.Random(seed)
    edges = {(f"a{rng.randrange(12)}", f"a{rng.randrange(12)}") for _ in range(18)}
    found = graph.measure_closure(direct_frame(spark, sorted(edges)))
    assert set(rows(found, "measure_name", "reached")) == brute_closure(edges)


def test_transitive_dependencies_inherit_columns_of_a_cycle(spark, rows):
    direct = direct_frame(spark, [("A", "B"), ("B", "C"), ("C", "A")], [("A", "a"), ("C", "c")])
    found = graph.transitive_dependencies(direct)
    columns = rows(found.where("dependency_type = 'column'"), "measure_name", "referenced_name")
    assert columns == [(m, c) for m in "ABC" for c in "ac"]
    measures = rows(found.where("dependency_type = 'measure'"), "measure_name", "referenced_name", "referenced_table")
    assert measures == [(m, x, "T" + x) for m in "ABC" for x in "ABC"]


def test_table_dependency_graph_has_no_self_edges(spark, rows):
    deps = frame(
        spark,
        [("m", "a", "T", "table", "T", None), ("m", "a", "T", "table", "U", None), ("m", "b", "", "table", "U", None)],
        "semantic_model_id STRING, measure_name STRING, measure_table STRING, dependency_type STRING, "
        "referenced_name STRING, referenced_table STRING",
    )
    assert rows(graph.table_dependency_graph(deps)) == [("m", "T", "U")]


EDGE = (
    "semantic_model_id STRING, relationship_name STRING, from_table STRING, from_column STRING, to_table STRING, "
    "to_column STRING, cardinality STRING, is_active BOOLEAN"
)


def edges_frame(spark, edges):
    data = [("m", f"r{i}", a, "fk", b, "pk", card, i % 4 != 3) for i, (a, b, card) in enumerate(edges)]
    return frame(spark, data, EDGE)


def brute_expand(edges, seeds, depth):
    def follows(card):
        return "many" in (card or "manyToOne").lower()

    found = {t: 0 for t, _ in seeds}
    frontier = list(seeds)
    for level in range(1, depth + 1):
        nxt = []
        for table, direction in frontier:
            for a, b, card in edges:
                if not follows(card):
                    continue
                if direction in ("ManyToOne", "Both") and a == table and b not in found:
                    found[b] = level
                    nxt.append((b, "ManyToOne"))
                if direction in ("OneToMany", "Both") and b == table and a not in found:
                    found[a] = level
                    nxt.append((a, "ManyToOne"))
        frontier = nxt
    return found


@pytest.mark.parametrize("seed,depth", [(1, 1), (2, 2), (3, 3), (4, 10), (5, 0)])
def test_expand_tables(spark, rows, seed, depth):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(14)]
    cards = [None, "manyToOne", "oneToOne", "manyToMany", "oneToMany"]
    edges = [(rng.choice(names), rng.choice(names), rng.choice(cards)) for _ in range(22)]
    seeds = [(names[0], "ManyToOne"), (names[1], "OneToMany"), (names[2], "Both")]
    seed_rows = frame(spark, [("m", t, d) for t, d in seeds], "semantic_model_id STRING, table_name STRING, direction STRING")
    found = graph.expand_tables(edges_frame(spark, edges), seed_rows, max_depth=depth)
    assert dict(rows(found, "table_name", "depth")) == brute_expand(edges, seeds, depth)


def test_expand_leaves_out_missing_seeds_and_can_skip_inactive_edges(spark, rows):
    edges = edges_frame(spark, [("F", "A", None), ("F", "B", None), ("A", "C", None), ("F", "D", None)])
    seeds = frame(
        spark,
        [("m", "F", "ManyToOne"), ("m", "Ghost", "ManyToOne")],
        "semantic_model_id STRING, table_name STRING, direction STRING",
    )
    tables = frame(spark, [("m", t) for t in "FABCD"], "semantic_model_id STRING, table_name STRING")
    assert rows(graph.missing_seeds(seeds, tables), "table_name") == [("Ghost",)]
    found = graph.expand_tables(edges, seeds, tables=tables)
    assert dict(rows(found, "table_name", "depth")) == {"F": 0, "A": 1, "B": 1, "D": 1, "C": 2}
    active = graph.expand_tables(edges, seeds, tables=tables, active_only=True)
    assert {t for (t,) in rows(active, "table_name")} == {"F", "A", "B", "C"}


def test_neighbours(spark, rows):
    edges = edges_frame(spark, [("F", "A", None), ("B", "F", None), ("F", "A", None)])
    assert rows(graph.neighbours(edges, "F"), "neighbour") == [("A",), ("B",)]
    assert graph.neighbours(edges).count() == 4


def test_calculated_tables_close_over_tables_and_columns(spark, rows):
    deps = frame(
        spark,
        [
            ("m", "C1", "table", "C2", None),
            ("m", "C2", "column", "k", "Base"),
            ("m", "C2", "measure", "M", None),
            ("m", "C9", "table", "Far", None),
            ("m", "Base", "table", "C1", None),
        ],
        "semantic_model_id STRING, calculated_table_name STRING, dependency_type STRING, referenced_name STRING, referenced_table STRING",
    )
    start = frame(spark, [("m", "C1")], "semantic_model_id STRING, table_name STRING")
    tables, columns = graph.close_calculated_tables(start, deps)
    assert rows(tables, "table_name") == [("Base",), ("C1",), ("C2",)]
    assert rows(columns, "table_name", "column_name") == [("Base", "k")]


def test_sort_by_needs_an_existing_column_and_follows_whole_chains(spark, rows):
    model = frame(
        spark,
        [("m", "T", f"c{i}", f"c{i + 1}") for i in range(15)] + [("m", "T", "x", "gone")],
        "semantic_model_id STRING, table_name STRING, column_name STRING, sort_by_column STRING",
    )
    start = frame(spark, [("m", "T", "c0"), ("m", "T", "x")], "semantic_model_id STRING, table_name STRING, column_name STRING")
    found = {c for (c,) in rows(graph.close_sort_by(start, model), "column_name")}
    assert found == {"x"} | {f"c{i}" for i in range(15)}
    found = {c for (c,) in rows(graph.close_sort_by(start, model, max_rounds=3), "column_name")}
    assert found == {"x"} | {f"c{i}" for i in range(4)}


def test_reachable_measures_end_on_cycles(spark, rows):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("c", "d")]
    start = frame(spark, [("m", "a")], "semantic_model_id STRING, measure_name STRING")
    assert rows(graph.reachable_measures(direct_frame(spark, edges), start), "measure_name") == [("a",), ("b",), ("c",), ("d",)]


def test_bins_pair_in_both_directions(spark, rows):
    bins = frame(
        spark,
        [("m", "T", "a", "T", "a bins"), ("m", "T", "b", "U", "b bins"), ("m", "V", "c", "T", "c bins")],
        "semantic_model_id STRING, table_name STRING, source_column STRING, bin_table STRING, bin_column STRING",
    )
    tables = frame(spark, [("m", "T")], "semantic_model_id STRING, table_name STRING")
    columns = frame(
        spark, [("m", "T", "a"), ("m", "T", "b"), ("m", "T", "c bins")], "semantic_model_id STRING, table_name STRING, column_name STRING"
    )
    new_columns, new_tables = graph.pair_bins(columns, tables, bins)
    assert set(rows(new_columns, "table_name", "column_name")) == {
        ("T", "a"), ("T", "a bins"), ("T", "b"), ("T", "c bins"), ("V", "c"),
    }
    assert rows(new_tables, "table_name") == [("T",), ("V",)]


def test_relationships_between_and_their_columns(spark, rows):
    edges = edges_frame(spark, [("F", "A", None), ("F", "B", None)])
    tables = frame(spark, [("m", "F"), ("m", "A")], "semantic_model_id STRING, table_name STRING")
    kept = graph.relationships_between(edges, tables)
    assert rows(kept, "from_table", "to_table") == [("F", "A")]
    assert rows(graph.relationship_key_columns(kept), "table_name", "column_name") == [("A", "pk"), ("F", "fk")]


def steps_of(edges):
    """Length of the shortest way, by breadth-first search."""
    found = {}
    for start in {a for a, _ in edges}:
        level, n = {start}, 0
        while level:
            n += 1
            level = {b for a, b in edges if a in level and (start, b) not in found}
            found.update({(start, b): n for b in level})
    return found


@pytest.mark.parametrize("seed", [4, 5])
def test_doubling_gives_the_smallest_number_of_steps(spark, rows, seed):
    rng = random.Random(seed)
    edges = {(f"a{rng.randrange(30)}", f"a{rng.randrange(30)}") for _ in range(36)}
    edges |= {(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)}
    found = graph.measure_closure(direct_frame(spark, sorted(edges)))
    assert {(a, b): n for a, b, n in rows(found, "measure_name", "reached", "steps")} == steps_of(edges)


def test_a_chain_of_a_thousand_takes_few_rounds(spark, tmp_path):
    edges = spark.range(999).selectExpr("'m' as g", "concat('n', id) as a", "concat('n', id + 1) as b")
    before = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("chain-*"))
    found = grow_by_doubling(edges, ["g"], ["a"], ["b"], label="chain")
    assert found.count() == 999 * 1000 // 2 and found.agg({"steps": "max"}).first()[0] == 999
    (folder,) = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("chain-*")) - before
    assert len(list(folder.glob("round=*"))) <= 12


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_maintained_dependencies_equal_a_rebuild(spark, rows, seed):
    rng = random.Random(seed)

    def state(edges, leaves):
        one = direct_frame(spark, sorted(edges), sorted(leaves))
        return one.unionByName(one.where("measure_name < 'a3'").withColumn("semantic_model_id", F.lit("other")))

    def name():
        return f"a{rng.randrange(9)}"

    edges = {(name(), name()) for _ in range(9)} | {("x", "y"), ("y", "z"), ("z", "x")}
    leaves = {(name(), f"col{rng.randrange(4)}") for _ in range(8)} | {("z", "deep")}
    after_edges = {e for e in edges if rng.random() < 0.7 and e != ("y", "z")} | {(name(), name()) for _ in range(3)}
    after_leaves = {x for x in leaves if rng.random() < 0.8} | {("new", "fresh")}
    before, after = state(edges, leaves), state(after_edges | {("new", "a1")}, after_leaves)
    columns = before.columns
    kept = graph.maintain_dependencies(graph.transitive_dependencies(before), before, after)
    assert rows(kept, *columns) == rows(graph.transitive_dependencies(after), *columns)
    same = graph.maintain_dependencies(graph.transitive_dependencies(before), before, before)
    assert rows(same, *columns) == rows(graph.transitive_dependencies(before), *columns)


def test_only_measures_that_reach_a_change_are_derived_again(spark, rows):
    before = direct_frame(spark, [("a", "b"), ("b", "c"), ("d", "c"), ("e", "d")], [("c", "x")])
    after = direct_frame(spark, [("a", "b"), ("b", "q"), ("d", "c"), ("e", "d")], [("c", "x")])
    assert rows(graph.changed_measures(before, after), "measure_name") == [("b",)]
    # Rows that nothing affects are taken over, not derived: a mark on them is still there.
    closed = graph.transitive_dependencies(before)
    marked = closed.withColumn("referenced_table", F.when(F.col("measure_name") == "e", "mark").otherwise(F.col("referenced_table")))
    found = graph.maintain_dependencies(marked, before, after)
    assert {t for (t,) in rows(found.where("measure_name = 'e'"), "referenced_table")} == {"mark"}
    assert rows(found.where("measure_name = 'a'"), "dependency_type", "referenced_name") == [("measure", "b"), ("measure", "q")]
