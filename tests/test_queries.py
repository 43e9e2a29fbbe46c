"""Registered queries against their SQL in DuckDB on the smallest test tables.

A selection that covers each family runs by default; ``MODELSIEVE_ALL_QUERIES=1`` runs all.
"""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from modelsieve.plans.oracle import oracles
from modelsieve.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SELECTION = (
    "clean_expression safe_name direct_dependencies calculated_table_dependencies expand_tables usage_by_table model_kpis "
    "unused_summary subset_summary subset_from_seeds merge_pages upsert_catalog stored_catalog extract_columns extract_measures extract_partitions "
    "attribute_blocks extract_model_header inherited_functions document_measure_usage "
    "extract_field_refs extract_filters"
).split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    yield connection
    connection.close()


def comparable(names, found):
    order = [names.index(n) for n in sorted(names)]
    rounded = ([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order] for r in found)
    return sorted(rounded, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracles())
    assert set(oracles()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("MODELSIEVE_ALL_QUERIES") else SELECTION)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    expected = comparable(names, cursor.fetchall())
    assert expected
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == expected
