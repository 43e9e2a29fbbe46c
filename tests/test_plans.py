from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from modelsieve.operators import extract_model, extract_report
from modelsieve.operators.ranking import running_count
from modelsieve.plans.fixpoint import grow, materialize, scratch_dir
from modelsieve.session import ensure_scratch
from modelsieve.sources.definitions import FILES_DDL, decode_definition_parts


def session(master, folder=None, set_later=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder or default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: set_later),
    )


def test_scratch_folder_comes_from_the_session():
    assert scratch_dir(session("spark://host:7077", "/shared/folder/")) == "/shared/folder"
    assert scratch_dir(session("local[2]", set_later="/set/later")) == "/set/later"
    for master in ("yarn", "local[2]"):
        with pytest.raises(RuntimeError):
            scratch_dir(session(master))
    with pytest.raises(RuntimeError):
        ensure_scratch(session("yarn"))


def test_grow_stops_after_the_rounds_and_on_cycles(spark, rows):
    steps = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)], "a INT, b INT")
    seed = spark.createDataFrame([(0,)], "a INT")

    def step(frontier):
        return frontier.join(steps, "a").select(F.col("b").alias("a"))

    assert grow(seed, step).count() == 12
    limited = grow(seed, step, max_rounds=4)
    assert rows(limited, "a", "round") == [(i, i) for i in range(5)]
    assert grow(seed, step, max_rounds=0).count() == 1


def test_materialized_frames_start_from_files(spark):
    df = materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and len(df.inputFiles()) > 0


def test_running_count_spreads_one_group_over_partitions(spark):
    n = 50_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), "id")
    ranked = running_count(df, ["g"], ["id"], name="r")
    hot = ranked.where("g = 'hot'")
    assert hot.where("r <> id div 3 + 1").count() == 0
    assert ranked.groupBy("g").agg(F.count("*").alias("n"), F.max("r").alias("m")).where("n <> m").count() == 0
    flagged = running_count(df, ["g"], ["id"], flag=F.col("id") % 2 == 0, name="r").where("g = 'hot'")
    assert flagged.agg(F.max("r")).first()[0] == (n + 5) // 6


def test_damaged_files_do_not_stop_a_job(spark):
    bad = ["", "{", "[]", '"text"', "null", '{"name": 5, "position": {"x": "wide"}, "visual": []}', '{"sections": 7}', "\u0000�{"]
    paths = [
        "definition/report.json", "report.json", "definition.pbir", "definition/pages/pages.json", "definition/pages/a/page.json",
        "definition/pages/a/visuals/v/visual.json", "definition/tables/T.tmdl", "definition/relationships.tmdl", "definition/model.tmdl",
    ]
    data = [("w", f"i{i}", f"i{i}", kind, path, text) for i, text in enumerate(bad) for path in paths for kind in ("report", "model")]
    files = spark.createDataFrame(data, FILES_DDL)
    for catalog in (extract_report.extract_report_catalog(files), extract_model.extract_model_catalog(files)):
        for df in catalog.values():
            df.collect()
    parts = spark.createDataFrame(
        [("i", [("p", "***", "InlineBase64"), ("q", "/+8=", "InlineBase64")])],
        "item_id STRING, parts ARRAY<STRUCT<path: STRING, payload: STRING, payloadType: STRING>>",
    ).select("item_id", F.struct("parts").alias("definition"))
    found = decode_definition_parts(parts)
    assert found.where("content is null").count() == 1 and found.count() == 2
