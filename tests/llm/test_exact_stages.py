"""The stages that combine equal texts."""

import re

from modelsieve.llm import exact_dedup


def test_exact_groups_combine_salted_groups_in_between(spark, monkeypatch):
    seen = []
    keep = exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda df, label: seen.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    docs = spark.createDataFrame([(i, "a  b" if i % 3 else "a b") for i in range(12)] + [(12, "c")], "doc_id bigint, text string").repartition(4)
    found = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert found == {(i, 0, 12) for i in range(12)} | {(12, 12, 1)}
    # Once by digest, salt and text, once by the digest.
    assert re.search(r"Exchange hashpartitioning\(digest#\d+, salt#\d+, body#\d+", seen[0])
    assert re.search(r"Exchange hashpartitioning\(digest#\d+, \d+\)", seen[0])
