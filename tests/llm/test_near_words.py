"""Near duplicates: what is stored of the documents, and the meetings by length."""

import math

import pandas as pd
from pyspark.sql import functions as F

from modelsieve.llm import order_minhash

SKETCHED = "id long, node binary, n int, keys array<bigint>, words binary"


def test_links_need_the_stored_words_alone(spark):
    bodies = [" ".join(f"wörd{i}" for i in range(40)), " ".join(f"wörd{i}" for i in range(39)), "", "one two"]
    bodies += bodies[:2]
    batch = pd.DataFrame({"id": range(6), "node": [b.encode()[:20] + bytes([len(b) % 251]) for b in bodies], "body": bodies})
    (found,) = order_minhash._sketches(iter([batch]))
    assert [order_minhash._unpacked(w) for w in found["words"]] == bodies
    assert found["n"].to_list() == [40, 39, 0, 2, 40, 39]
    rows = [(int(r.id), bytearray(r.node), int(r.n), [int(k) for k in r["keys"]], bytearray(r.words)) for _, r in found.iterrows()]
    pairs = order_minhash.links(spark.createDataFrame(rows, SKETCHED)).collect()
    assert [(bytes(p.a), bytes(p.b)) for p in pairs] == [tuple(sorted((batch.node[0], batch.node[1])))]


def test_meetings_by_length_against_a_plain_evaluation(spark):
    members = [(k, bytes([x]), 90 + 3 * (x % 9)) for k in range(3) for x in range(30) if x % (k + 2)]
    labels = {bytes([x]): bytes([x - x % 5]) for x in range(0, 30, 2)}
    failed = {bytes([x]) for x in range(30) if x % 7}
    verified = [(bytes([0]), b, False) for b in failed] + [(bytes([0]), bytes([7]), True)]
    got = order_minhash._same_lengths(
        spark.createDataFrame(members, "key long, node binary, n int"),
        spark.createDataFrame(verified, "a binary, b binary, linked boolean"),
        spark.createDataFrame(list(labels.items()), "node binary, label binary"),
    )
    joins = got._jdf.queryExecution().optimizedPlan().toString().count("Join")
    buckets: dict = {}
    for key, node, n in members:
        for ratio in order_minhash.LENGTHS:
            for step in (0, 1):
                if node in failed:
                    buckets.setdefault((key, ratio, math.floor(math.log(n) / math.log(ratio)) + step), set()).add(node)
    label = lambda node: labels.get(node, node)
    expected = {(min(b), y) for b in buckets.values() for y in b if label(y) != label(min(b))}
    rows = got.select(F.hex("a"), F.hex("b")).collect()
    assert sorted((bytes.fromhex(a), bytes.fromhex(b)) for a, b in rows) == sorted(expected)
    # Members meet the failed texts and the labels, but a bucket does not meet itself.
    assert joins == 2
