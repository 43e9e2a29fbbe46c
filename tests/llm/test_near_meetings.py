"""Near duplicates that one round of buckets and pivots does not bring together."""

import random

import pandas as pd

from modelsieve.llm import order_minhash


def classes(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in order_minhash.near_groups(docs).collect()}


def test_near_copies_that_are_mostly_a_passage_of_longer_texts(spark):
    passage = [f"p{i}" for i in range(100)]
    texts = {i: " ".join(passage + [f"a{i}w{j}" for j in range(8 if i < 2 else 30)]) for i in range(250)}
    assert classes(spark, texts) == {i: 0 if i < 2 else i for i in texts}


def test_recall_of_scattered_edits_over_true_pairs():
    rng = random.Random(1)
    for n in (60, 300):
        pairs = []
        for _ in range(100):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            edited = list(words)
            for i in rng.sample(range(n), n // 5):
                edited[i] = f"x{rng.randrange(5000)}"
            pairs += [" ".join(words), " ".join(edited)]
        batch = pd.DataFrame({"id": range(200), "node": [b""] * 200, "body": pairs})
        keys = list(next(order_minhash._sketches(iter([batch])))["keys"])
        assert sum(bool((a == b).any()) for a, b in zip(keys[::2], keys[1::2], strict=True)) >= 90


def test_texts_similar_to_few_members_of_a_class(spark):
    """The copies differ from the last text of their family by 23% of the words, two of them by 18%."""
    rng = random.Random(7)
    texts = {}
    for family in range(10):
        words = [f"f{family}o{i}" for i in range(200)]
        for i in range(63):
            edited = list(words)
            for at in rng.sample(range(200), 32 if i == 62 else 4 if i >= 60 else 14):
                edited[at] = f"f{family}t{i}w{at}"
            texts[100 * family + i] = " ".join(edited)
    got = classes(spark, texts)
    assert all(got[i] == i - i % 100 for i in texts if i % 100 < 62)
    assert sum(got[100 * family + 62] == 100 * family for family in range(10)) >= 7
