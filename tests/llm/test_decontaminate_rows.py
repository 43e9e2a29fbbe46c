"""Benchmark passages in short texts, and rows that share an id."""

from modelsieve.llm import decontaminate, order_minhash

ITEM = [f"w{i}" for i in range(44)]


def test_texts_shorter_than_the_item_they_copy(spark):
    texts = {
        1: ITEM,
        2: ITEM[:-1],
        3: ITEM[3:-2],
        4: ITEM[:36],
        5: ITEM[:35],  # 31 of 40 shingles: below the similarity
        6: [*ITEM[:20], "x", *ITEM[21:-1]],  # 34 of 39 and 40 shingles
        7: [*ITEM[:-1], "other", "words"],
    }
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(ITEM)), (2, " ".join(f"u{i}" for i in range(30)))], "item_id long, text string")
    got = {r["doc_id"]: r["max_similarity"] for r in decontaminate.contamination(docs, benchmark).collect()}
    expected = {1: 1.0, 2: 39 / 40, 3: 35 / 40, 4: 32 / 40, 5: 0.0, 6: 0.0, 7: 39 / 41}
    assert {i: round(s, 9) for i, s in got.items()} == {i: round(s, 9) for i, s in expected.items()}
    words = {r["id"]: r["n_words"] for r in decontaminate.matches(docs, benchmark).collect() if r["id"] in (2, 3, 4)}
    assert words == {2: 43, 3: 39, 4: 36}


def test_rows_are_dropped_by_id_and_text(spark):
    item = " ".join(ITEM)
    rows = [(None, item), (None, "a clean text without id or passage"), (7, item), (7, "another clean text of the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted([rows[1][1], rows[3][1]])

    alone = "a text of its own that no row with an id repeats"
    rows = [(None, item), (1, item), (2, item), (None, alone), (2, "something else that only row two holds")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = order_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"]) == [(1, item), rows[4]]
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == [alone]
