"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from modelsieve.llm import (
    decontaminate,
    exact_dedup,
    language_id,
    license_scan,
    line_dedup,
    order_minhash,
    packing,
    secret_scan,
    token_count,
    warc_fixity,
)

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, body string, node string, key long, "
    "keep_id long, digest string, label string, n int, at int, gone string, class string, shingles string, start int"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
LONG = " ".join(f"word{i}" for i in range(60_000))
ROWS = [
    (1, WORDS, "en", "a"),
    (1, WORDS, "en", "a"),  # repeated row
    (2, WORDS, "de", "b"),  # tie: same text
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \n\t\n ", None, "b"),
    (6, "!!! ... ???", "en", None),
    (None, "a text without an id of its own", "en", "a"),
    (None, None, None, None),
    (7, LONG, "en", "a"),
    (8, "É́ﬁ 漢字 😀   x", "de", "b"),
    (9, "one two", "de", "b"),
]
BENCHMARK = [(1, "one two three"), (None, WORDS), (3, None), (3, ""), (4, "q w e r t y u i o p"), (5, WORDS)]
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    full = [(*r, len(r[1]) if r[1] is not None else None, 5, "x", "y", 1, 2, "z", "l", 3, 4, "g", "c", "s", 0) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def benchmark(spark, rows=BENCHMARK):
    return spark.createDataFrame(rows, "item_id long, text string")


def operators(spark):
    return {
        "exact": exact_dedup.exact_groups,
        "licences": license_scan.licences,
        "language": lambda d: language_id.identify(d, language_id.fit(d)),
        "near": order_minhash.near_groups,
        "secrets": secret_scan.secrets,
        "lines": line_dedup.line_report,
        "tokens": lambda d: token_count.token_counts(d, BYTE_BPE),
        "contamination": lambda d: decontaminate.contamination(d, benchmark(spark)),
    }


NAMES = ("exact", "licences", "language", "near", "secrets", "lines", "tokens", "contamination")


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_document(spark, docs, name):
    found = operators(spark)[name](docs).collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert operators(spark)[name](empty).collect() == []


def test_exact_ties_and_nulls(docs):
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert {(1, 1, 3, True), (2, 1, 3, False), (3, 3, 3, True), (4, 3, 3, False), (None, 3, 3, False)} <= found
    assert (5, 5, 1, True) in found  # blanks alone are one space, not nothing
    assert (None, None, 1, True) in found
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 5, 6, 7, 8, 9, None], key=str)


def test_near_ties_and_nulls(docs):
    found = {(r["doc_id"], r["class_id"], r["class_size"]) for r in order_minhash.near_groups(docs).collect()}
    assert {(1, 1, 3), (2, 1, 3), (3, 3, 5), (4, 3, 5), (5, 3, 5), (6, 3, 5), (None, 3, 5), (None, None, 1)} <= found
    assert order_minhash.drop_near_duplicates(docs).columns == docs.columns


def test_language_without_letters(spark, docs):
    found = language_id.identify(docs, language_id.fit(docs)).collect()
    for r in found:
        if r["doc_id"] in (3, 4, 5, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled, language_id.fit(unlabelled)).collect()} == {"und"}


def test_contamination_of_edge_items(spark, docs):
    found = {(r["doc_id"], r["contaminated"], r["n_items"]) for r in decontaminate.contamination(docs, benchmark(spark)).collect()}
    assert {(1, True, 2), (2, True, 2), (3, False, 0), (9, False, 0), (7, False, 0)} <= found
    none = decontaminate.contamination(docs, benchmark(spark, [])).collect()
    assert len(none) == len(ROWS) and not any(r["contaminated"] for r in none)


def test_packing(docs, empty):
    found = packing.packed_documents(docs, WORD_BPE).collect()
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    empties = [r for r in found if r["doc_id"] in (3, 4, 5)]
    assert [(r["piece"], r["length"]) for r in empties] == [(0, 1)] * 3
    assert packing.packed_documents(empty, WORD_BPE).collect() == []


def test_line_cleaning_keeps_rows_and_columns(docs, empty):
    cleaned = line_dedup.clean_documents(docs, min_sites=2)
    assert cleaned.columns == docs.columns
    texts = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in cleaned.collect()), key=str)
    expected = [(r[0], "" if r[0] == 2 else r[1], 0 if r[0] == 2 else (None if r[1] is None else len(r[1]))) for r in ROWS]
    assert texts == sorted(expected, key=str)
    assert line_dedup.clean_documents(empty).collect() == []


def test_archive_edges(spark):
    schema = "page_id long, url string, html string, file string, offset long, record string, digest string"
    rows = [(1, "u", "h"), (1, "u", "h"), (2, None, None), (None, None, "x" * 200_000), (3, "", "")]
    pages = spark.createDataFrame([(*r, "f", 1, "r", "d") for r in rows], schema)
    records = warc_fixity.page_records(pages).cache()
    assert records.count() == len(rows)
    assert warc_fixity.audit(records, records).collect() == []
    nothing = records.limit(0)
    assert warc_fixity.audit(nothing, nothing).collect() == []
    lost = warc_fixity.audit(records, nothing).where("level = -1")
    assert {r["status"] for r in lost.collect()} == {"missing"} and lost.count() == len(rows)
    holes = records.withColumn("offset", F.when(F.col("page_id") == 2, None).otherwise(F.col("offset")))
    assert [r["status"] for r in warc_fixity.audit(records, holes).where("level = -1").collect()] == ["missing"]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_edge_rows(spark, docs, empty, tmp_path, stage):
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    _, function = corpus_pipeline.STAGES[stage]
    for table in (docs, empty):
        result = function(spark, table, str(tmp_path))
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns
        result.collect()


TAKEN = (
    "__id __text __digest __keep __keep_node __node __bad __bad_text __gone __key __at __part __flag row keep gone clean body id node text_key "
    "digest bad bad_text gone_id gone_key keep_node text_sha256 kept line at site k1 k2 first"
).split()


@pytest.mark.parametrize("name", ["exact", "near", "contaminated", "lines"])
def test_columns_may_have_the_names_of_helpers(spark, name):
    some = ROWS[:4] if name == "near" else ROWS
    rows = spark.createDataFrame(some, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    named = rows.withColumns({c: F.lit(c) for c in TAKEN})
    clean = {
        "exact": exact_dedup.drop_duplicates,
        "near": order_minhash.drop_near_duplicates,
        "contaminated": lambda d: decontaminate.drop_contaminated(d, benchmark(spark)),
        "lines": lambda d: line_dedup.clean_documents(d, min_sites=2),
    }[name]
    found = clean(named)
    assert found.columns == named.columns
    result = found.collect()
    assert result and all(r[c] == c for r in result for c in TAKEN)
    plain = clean(rows).collect()
    assert sorted((tuple(r)[:5] for r in result), key=repr) == sorted(map(tuple, plain), key=repr)


def test_line_ends_do_not_tell_lines_apart(spark):
    ends = ["", "\r", " ", "\t", "\x0b", "\x0c \r"]
    rows = [(i, f"own line {i}\nthe same everywhere{ends[i % 6]}\n{ends[i % 6]}\nend {i}", None, f"site{i}") for i in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["text"] for r in line_dedup.clean_documents(docs).collect()}
    assert [i for i, text in kept.items() if "everywhere" in text] == [0]
    # Lines of blanks and tabs alone are blank, and stay.
    assert all(kept[i] == f"own line {i}\n{ends[i % 6]}\nend {i}" for i in range(1, 18))


def test_a_long_text_loses_many_lines_in_one_pass(spark):
    lines = [f"common {i}" if i % 2 else f"own {i}" for i in range(40_000)]
    rows = [(0, "\n".join(x for x in lines if x.startswith("common")), "a"), (1, "\n".join(lines), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["text"] for r in line_dedup.clean_documents(docs, min_sites=2).collect()}
    assert kept[1] == "\n".join(x for x in lines if x.startswith("own"))


def test_exact_duplicates_move_each_text_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (4, None), (None, "c")], "doc_id bigint, text string")
    base = docs.select(F.col("doc_id").alias("id"), exact_dedup.normalised(F.coalesce("text", F.lit(""))).alias("body"))
    base = base.withColumn("digest", F.length("body") > 5)
    winners = {salts: exact_dedup._winners(base, salts) for salts in (exact_dedup.SALTS, 3)}
    moves = {salts: w._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for salts, w in winners.items()}
    assert moves == {exact_dedup.SALTS: 1, 3: 2}
    assert len({tuple(sorted(map(tuple, w.collect()))) for w in winners.values()}) == 1
