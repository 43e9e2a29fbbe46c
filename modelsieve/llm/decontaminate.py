"""Benchmark passages in documents, by SimHash over item-sized windows.

A benchmark item of n five-word shingles is compared with the windows of n shingles of every
document. The 64-bit SimHash of a window (each shingle votes with its number of occurrences) is
looked up in a multi-index of the item fingerprints: two fingerprints within RADIUS bits differ by
at most RADIUS // BLOCKS bits in at least one of BLOCKS equal blocks, so looking up every block
with that many bits changed finds all of them. Each candidate is then verified by the weighted
Jaccard similarity of the two shingle multisets, sum of the smaller over sum of the larger counts.

Which windows are fingerprinted: with a similarity of s, a window shares at least 2ns / (1 + s) of
its n shingles with the item. Windows that hold fewer shingles of items of their size cannot pass
and are left out before the fingerprints; no other window is left out. RADIUS is wide for s = 0.8
(expected distance 10 bits, standard deviation 3); windows at or near equality lie within a few bits.

A document with fewer shingles than the item has one window, its whole list, if it holds enough of
them: s times the size of the item at least, since no smaller text reaches the similarity.

Only DataFrame functions are used. Shingles are compared by 64-bit hashes of their words: a window
passes by collisions only if most of its shingles collide.

Defined cases: a null or empty text has no window and is clean. An item with fewer than five words has no shingle and is not searched. An item without an id is
named by its text. Equal items match together. Rows with one id and different texts are reported together under
that id, and repeated rows each keep their row. A null id is reported like any other id. Only
the id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.llm.common import bound, text_of, words_of, written

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
BLOCKS = 4
RADIUS = 15
#: Lowest bit of each of the four 16-bit lanes of a long.
LANES = 0x0001000100010001


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, in text order."""

    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<bigint>"))

    return bound(words, hashes)


def simhash(shingles: Column) -> Column:
    """Majority bit of the hashes at each position; equal votes give 0.

    Votes for every sixteenth bit are added at once, in the four 16-bit lanes of a long.
    """
    n = F.size(shingles)

    def votes_from(low: int) -> Column:
        return F.aggregate(
            shingles,
            F.lit(0).cast("bigint"),
            lambda total, h: total + F.shiftrightunsigned(h, low).bitwiseAND(F.lit(LANES)),
        )

    votes = F.array(*(votes_from(low) for low in range(16)))

    def majority(vote: Column, low: Column) -> Column:
        bits = F.lit(0).cast("bigint")
        for lane in range(4):
            of_lane = F.shiftrightunsigned(vote, 16 * lane).bitwiseAND(F.lit(0xFFFF))
            bits = bits.bitwiseOR(F.shiftleft((of_lane * 2 > n).cast("bigint"), 16 * lane))
        return F.call_function("shiftleft", bits, low)

    return F.aggregate(F.transform(votes, majority), F.lit(0).cast("bigint"), lambda all_, some: all_.bitwiseOR(some))


def _block(fingerprint: Column, number: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fingerprint, number * width).bitwiseAND(F.lit((1 << width) - 1))


def needed_shingles(n: Column, similarity: float) -> Column:
    return F.ceil(n * F.lit(2 * similarity / (1 + similarity)) - F.lit(1e-9)).cast("int")


def fewest_shingles(n: Column, similarity: float) -> Column:
    """Shingles of the smallest text that can be similar to an item of ``n``."""
    return F.ceil(n * F.lit(similarity) - F.lit(1e-9)).cast("int")


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Item id, its shingle hashes, their number ``n`` and the fingerprint; a written table."""
    unnamed = F.concat(F.lit("unnamed-"), F.hex(F.xxhash64(text_of(text_col))))
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), unnamed).alias("item"),
        shingle_hashes(words_of(text_of(text_col))).alias("shingles"),
    )
    items = items.withColumn("n", F.size("shingles")).where("n > 0")
    return written(items.withColumn("print", simhash(F.col("shingles"))), "benchmark-items")


def windows(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Item-sized windows, and whole shorter texts, that hold enough shingles of items of their size.

    ``n`` is the size of the items. ``docs`` has ``id`` and ``body``. Returns ``id``, ``text_key``, ``start`` (word number from 1),
    ``n`` and the window's ``shingles``.
    """
    keyed = docs.select("id", "body", F.xxhash64("body").alias("text_key"))
    known = written(items.select(F.explode("shingles").alias("shingle"), "n").distinct(), "benchmark-shingles")
    hits = (
        keyed.select("id", "text_key", F.posexplode(shingle_hashes(words_of(F.col("body")))).alias("at", "shingle"))
        .join(known, "shingle")
        .groupBy("id", "text_key", "n")
        .agg(F.array_sort(F.collect_set(F.col("at") + 1)).alias("at"))
        .withColumn("need", needed_shingles(F.col("n"), similarity))
        .withColumn("fewest", fewest_shingles(F.col("n"), similarity))
        # A text with fewer shingles than the item has no hit beyond its end.
        .where("size(at) >= need or (size(at) >= fewest and element_at(at, -1) < n)")
    )
    # The i-th to the (i + need - 1)-th hit lie in a window that starts after the hit before the
    # i-th and reaches the last of them.
    ranges = F.transform(
        F.sequence(F.lit(1), F.size("at") - F.col("need") + 1),
        lambda i: F.struct(
            F.greatest(
                F.lit(1),
                F.when(i > 1, F.element_at("at", F.greatest(i - 1, F.lit(1))) + 1).otherwise(F.lit(1)),
                F.element_at("at", i + F.col("need") - 1) - F.col("n") + 1,
            ).alias("first"),
            F.element_at("at", i).alias("last"),
        ),
    )
    starts = F.flatten(
        F.transform(F.filter(ranges, lambda r: r["first"] <= r["last"]), lambda r: F.sequence(r["first"], r["last"]))
    )
    starts = F.when(F.size("at") >= F.col("need"), starts).otherwise(F.array().cast("array<int>"))
    per_text = (
        hits.select("id", "text_key", F.struct("n", starts.alias("starts"), "fewest").alias("size"))
        .groupBy("id", "text_key")
        .agg(F.collect_list("size").alias("sizes"))
        .withColumnsRenamed({"id": "hit_id", "text_key": "hit_key"})
    )
    # One row per text: copies of a row give the same windows.
    texts = keyed.join(
        per_text, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    ).select("id", "text_key", shingle_hashes(words_of(F.col("body"))).alias("all"), F.explode("sizes").alias("size"))
    shorter = F.size("all") < F.col("size.n")
    at = F.when(shorter, F.array(F.lit(1))).otherwise(F.col("size.starts"))
    fits = (F.col("start") + F.col("n") - 1 <= F.size("all")) | F.size("all").between(F.col("fewest"), F.col("n") - 1)
    return (
        texts.select("id", "text_key", "all", F.col("size.n").alias("n"), F.col("size.fewest").alias("fewest"), F.explode(at).alias("start"))
        .where(fits)
        .select("id", "text_key", "start", "n", F.slice("all", F.col("start"), F.col("n")).alias("shingles"))
    )


def candidates(found: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Windows and items of one size whose fingerprints differ in at most ``radius`` bits."""
    width = BITS // BLOCKS
    near = radius // BLOCKS
    changes = F.lit([m for m in range(1 << width) if m.bit_count() <= near])
    index = (
        items.select("item", "n", F.col("print").alias("item_print"), F.explode(_blocks("print")).alias("b"))
        .select("item", "n", "item_print", "b.block", "b.key", F.explode(changes).alias("change"))
        .select("item", "n", "item_print", "block", F.col("key").bitwiseXOR(F.col("change")).alias("key"))
    )
    # A written table has its true size, by which the join is planned.
    index = written(index, "benchmark-index")
    probes = found.withColumn("print", simhash(F.col("shingles"))).select(
        "*", F.explode(_blocks("print")).alias("b")
    )
    probes = probes.select("id", "text_key", "start", "n", "shingles", "print", "b.block", "b.key")
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    earlier = F.lit(False)
    for number in range(BLOCKS - 1):
        earlier = earlier | ((F.col("block") > number) & (F.bit_count(_block(differ, number)) <= near))
    # A pair that agrees in several blocks is taken from the first of them.
    return (
        probes.join(index, ["n", "block", "key"])
        .where((F.bit_count(differ) <= radius) & ~earlier)
        .select("id", "text_key", "start", "n", "shingles", "item")
    )


def _blocks(fingerprint: str) -> Column:
    return F.array(
        *(
            F.struct(F.lit(b).alias("block"), _block(F.col(fingerprint), b).cast("int").alias("key"))
            for b in range(BLOCKS)
        )
    )


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two non-empty shingle arrays, by numbers of occurrences."""

    def times(array: Column, value: Column) -> Column:
        return F.size(F.filter(array, lambda x: x == value))

    shared = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda total, x: total + F.least(times(a, x), times(b, x))
    )
    return shared / (F.size(a) + F.size(b) - shared)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """Verified windows: id, ``text_key``, ``item``, first word ``start``, ``n_words``, ``similarity``."""
    items = benchmark_items(benchmark)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    near = candidates(windows(base, items, similarity), items, radius)
    own = items.select("item", F.col("shingles").alias("item_shingles"), F.col("n").alias("item_n"))
    return (
        near.join(own, "item")
        .withColumn("similarity", weighted_similarity(F.col("shingles"), F.col("item_shingles")))
        .where(F.col("similarity") >= similarity)
        .select("id", "text_key", "item", "start", (F.size("shingles") + SHINGLE - 1).alias("n_words"), "similarity")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, ``contaminated``, ``n_items``, ``max_similarity`` (0 if clean)."""
    found = (
        matches(docs, benchmark, id_col, **options)
        .groupBy("id", "item")
        .agg(F.max("similarity").alias("similarity"))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("n_items"), F.max("similarity").alias("max_similarity"))
        .withColumnRenamed("id", "hit_id")
    )
    return (
        docs.select(F.col(id_col).alias("id"))
        .join(found, F.col("id").eqNullSafe(F.col("hit_id")), "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n_items").isNotNull().alias("contaminated"),
            F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
            F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The documents without any benchmark passage, with all their columns."""
    bad = matches(docs, benchmark, id_col, text_col, **options)
    bad = bad.select(F.col("id").alias("bad"), F.col("text_key").alias("bad_text")).distinct()
    # The row is one column, so that its own columns may have any names.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text"))
    same = F.col("id").eqNullSafe(F.col("bad")) & (F.col("text") == F.col("bad_text"))
    return rows.join(bad, same, "left_anti").select("row.*")


def radius_recall(similarity: float, radius: int = RADIUS) -> float:
    """Share of pairs at ``similarity`` expected within ``radius`` bits, by the angle of their counts."""
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return sum(math.comb(BITS, k) * angle**k * (1 - angle) ** (BITS - k) for k in range(radius + 1))
