"""Near duplicates by order MinHash, verified by banded alignment.

A text is the sequence of its lower-cased words. Each four-word run is labelled with its occurrence
number, so repeated runs differ. Every one of SKETCHES sketches takes the TUPLE runs with the
smallest hashes under its own seed and keeps them in text order; two texts agree in a sketch if
both the runs and their order are the same. Texts that agree in a sketch form a bucket.

A bucket is never paired out. In rounds,

1. every text of a bucket is aligned with the bucket's pivot (its smallest node), unless the links of
   the first sketches join the two already;
2. texts that only just fail are aligned with those texts similar to the same pivot that the triangle
   inequality of the edit distance and their marks do not exclude, and, in every bucket of theirs, with
   some members of the pivot's class of about their length, which need not have been aligned themselves;
3. texts that are not similar to a pivot leave the runs that they share with it aside, and their
   sketches over the remaining runs form the buckets of the next round. A passage that thousands of
   unrelated documents share thus brings each of them to one alignment per pivot, and similar ones
   among them meet again through the rest of their text. Texts whose runs are all set aside meet
   others of this kind in buckets of longer tuples.

Texts that failed against a pivot also meet again over their whole text, per bucket and class of
lengths: where most of a text is a passage that longer texts hold too, texts of its own length are
similar by that passage alone.

Marks are MARKS bits of a text, each the parity of its labelled words of one hash. An edit changes two
of them at most, so texts whose marks differ in more are not similar. They spare the alignment of pairs that
cannot be similar; no other pair is left out by them. Marks of a bucket's members are compared pair by pair.

Rounds end when every text is similar to its pivots. A pair is similar if its word edit distance is at most
``1 - similarity`` of the longer text; the alignment goes through a band of that width, all diagonals
of a word at once. Linked texts form classes (connected components).

Equal word sequences are one node from the start, so copies are never paired. Nodes are 128-bit
digests. Documents are read once; their words are stored compressed beside the sketches. Other
intermediate tables hold digests and numbers; compressed words are shuffled once, and then only those
of candidates.

Candidate search is probabilistic. Share of pairs with scattered substitutions that share a bucket
(simulated, 150 pairs each): of 300 words, all at 10% and 15%, 0.99 at 18% and 0.97 at 20% edits; of
60 words, all at 10%, 0.99 at 15%, and 0.99 or more up to 20%.

Defined cases: null and empty texts, and texts without letter or digit, have no words and form one
class. Texts of fewer than five words are near duplicates only if their words are equal. The
smallest id of a class stays; a class without any id keeps all its rows under a null ``class_id``.
Rows that repeat id and text are one document. An empty table gives an empty result. Only the id
and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelsieve.llm.common import text_of, written
from modelsieve.llm.components import connected

SHINGLE = 5
#: Words in a run that sketches take. Shorter runs survive more scattered edits.
RUN = 4
SKETCHES = 64
TUPLE = 2
#: Runs in a tuple where texts consist of passages found elsewhere.
LONG_TUPLE = 8
SIMILARITY = 0.8
#: Rows whose words a Python worker holds at a time.
SLICE = 500
#: Sketches compared first; texts that they join need no other alignment between them.
FIRST = 6
#: Ratios of lengths that fall into one class, for texts that failed against a pivot.
LENGTHS = (1.25, 1.09, 1.03)
#: Members of a class that a bucket offers to each text which only just failed against the class.
OFFERED = 4
#: Bits of a text's marks, a multiple of 64. Texts of more words pass the comparison and are aligned.
MARKS = 2048
#: Hash values computed at a time.
BLOCK = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ZSTD = pa.Codec("zstd")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _seeds(sketches: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, sketches + 1, dtype=np.uint64)
    return _mixed(n * _MIX), _mixed(n + np.uint64(1 << 40)) | np.uint64(1)


def _packed(body: str) -> bytes:
    """A text compressed, after its length in bytes."""
    raw = body.encode()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpacked(packed: bytes) -> str:
    return _ZSTD.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True).decode()


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _numbered(bodies: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each text as numbers, and the hash of each number's word."""
    split = pc.split_pattern(pa.array(bodies, pa.large_string()), " ")
    flat = split.flatten().dictionary_encode()
    numbers = flat.indices.to_numpy()
    return np.split(numbers, split.offsets.to_numpy()[1:-1]), _hashes(flat.dictionary.to_pylist())


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch[at : at + SLICE]


def labelled_runs(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` words and its occurrence number, in text order."""
    return _labelled(_hashes(words), size)


def _labelled(h: np.ndarray, size: int) -> np.ndarray:
    """``labelled_runs`` from the hashes of the words."""
    size = min(size, len(h))
    n = len(h) - size + 1
    run = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        run = _mixed(run * _MIX + h[j : j + n])
    order = np.argsort(run, kind="stable")
    same = run[order][1:] == run[order][:-1]
    if same.any():
        starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
        lengths = np.diff(np.append(starts, n))
        number = np.empty(n, dtype=np.uint64)
        number[order] = np.arange(n) - np.repeat(starts, lengths)
        run = _mixed(run + number * np.uint64(0xA0761D6478BD642F))
    return run


def sketch(runs: np.ndarray, sketches: int = SKETCHES, taken: int = TUPLE) -> np.ndarray:
    """One key per sketch: the hash of its smallest labelled runs in text order."""
    xor, odd = _seeds(sketches)
    taken = min(taken, len(runs))
    rows = max(1, BLOCK // len(runs))
    keys = []
    for at in range(0, sketches, rows):
        values = (runs[None, :] ^ xor[at : at + rows, None]) * odd[at : at + rows, None]
        each = np.arange(len(values))
        places = np.empty((len(values), taken), dtype=np.int64)
        for t in range(taken):
            places[:, t] = values.argmin(axis=1)
            values[each, places[:, t]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        places.sort(axis=1)
        key = _mixed(np.arange(at + 1, at + 1 + len(values), dtype=np.uint64))
        for t in range(taken):
            key = _mixed(key * _MIX + runs[places[:, t]])
        keys.append(key)
    return np.concatenate(keys).view(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two integer sequences, or None if it exceeds ``most``.

    Only the diagonals of the band -most..most exist. A column of the band is a number with a bit per diagonal: where
    its cells exceed (``up``) or fall short of (``down``) the cell above by one. What lies outside counts as too dear.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return None
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << (i + most)
    band, last = (1 << (2 * most + 1)) - 1, 1 << (2 * most)
    up, down = band ^ ((1 << most) - 1), 0
    # The diagonal that ends in the last cell: its cells never fall.
    goal, distance = 1 << (n - m + most), n - m
    for j, word in enumerate(b.tolist()):
        equal = (places.get(word, 0) >> j) & band
        kept = ((((equal & up) + up) ^ up) | equal | down) & band
        if not kept & goal:
            distance += 1
            if distance > most:
                return None
        right, left = down | (band & ~(kept | up)), kept & up
        kept >>= 1
        up, down = left | (band & ~(kept | right)) | last, kept & right
    return distance


def allowed_edits(longer: int, similarity: float) -> int:
    return int((1 - similarity) * longer + 1e-9)


def _marks(words: np.ndarray) -> np.ndarray:
    """Parities of the labelled words by hash, as 64-bit numbers."""
    places = _labelled(words, 1) % np.uint64(MARKS)
    odd = np.bincount(places.astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_be_similar(x: str, y: str, n: str, m: str, similarity: float) -> Column:
    """Whether marks ``x, y`` of texts of ``n`` and ``m`` words leave room for the edits allowed.

    A substitution changes two marks; a length that differs needs that many edits, which change one each.
    """
    differ = sum(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(MARKS // 64))
    return differ <= 2 * _allowed(n, m, similarity) - F.abs(F.col(n) - F.col(m))


def _distances(similarity: float, reach: int):
    """Rows ``a, b, a_words, b_words`` (compressed) to ``a, b, n_a, n_b, distance, common, marks``.

    The distance is null beyond ``reach`` times the allowed one. With a reach above 1, ``marks`` are those of ``b``, and
    ``common`` has, for pairs that are not similar, first and last number of each stretch of runs of ``b`` that ``a`` has too.
    """

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            # Rows come sorted by ``a``: its words are unpacked once for those that follow each other.
            new = (batch.a != batch.a.shift()).to_numpy()
            bodies = [_unpacked(w) for w in [*batch.a_words[new], *batch.b_words]]
            numbers, hashes = _numbered(bodies)
            lefts, rights = numbers[: new.sum()], numbers[new.sum() :]
            out, last, left_runs = [], -1, None
            for a, b, at, right in zip(batch.a, batch.b, np.cumsum(new) - 1, rights, strict=True):
                left = lefts[at]
                if last != at:
                    last, left_runs = at, None
                longer = max(len(left), len(right))
                allowed = allowed_edits(longer, similarity)
                most = min(longer, reach * allowed)
                apart = longer - _shared(left, right)
                distance = None if apart > most else edit_distance(left, right, most)
                common = None
                if reach > 1 and (distance is None or distance > allowed):
                    if left_runs is None:
                        left_runs = _labelled(hashes[left], RUN)
                    common = _stretches(np.isin(_labelled(hashes[right], RUN), left_runs))
                out.append((a, b, len(left), len(right), distance, common, _marks(hashes[right]) if reach > 1 else None))
            names = ["a", "b", "n_a", "n_b", "distance", "common", "marks"]
            yield pd.DataFrame(out, columns=names).astype({"distance": "Int32"})

    return align


def _stretches(mask: np.ndarray) -> np.ndarray:
    """First and last place of each run of true values, one after the other."""
    edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.column_stack((np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1)).reshape(-1).astype(np.int32)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common with their numbers of occurrences: a bound for the alignment."""
    size = int(max(a.max(), b.max())) + 1
    if size > 8 * (len(a) + len(b)):
        _, both = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b, size = both[: len(a)], both[len(a) :], int(both.max()) + 1
    return int(np.minimum(np.bincount(a, minlength=size), np.bincount(b, minlength=size)).sum())


_VERIFIED = "a binary, b binary, n_a int, n_b int, distance int, common array<int>, marks array<bigint>"


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, reach: int) -> DataFrame:
    """Pairs of nodes ``a, b`` with word counts, distance, marks and, if not ``linked``, common stretches; a written table."""
    words = pairs.join(texts.select(F.col("node").alias("b"), F.col("words").alias("b_words")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("words").alias("a_words")), "a"
    )
    found = words.select("a", "b", "a_words", "b_words").mapInPandas(_distances(similarity, reach), _VERIFIED)
    linked = F.coalesce(F.col("distance") <= _allowed("n_a", "n_b", similarity), F.lit(False))
    return written(found.withColumn("linked", linked), "omh-verified")


def _allowed(n: str, m: str, similarity: float) -> Column:
    return F.floor(F.lit(1 - similarity) * F.greatest(n, m) + 1e-9)


def words_text(text_col: str) -> Column:
    """Lower-cased words of a text, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text_of(text_col)), r"[^\p{L}\p{N}]+", " "))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ``id, node, body`` to ``id, node, n, keys, words`` (compressed)."""
    for batch in _slices(batches):
        numbers, hashes = _numbered(batch.body.to_list())
        # An empty text has no words.
        numbers = [w if body else w[:0] for w, body in zip(numbers, batch.body, strict=True)]
        keys = [sketch(_labelled(hashes[w], RUN)) if len(w) else np.empty(0, dtype=np.int64) for w in numbers]
        n = np.array([len(w) for w in numbers], dtype=np.int32)
        yield pd.DataFrame(
            {"id": batch.id, "node": batch.node, "n": n, "keys": pd.Series(keys, batch.index), "words": batch.body.map(_packed)}
        )


def _sketches_of_the_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ``node, words, aside`` (stretches of runs) to ``node, keys``."""
    for batch in _slices(batches):
        keys = []
        numbers, hashes = _numbered([_unpacked(w) for w in batch.words])
        for words, aside in zip(numbers, batch.aside, strict=True):
            runs = _labelled(hashes[words], RUN)
            rest = np.ones(len(runs), dtype=bool)
            for first, last in np.asarray(aside).reshape(-1, 2):
                rest[first : last + 1] = False
            if rest.sum() >= TUPLE:
                keys.append(sketch(runs[rest]))
            else:
                keys.append(~sketch(runs, taken=LONG_TUPLE))
        yield pd.DataFrame({"node": batch.node, "keys": pd.Series(keys, batch.index)})


def _star(rows: DataFrame) -> DataFrame:
    """Pairs of each bucket's smallest node ``a`` with its other nodes ``b``; a written table."""
    pivots = rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top").drop("top")
    return written(rows.join(pivots, "key").where("node != a").select("a", F.col("node").alias("b")).distinct(), "omh-star")


def _length_class(n: str, ratio: float) -> Column:
    return F.floor(F.log(F.col(n)) / math.log(ratio))


def _same_lengths(members: DataFrame, verified: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of texts that failed against a pivot, by buckets of one key and class of lengths.

    Each text is in two neighbouring classes of each ratio, so two texts whose lengths differ by no
    more than the ratio share one. The pivot is the smallest node, as in any bucket.
    """
    failed = verified.where("not linked").select(F.col("b").alias("node")).distinct()
    classes = [
        F.struct(F.lit(i).alias("ratio"), (_length_class("n", r) + step).alias("at")) for i, r in enumerate(LENGTHS) for step in (0, 1)
    ]
    rows = (
        members.join(failed, "node")
        .join(labels, "node", "left")
        .select("key", "node", F.coalesce("label", "node").alias("label"), F.inline(F.array(*classes)))
    )
    # Each row meets the first of its bucket and no other, so there are never more pairs than rows.
    bucket = Window.partitionBy("key", "ratio", "at").orderBy("node")
    met = rows.withColumn("pivot", F.first(F.struct("node", "label")).over(bucket)).where("label != pivot.label")
    return met.select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct()


def _of_near_classes(members: DataFrame, verified: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a text that only just failed and members of the class that it failed against.

    OFFERED members per bucket and class of lengths, in orders of their own for each bucket, so the
    buckets of a text offer it different members, those that share most with it most often.
    """
    known = [labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b")]
    grey = verified.where("not linked and distance is not null").select("a", "b")
    grey = grey.join(known[0], "a", "left").join(known[1], "b", "left").where("not a_label <=> b_label")
    wants = (
        grey.select(F.col("b").alias("y"), F.col("a_label").alias("label"))
        .union(grey.select("a", "b_label"))
        .where("label is not null")
        .distinct()
    )
    wants = written(wants, "omh-near-classes")
    ratio = 1 / similarity
    around = F.explode(F.array(*(_length_class("n", ratio) + step for step in (-1, 0, 1)))).alias("length")
    offered = (
        members.join(labels.join(wants.select("label"), "label", "left_semi"), "node")
        .select("key", "label", "node", "n", around)
        .groupBy("key", "label", "length")
        .agg(F.array(*(F.min_by(F.struct("node", "n"), F.xxhash64("node", "key", F.lit(r))) for r in range(OFFERED))).alias("xs"))
        .select("key", "label", "length", F.explode(F.array_distinct("xs")).alias("x"))
    )
    asked = members.join(wants, F.col("node") == F.col("y")).select("key", "y", "label", F.col("n").alias("n_y"), _length_class("n", ratio).alias("length"))
    fits = F.abs(F.col("x.n") - F.col("n_y")) <= _allowed("x.n", "n_y", similarity)
    pairs = asked.join(offered, ["key", "label", "length"]).where(fits)
    return pairs.select(F.least("x.node", "y").alias("a"), F.greatest("x.node", "y").alias("b")).distinct()


def _close_calls(verified: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs with a common pivot, one similar to it and one not, that its distances and their marks do not rule out.

    Pairs that links join already are left out: they are in one class either way.
    """
    near = verified.where("linked").select(
        "a", F.col("b").alias("x"), F.col("n_b").alias("n_x"), F.col("distance").alias("d_x"), F.col("marks").alias("m_x")
    )
    near = near.join(labels.select(F.col("node").alias("a"), F.col("label").alias("l_x")), "a")
    grey = verified.where("not linked and distance is not null").select(
        F.col("a").alias("g"), F.col("b").alias("y"), F.col("n_b").alias("n_y"), F.col("distance").alias("d_y"), F.col("marks").alias("m_y")
    )
    grey = grey.join(labels.select(F.col("node").alias("y"), F.col("label").alias("l_y")), "y", "left")
    allowed = _allowed("n_x", "n_y", similarity)
    apart = F.coalesce(F.col("l_x") != F.col("l_y"), F.lit(True))
    possible = (F.col("d_y") - F.col("d_x") <= allowed) & (F.abs(F.col("n_x") - F.col("n_y")) <= allowed)
    possible &= _may_be_similar("m_x", "m_y", "n_x", "n_y", similarity)
    pairs = near.join(grey, (F.col("a") == F.col("g")) & apart & possible)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _not_ruled_out(pairs: DataFrame, verified: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` without those whose marks tell them apart; texts that were only pivots have no marks."""
    known = written(verified.groupBy(F.col("b").alias("node")).agg(F.first("n_b").alias("n"), F.first("marks").alias("m")), "omh-marks")
    for side in ("a", "b"):
        own = known.select("node", F.col("n").alias(f"n_{side}"), F.col("m").alias(f"m_{side}"))
        pairs = pairs.join(own, F.col(side) == F.col("node"), "left").drop("node")
    return pairs.where(F.coalesce(_may_be_similar("m_a", "m_b", "n_a", "n_b", similarity), F.lit(True))).select("a", "b")


def links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs ``a, b`` of nodes, from the ``node, n, keys, words`` of each document; a written table."""
    worded = nodes.where("n > 0")
    # Copies go before keys come apart, and combine before the shuffle.
    keys = worded.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    rows = keys.select("node", "n", F.posexplode("keys").alias("sketch", "key"))
    shared = rows.withColumn("nodes", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("nodes > 1")
    members = written(shared.select("sketch", "key", "node", "n"), "omh-members")
    words = worded.groupBy("node").agg(F.first("words").alias("words"))
    texts = written(words.join(members.select("node").distinct(), "node", "left_semi"), "omh-texts")
    # Members of a large class meet under many pivots. The first sketches join most of them.
    first = _star(members.where(F.col("sketch") < FIRST).select("key", "node"))
    seen = _verified(first, texts, similarity, 2)
    joined = connected(seen.where("linked").select("a", "b"))
    labelled = members.join(joined, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    pivots = (
        labelled.groupBy("key")
        .agg(F.min(F.struct("node", "label")).alias("pivot"), F.min("label").alias("low"), F.max("label").alias("top"))
        .where("low < top")
        .select(F.col("key").alias("p_key"), F.col("pivot.node").alias("a"), F.col("pivot.label").alias("a_label"))
    )
    apart = labelled.join(pivots, (F.col("key") == F.col("p_key")) & (F.col("label") != F.col("a_label")))
    star = apart.select("a", F.col("node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = _verified(star, texts, similarity, 2)
    verified = seen.unionByName(more)
    found, aside = None, None
    while True:
        near = verified.where("linked").select("a", "b")
        labels = connected(near)
        pairs = _close_calls(verified, labels, similarity)
        if aside is None:
            met = _same_lengths(members, verified, labels).union(_of_near_classes(members, verified, labels, similarity))
            pairs = pairs.union(_not_ruled_out(met.distinct(), verified, similarity))
            pairs = pairs.distinct().join(verified, ["a", "b"], "left_anti")
        close = _verified(pairs, texts, similarity, 1).where("linked").select("a", "b")
        found = near.union(close) if found is None else found.union(near).union(close)
        apart = verified.where("not linked").select(F.col("b").alias("node"), "common")
        if apart.isEmpty():
            return written(found.distinct(), "omh-links")
        now = apart.groupBy("node").agg(F.flatten(F.collect_list("common")).alias("now"))
        if aside is not None:
            now = now.join(aside, "node", "left").withColumn("now", F.concat("now", F.coalesce("aside", F.array().cast("array<int>"))))
        aside = written(now.select("node", F.col("now").alias("aside")), "omh-aside")
        # Later rounds read the words of their own texts alone.
        rest = written(texts.join(aside, "node").select("node", "words", "aside"), "omh-texts")
        texts = rest.select("node", "words")
        keys = rest.mapInPandas(_sketches_of_the_rest, "node binary, keys array<bigint>")
        star = _star(written(keys, "omh-rest").select("node", F.explode("keys").alias("key")).distinct())
        if star.isEmpty():
            return written(found.distinct(), "omh-links")
        verified = _verified(star, texts, similarity, 2)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per document: id, ``class_id`` (smallest id of its class), ``class_size``, ``kept``."""
    placed = _placed(docs, id_col, text_col, similarity)
    return placed.select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def _node(body: Column) -> Column:
    return F.unhex(F.md5(body))


def _placed(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """``id, node, class_id, class_size, kept`` of every document."""
    base = docs.select(F.col(id_col).alias("id"), words_text(text_col).alias("body")).withColumn(
        "node", _node(F.col("body"))
    )
    nodes = written(
        base.select("id", "node", "body").mapInPandas(
            _sketches, f"id {_type(docs, id_col)}, node binary, n int, keys array<bigint>, words binary"
        ),
        "omh-sketches",
    )
    labels = connected(links(nodes, similarity))
    placed = written(
        nodes.select("id", "node").join(labels, "node", "left").select("id", "node", F.coalesce("label", "node").alias("class")),
        "omh-classes",
    )
    sizes = placed.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(sizes, "class").select(
        "id", "node", "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One document of each class, with all its columns."""
    keep = _placed(docs, id_col, text_col, similarity).where("kept")
    keep = keep.select(F.col("id").alias("keep"), F.col("node").alias("keep_node")).distinct()
    # The row is one column, so that its own columns may have any names.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), _node(words_text(text_col)).alias("node"))
    same = F.col("id").eqNullSafe(F.col("keep")) & (F.col("node") == F.col("keep_node"))
    return rows.join(keep, same, "left_semi").select("row.*")
