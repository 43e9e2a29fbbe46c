"""Near duplicates: marks that spare alignments, and what pivots with many texts bring together."""

import random

import numpy as np

from modelsieve.llm import order_minhash


def edited(rng, words, edits):
    """A text and an upper bound of its distance."""
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words.insert(at, f"w{rng.randrange(30)}")
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words[at] = f"w{rng.randrange(30)}"
    return words


def test_marks_never_rule_out_similar_texts(spark):
    rng, rows, similar = random.Random(3), [], 0
    for _ in range(400):
        one = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 120))]
        two = edited(rng, one, rng.randrange(0, 2 + len(one) // 3)) if rng.random() < 0.8 else [f"z{i}" for i in range(40)]
        (x, y), hashes = order_minhash._numbered([" ".join(one), " ".join(two)])
        most = order_minhash.allowed_edits(max(len(x), len(y)), 0.8)
        near = order_minhash.edit_distance(x, y, most) is not None
        rows.append((len(x), len(y), near, [int(v) for v in order_minhash._marks(hashes[x])], [int(v) for v in order_minhash._marks(hashes[y])]))
    frame = spark.createDataFrame(rows, "n int, m int, near boolean, a array<bigint>, b array<bigint>")
    got = frame.select("near", order_minhash._may_be_similar("a", "b", "n", "m", 0.8).alias("may")).collect()
    assert all(r.may for r in got if r.near)
    assert sum(r.near for r in got) > 50 and sum(not r.may for r in got) > 50


def test_a_pivot_with_many_texts_pairs_only_those_that_may_be_similar(spark):
    """Texts on both sides of the bound to one pivot, with edits of their own: none is similar to another."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    texts = {}
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(200), 30 if i < 30 else 44):
            words[at] = f"t{i}w{at}"
        texts[i] = words
    words = {bytes([i]): order_minhash._numbered([" ".join(w)]) for i, w in texts.items()}
    rows = []
    for node, ((numbers,), hashes) in words.items():
        marks = [int(v) for v in order_minhash._marks(hashes[numbers])]
        d = 30 if node[0] < 30 else 44
        rows.append((b"p", node, 200, 200, d, marks, d == 30))
    verified = spark.createDataFrame(rows, "a binary, b binary, n_a int, n_b int, distance int, marks array<bigint>, linked boolean")
    labels = spark.createDataFrame([(b"p", b"p"), *((bytes([i]), b"p") for i in range(30))], "node binary, label binary")
    pairs = order_minhash._close_calls(verified, labels, 0.8).collect()
    for p in pairs:
        x, y = texts[p.a[0]], texts[p.b[0]]
        assert sum(u != v for u, v in zip(x, y, strict=True)) <= 50
    assert len(pairs) < 90  # 900 by the distances alone


def test_band_against_a_full_table():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        most = rng.randrange(0, 16)
        expected = row[-1] if row[-1] <= most else None
        assert order_minhash.edit_distance(np.array(a), np.array(b), most) == expected
