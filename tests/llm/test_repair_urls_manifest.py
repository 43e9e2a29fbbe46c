"""Conversation repair, URL verdicts and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from modelsieve.llm import conversation_repair as repair
from modelsieve.llm import merkle_manifest as merkle
from modelsieve.llm import url_filter
from modelsieve.llm.rules import URL_RULES

LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest_of_all(initials, faults, insertions=2):
    """Every sequence of edits with at most so many insertions."""
    found = []

    def go(i, out, cost, audit, left):
        if i == len(initials) and LEGAL.fullmatch(out):
            found.append((cost, audit))
        if left:
            for role in "ua":
                go(i, out + role, cost + 5, audit + "I", left - 1)
        if i == len(initials):
            return
        go(i + 1, out, cost + 2, audit + "D", left)
        if faults[i] in ("b", "d"):
            return
        extra = 5 if faults[i] == "t" else 0
        go(i + 1, out + (initials[i] or "?"), cost + extra, audit + "K", left)
        for role in "ua":
            go(i + 1, out + role, cost + extra + 1, audit + "R", left)

    go(0, "", 0, "", insertions)
    return min(found)


def test_search_against_all_edits():
    rnd = random.Random(11)
    for _ in range(300):
        n = rnd.randint(0, 5)
        initials = [rnd.choice(["s", "u", "a", "u", "a", ""]) for _ in range(n)]
        faults = [rnd.choice(["", "", "", "b", "d", "t"]) for _ in range(n)]
        assert repair.cheapest(initials, faults) == cheapest_of_all(initials, faults), (initials, faults)


def test_search_of_a_long_conversation():
    rnd = random.Random(3)
    n = 50_000
    initials = [rnd.choice("suaua") for _ in range(n)]
    faults = [rnd.choice(["", "", "b", "t"]) for _ in range(n)]
    cost, audit = repair.cheapest(initials, faults)
    assert cost == repair.bounds(initials, faults)[repair.NOTHING][0]
    assert len(audit) - audit.count("I") == n


TURNS = "conv_id long, turn long, role string, text string, tie string, copy string, kind string, edit string, place string, cost long"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", 9) for r in rows], TURNS)


def test_repair_of_edge_rows(spark):
    rows = [
        (1, 0, "user", "hello."), (1, 0, "user", "hello."), (1, None, "system", "be kind."), (1, 4, "assistant", "yes"),
        (2, 1, None, None), (2, 2, "", "no role."), (None, 1, "user", "a."), (None, 2, "assistant", "b!"),
        (3, 7, "assistant", "é漢\n" * 50_000 + "."), (4, 1, "tool", "x."), (4, 3, "robot", "y."),
    ]
    frame = turns_frame(spark, rows)
    ordered = repair.ordered_rows(frame)
    found = {r["conv_id"]: r.asDict() for r in repair.report(frame, ordered).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    one = found[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"]) == (3, 0, 1, 1, 1)
    assert (one["cost"], one["audit"]) == (1 + 1 + 2 + 2, "RRDD")
    assert one["repaired_sha256"] == hashlib.sha256(b"user:be kind.\nassistant:hello.").hexdigest()
    assert (found[2]["blank"], found[2]["audit"], found[2]["cost"]) == (1, "DD", 4)
    assert (found[None]["cost"], found[None]["audit"]) == (0, "KK")
    assert (found[3]["audit"], found[3]["cost"]) == ("D", 2) and found[3]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (found[4]["audit"], found[4]["cost"], found[4]["gaps"]) == ("RR", 2, 1)
    decided = repair.decisions(ordered)
    turns = repair.repaired_turns(ordered, decided).where("conv_id = 4").orderBy("place").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in turns] == [("R", "user", "x."), ("R", "assistant", "y.")]
    nothing = frame.limit(0)
    assert repair.report(nothing, repair.damaged(nothing)).collect() == []
    # Damage may leave nothing of a conversation.
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    alone = turns_frame(spark, [(lost, 0, "user", "gone.")])
    only = repair.report(alone, repair.damaged(alone)).first()
    assert tuple(only)[:-1] == (lost, 0, 0, 0, 0, 0, 0, "") and only["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def plain_manifest(rows):
    def hashed(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row, more=0):
        doc_id, source, lang, n, text = row
        values = (doc_id, source, lang, None if n is None else n + more, text)
        return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                proofs[k].append((i % 2, nodes[i ^ 1] if i ^ 1 < len(nodes) else ""))
                at[k] = i // 2
            nodes = [hashed(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        return nodes[0], proofs

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    subs = {x: tree([leaf(r) for r in members[x]]) for x in langs}
    root, top = tree([subs[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for row, proof in zip(members[x], subs[x][1]):
            tampered = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf(row, 1) if tampered else leaf(row)
            for left, sibling in proof + top[k]:
                folded = hashed(*((sibling, folded) if left else (folded, sibling)))
            siblings = [s for _, s in proof + top[k]]
            out.append((row[0], leaf(row), subs[x][0], root, hashed(*siblings), folded, folded == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, level int, leaf string, about string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], DOCS)


def manifest_rows():
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", None]), rnd.choice(["en"] * 9 + ["de", "", None, "漢"]), rnd.choice([None, 0, i, (1 << 63) - 1]), "t" * (i % 5)) for i in range(203)]
    return [*rows, rows[3], (None, "a", "en", 3, None), (None, "a", "en", 3, None), (500, "", "only", 1, "é" * 70_000)]


@pytest.mark.parametrize(("stride", "spread"), [(8, 4096), (2, 3), (1, 1)])
def test_manifest_against_plain_trees(spark, stride, spread):
    rows = manifest_rows()
    found = merkle.verified(docs_frame(spark, rows), stride, spread).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_manifest(rows)
    tampered = {r["doc_id"] for r in found if not r["verified"]}
    assert tampered == {r[0] for r in rows if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}


def test_manifest_of_no_row_and_one(spark):
    frame = docs_frame(spark, manifest_rows()[:1])
    assert [tuple(r) for r in merkle.verified(frame).collect()] == plain_manifest(manifest_rows()[:1])
    assert merkle.verified(frame.limit(0)).collect() == []


def test_linked_rows_are_copied_per_spread_of_leaves(spark):
    """No key of the climb has more rows than a spread of leaves."""
    rows = [(i, "a", "en", i, "t") for i in range(600)]
    nodes, _, _ = merkle.manifest(docs_frame(spark, rows), 2)
    upper = nodes.where("level > 0").selectExpr("tree", "level", "pos", "(leaves - 1) div 10 + 1 as copies", "leaves")
    assert upper.where("leaves > copies * 10").isEmpty() and upper.agg(F.max("copies")).first()[0] == 26


URLS = [
    "http://A.b@Example.ORG:80/en/12?x", "x://", None, "foo", "http://example.org", "HTTP://example.org/en/1", "http://xexample.org/es/",
    "http://y.com/fr/..%2f%ag%e9/?b=1&utm_a=2&a=3#f", "http://Y.com:443/fr/..%2F%ag%E9?a=3&b=1", "a\nb://q.com/de/\n?z", "", "http://",
    "http://z.net/" + "long/" * 20_000, "http://z.net/a/?q", "https://Z.net./a?q&utm_source=s#top", "http://com/de/x", "://:///", "http://a.org/es/?u=http://b.com/de/",
]
PAGES = "page_id long, url string, host string, path string, key string, rule string, verdict string, block long, listed string, action string"


def pages_frame(spark, urls):
    rows = [(None if i % 7 == 3 else i // 2, u) for i, u in enumerate(urls)]
    return spark.createDataFrame([(*r, "h", "p", "k", "r", "v", 1, "l", "a") for r in rows], PAGES)


def plain_verdict(url, rules, listed):
    found = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    hit = plain_canonical(url) in listed
    return url, host, path, best and best[0] + best[1], best[2] if best else "block" if hit else "allow", hit


def plain_canonical(url):
    found = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    if not found:
        return "nothing"
    host = re.sub(r"\.?(:80|:443)?$", "", re.sub("^.*@", "", re.sub("[A-Z]", lambda m: m[0].lower(), found[1])), count=1)
    path = re.sub("%[0-9a-fA-F]{2}", lambda m: m[0].upper(), re.sub("/+$", "", found[2]))
    parts = sorted(q for q in (found[3] or "").split("&") if q and not q.startswith("utm_"))
    return host + path + ("?" + "&".join(parts) if parts else "")


@pytest.mark.parametrize("n_listed", [0, 1, 4, len(URLS)])
def test_verdicts_against_each_rule(spark, n_listed):
    pages = pages_frame(spark, URLS + URLS[:3])
    rules = [*URL_RULES, ("example.org", "/en/1", "allow"), ("a.org", "/es", "allow"), ("org", "/es/?", "block")]
    frame = spark.createDataFrame([*rules, (None, "/", "block"), ("Example.org", "/en/", "block")], url_filter.RULE)
    listed = URLS[-n_listed:] if n_listed else []
    found = url_filter.verdicts(pages.withColumn("given", F.col("url")), frame, spark.createDataFrame([(u,) for u in listed], "url string"))
    rules.append(("example.org", "/en/", "block"))
    keys = {plain_canonical(u) for u in listed} - {"nothing"}
    expected = [plain_verdict(u, rules, keys)[1:] for u in URLS + URLS[:3]]
    assert sorted((tuple(r)[1:] for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert found.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]


def test_verdicts_of_empty_tables(spark):
    pages = pages_frame(spark, URLS)
    rules, urls = spark.createDataFrame([], url_filter.RULE), spark.createDataFrame([], "url string")
    assert {r["verdict"] for r in url_filter.verdicts(pages, rules, urls).collect()} == {"allow"}
    assert url_filter.verdicts(pages.limit(0), rules, urls).collect() == []


def test_filter_holds_all_keys_and_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    held, blocks = url_filter.bloom(keys, 5000)
    assert url_filter.possible(keys, held, blocks).count() == 5000
    others = spark.range(20_000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("key"))
    assert url_filter.possible(others, held, blocks).count() < 200
