"""Merkle manifest of a table, and the climb that proves each row against its root.

Every row is a leaf. Per language the leaves, by id, are paired level by level up to one subroot; the
subroots are paired likewise up to the root. STRIDE levels are built in one grouping: the nodes that
share a position after STRIDE halvings form a block of at most 2**STRIDE nodes. A block's node rows are
stored; each has the sibling of every level of its block and a link to the row of the node that the
block leads to (the rows that lead to a subroot have its siblings on the way to the root as well). A
recursive query then climbs from every leaf along the links, appends the siblings and folds the (perhaps
tampered) hash of the leaf. A round of the climb moves every leaf once; 24 levels take two rounds.

All leaves of a language pass the same few rows near the top. A linked row is therefore stored once per
SPREAD leaves below it, and each leaf takes the copy of its own number, so that no key of the climb
has more than about SPREAD rows. Positions come from running counts over ranges, not from a window
over a language, which may hold most rows.

Defined cases: nulls in any column are written as ``-`` in the leaf; empty texts have zero bytes. Rows
of equal language and id are ordered by their leaf, repeated rows are leaves of their own; null ids
come first. Tampering adds 1 to ``n_chars`` where 7 divides the CRC-32 of the decimal id; null
``n_chars`` and null ids stay. A single row is its own subroot and root. An empty table gives an empty
result. Only the five columns are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.llm.common import written
from modelsieve.operators.ranking import running_count

#: Levels of the tree in one stored row, and leaves that share one copy of a row.
STRIDE = 12
SPREAD = 4096
#: Name of the tree over the subroots; the trees of languages are named "" (null) or "=" and the language.
TOP = "^"
KEY = ["tree", "level", "pos"]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(*hexes: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*hexes), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, digest, tampered`` of every row; ``tampered`` is null where nothing changes."""
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    more = {**fields, "n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    changed = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        "doc_id",
        _hash(*map(_field, fields.values())).alias("digest"),
        F.when(changed, _hash(*map(_field, more.values()))).alias("tampered"),
    )


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    counted = running_count(rows, ["tree"], order, name="pos")
    return counted.withColumn("pos", F.col("pos") - 1)


def _blocks(nodes: DataFrame, level: int, stride: int) -> DataFrame:
    """One row per block: its nodes in order, and the digests of each level above them.

    ``nodes``: ``tree, pos, height, digest, size, about``; ``height`` is that of the whole tree, ``size``
    the leaves below a node.
    """
    block = nodes.groupBy("tree", "height", F.expr(f"shiftright(pos, {stride})").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "size", "about"))).alias("nodes")
    )
    block = block.withColumn("l0", F.col("nodes.digest"))
    for k in range(stride):
        below = F.col(f"l{k}")
        halves = F.transform(
            F.sequence(F.lit(1), F.size(below), F.lit(2)),
            lambda i: F.unhex(F.sha2(F.concat(*(F.coalesce(_hex(F.get(below, i + d)), F.lit("")) for d in (-1, 0))), 256)),
        )
        block = block.withColumn(f"l{k + 1}", F.when(F.col("height") > level * stride + k, halves).otherwise(below))
    return block.withColumn("size", F.expr("aggregate(nodes.size, 0L, (a, s) -> a + s)"))


def _rows(blocks: DataFrame, level: int, stride: int) -> DataFrame:
    """The node rows of blocks; ``steps`` has the level-by-level siblings, null where a node is alone."""

    def row(node: Column, at: Column) -> Column:
        steps = [
            F.when(
                F.col("height") > level * stride + k,
                F.struct(
                    (F.shiftright(at, k) % 2 == 1).alias("left"),
                    F.get(F.col(f"l{k}"), F.shiftright(at, k).bitwiseXOR(F.lit(1))).alias("digest"),
                ),
            )
            for k in range(stride)
        ]
        return F.struct(
            node["pos"].alias("pos"), node["digest"].alias("digest"), node["size"].alias("leaves"),
            node["about"].alias("about"), F.filter(F.array(*steps), lambda s: s.isNotNull()).alias("steps"),
        )

    up = F.struct(F.col("tree").alias("tree"), F.lit(level + 1).alias("level"), F.col("block").alias("pos"))
    linked = blocks.select(
        "tree",
        F.lit(level).alias("level"),
        F.when(F.col("height") > (level + 1) * stride, up).alias("up"),
        F.col("size").alias("up_leaves"),
        F.transform("nodes", row).alias("nodes"),
    )
    return linked.select("tree", "level", "up", "up_leaves", F.inline("nodes"))


def _grow(nodes: DataFrame, stride: int) -> tuple[DataFrame, DataFrame]:
    """Node rows of all levels, and ``tree, digest, size`` of each tree's last node."""
    level, rows, ends = 0, [], []
    while True:
        blocks = written(_blocks(nodes, level, stride), "manifest-blocks")
        rows.append(_rows(blocks, level, stride))
        over = blocks.select(
            "tree", "height", F.col("block").alias("pos"), F.element_at(f"l{stride}", 1).alias("digest"), "size",
            F.lit(None).cast(nodes.schema["about"].dataType).alias("about"),
        )
        ends.append(over.where(F.col("height") <= (level + 1) * stride).select("tree", "digest", "size"))
        nodes = over.where(F.col("height") > (level + 1) * stride)
        if nodes.isEmpty():
            return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, ends)
        level += 1


def _with_height(nodes: DataFrame) -> DataFrame:
    """Levels above the leaves of each tree: halvings until one node remains."""
    last = nodes.groupBy("tree").agg(F.max("pos").alias("last"))
    height = F.when(F.col("last") > 0, F.length(F.bin("last"))).otherwise(0)
    # Written first, so that its size is known: the nodes are not dealt out by tree, one of which may hold most.
    return nodes.join(written(last.select("tree", height.alias("height")), "manifest-heights"), "tree")


def manifest(docs: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame, str | None]:
    """Node rows with links to their parents' rows; ``tree, digest`` of the subroots; the root in hex.

    Node rows: ``tree, level, pos, digest, about`` (``doc_id`` and ``tampered`` of a leaf), ``steps``,
    ``up`` (the parent's tree, level and position; null at the end of the climb), ``up_leaves``.
    """
    placed = _positions(leaves(docs), ["doc_id", "digest"])
    placed = placed.withColumn("size", F.lit(1).cast("bigint")).withColumn("about", F.struct("doc_id", "tampered"))
    rows, ends = _grow(_with_height(placed), stride)
    ends = written(ends.withColumnRenamed("tree", "name"), "manifest-subroots")
    tops = _positions(ends.withColumn("tree", F.lit(TOP)), ["name"])
    tops = written(_with_height(tops.withColumn("about", F.struct("name"))), "manifest-top")
    top_rows, root = _grow(tops, stride)
    found = root.first()
    # The last rows of a language go on with the steps of its subroot in the tree over the subroots.
    links = top_rows.where("level = 0").select(
        F.col("about.name").alias("tree"), F.col("steps").alias("top"), F.col("up").alias("over"), F.col("up_leaves").alias("over_leaves")
    )
    last = rows.where("up is null").join(links, "tree")
    last = last.withColumns({"steps": F.concat("steps", "top"), "up": F.col("over"), "up_leaves": F.col("over_leaves")})
    nothing = F.lit(None).cast(rows.schema["about"].dataType)
    higher = top_rows.where("level > 0").withColumn("about", nothing)
    nodes = rows.where("up is not null").unionByName(last.drop("top", "over", "over_leaves")).unionByName(higher)
    return written(nodes, "manifest-nodes"), ends, None if found is None else found["digest"].hex()


#: Folds a hash with the siblings of a row, and the siblings without their sides.
FOLD = """aggregate({steps}, {start}, (h, s) -> unhex(sha2(concat(
    if(s.left, coalesce(lower(hex(s.digest)), ''), ''), lower(hex(h)), if(s.left, '', coalesce(lower(hex(s.digest)), ''))), 256)))"""
SIBLINGS = "aggregate({steps}, {start}, (p, s) -> concat(p, coalesce(s.digest, cast('' as binary))))"


def climbs(nodes: DataFrame, spread: int = SPREAD) -> DataFrame:
    """``doc_id, tree, leaf, folded, proof`` of every leaf: the end of its climb along the links."""
    is_leaf = F.col("level") == 0
    copies = F.expr(f"sequence(0L, (leaves - 1) div {spread})")
    upper = nodes.where(~is_leaf).withColumn("copy", F.explode(copies))
    query = f"""
        WITH RECURSIVE climb AS (
            SELECT about.doc_id AS doc_id, tree AS name, pos AS number, digest AS leaf, up,
                   pmod(pos, (up_leaves - 1) div {spread} + 1) AS copy,
                   {FOLD.format(steps="steps", start="coalesce(about.tampered, digest)")} AS folded,
                   {SIBLINGS.format(steps="steps", start="cast('' as binary)")} AS proof
            FROM {{leaf}}
            UNION ALL
            SELECT c.doc_id, c.name, c.number, c.leaf, n.up, pmod(c.number, (n.up_leaves - 1) div {spread} + 1),
                   {FOLD.format(steps="n.steps", start="c.folded")},
                   {SIBLINGS.format(steps="n.steps", start="c.proof")}
            FROM climb c JOIN {{upper}} n
              ON c.up.tree = n.tree AND c.up.level = n.level AND c.up.pos = n.pos AND c.copy = n.copy
        )
        SELECT * FROM climb LIMIT ALL"""
    ended = nodes.sparkSession.sql(query, leaf=nodes.where(is_leaf), upper=upper).where("up is null").select("doc_id", F.col("name").alias("tree"), "leaf", "folded", "proof")
    return written(ended, "manifest-climbs")


def verified(docs: DataFrame, stride: int = STRIDE, spread: int = SPREAD) -> DataFrame:
    """One row per document: its leaf, subroot and root, the hash of its proof, and the climb's verdict."""
    nodes, subroots, root = manifest(docs, stride)
    found = climbs(nodes, spread).join(subroots.select(F.col("name").alias("tree"), "digest"), "tree")
    return found.select(
        "doc_id",
        _hex(F.col("leaf")).alias("leaf"),
        _hex(F.col("digest")).alias("subroot"),
        F.lit(root).cast("string").alias("root"),
        F.sha2(_hex(F.col("proof")), 256).alias("proof_sha256"),
        _hex(F.col("folded")).alias("folded_root"),
        (_hex(F.col("folded")) == F.coalesce(F.lit(root), F.lit(""))).alias("verified"),
    )
