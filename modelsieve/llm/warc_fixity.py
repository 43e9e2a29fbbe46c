"""Fixity audit of web archives by Merkle trees over offset ranges.

An archive is a table of records: file, offset and bytes. The digest of a record is a leaf. The
records that start in one range of RANGE bytes of a file form the lowest inner node; FANOUT
consecutive ranges form a node of the next level, and so on to the root of the file. A node's digest
covers the positions and digests of its children in order, so moved, missing and additional records
change it as well as damaged bytes.

Ranges follow from the offset alone. No task sees more than the records of one range or FANOUT nodes,
whatever the size of a file, and every level is FANOUT times smaller than the one below. An audit
compares the roots of two replicas and goes down only into children of nodes that differ. All files
have as many levels as the longest needs.

Defined cases: an empty replica differs from the other in every file that the other has; two empty
ones are equal. A null record counts as empty bytes. Records at equal file and offset are taken
together, in the order of their digests: a repeated record is part of the range like any other.
Records without file or offset are not part of an archive. Columns other than file, offset and
record are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelsieve.llm.common import written

RANGE = 1 << 16
FANOUT = 16
#: Page ids per segment file.
SEGMENT = 500


def page_records(pages: DataFrame) -> DataFrame:
    """``pages`` as archive records: ``page_id``, ``file``, ``offset``, ``record``.

    A segment holds the pages of SEGMENT consecutive ids in the order of ids. Null fields are
    written empty; pages without an id lie in segments chosen by a hash of their content.
    """
    url, html = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "html"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
        F.lit("\r\n\r\n"),
    )
    number = F.floor(F.col("page_id") / SEGMENT).cast("string")
    file = F.concat(
        F.lit("segment-"), F.coalesce(number, F.concat(F.lit("x"), F.pmod(F.xxhash64(url, html), F.lit(4096)).cast("string")))
    )
    records = pages.select("page_id", file.alias("file"), record.alias("record"))
    before = Window.partitionBy("file").orderBy("page_id", "record").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(F.octet_length("record")).over(before), F.lit(0)))


def leaves(records: DataFrame) -> DataFrame:
    """``file, offset, digest`` of every record; equal positions are combined."""
    each = records.where("file is not null and offset is not null").select(
        "file", "offset", F.sha2(F.coalesce(F.col("record"), F.lit("")), 256).alias("digest")
    )
    return (
        each.groupBy("file", "offset")
        .agg(F.sort_array(F.collect_list("digest")).alias("all"))
        .select("file", "offset", F.array_join("all", "+").alias("digest"))
    )


def _parents(children: DataFrame, place: str, span: int) -> DataFrame:
    """Nodes over the children that share ``place div span``."""
    listed = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "digest"))),
            lambda c: F.concat(c["place"].cast("string"), F.lit(":"), c["digest"]),
        ),
        ",",
    )
    return (
        children.groupBy("file", F.floor(F.col(place) / span).cast("bigint").alias("node"))
        .agg(listed.alias("children"))
        .select("file", "node", F.sha2("children", 256).alias("digest"))
    )


def levels_of(longest: int, range_bytes: int = RANGE, fanout: int = FANOUT) -> int:
    """Levels of nodes until one covers the longest file."""
    levels, covered = 1, range_bytes
    while covered <= longest:
        levels, covered = levels + 1, covered * fanout
    return levels


def tree(leaf: DataFrame, levels: int, range_bytes: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables of nodes, from the lowest ranges to the roots."""
    nodes = [written(_parents(leaf, "offset", range_bytes), "merkle-ranges")]
    for _ in range(levels - 1):
        nodes.append(written(_parents(nodes[-1], "node", fanout), "merkle-level"))
    return nodes


def _differences(a: DataFrame, b: DataFrame, place: str) -> DataFrame:
    """``file, place, a_digest, b_digest`` where the sides differ; null where a side has nothing."""
    left = a.withColumnRenamed("digest", "a_digest")
    right = b.withColumnRenamed("digest", "b_digest")
    return left.join(right, ["file", place], "full").where(~F.col("a_digest").eqNullSafe(F.col("b_digest")))


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """Where two replicas of an archive differ.

    One row per differing node and record: ``file``, ``level`` (-1 for records, 0 for ranges, up to
    the roots), ``first_offset`` and ``end_offset`` of what the node covers (for records, the offset
    and null), ``status`` (``differs``, ``missing`` in ``b``, ``extra`` in ``b``), both digests.
    """
    a_leaf, b_leaf = (written(leaves(side), "merkle-leaves") for side in (a, b))
    longest = a_leaf.select("offset").union(b_leaf.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = levels_of(longest, range_bytes, fanout)
    a_tree, b_tree = (tree(leaf, levels, range_bytes, fanout) for leaf in (a_leaf, b_leaf))
    found = written(_differences(a_tree[-1], b_tree[-1], "node"), "merkle-differences")
    reports = [_report(found, levels - 1, range_bytes * fanout ** (levels - 1))]
    for level in range(levels - 2, -1, -1):
        inside = [_children(side[level], found, "node", fanout) for side in (a_tree, b_tree)]
        found = written(_differences(*inside, "node"), "merkle-differences")
        reports.append(_report(found, level, range_bytes * fanout**level))
    records = _differences(*(_children(side, found, "offset", range_bytes) for side in (a_leaf, b_leaf)), "offset")
    result = records.select("file", F.lit(-1).alias("level"), F.col("offset").alias("first_offset"),
                            F.lit(None).cast("bigint").alias("end_offset"), _status(), "a_digest", "b_digest")
    for report in reports:
        result = result.unionByName(report)
    return result


def _children(nodes: DataFrame, parents: DataFrame, place: str, span: int) -> DataFrame:
    above = parents.select(F.col("file").alias("p_file"), F.col("node").alias("p_node"))
    return nodes.join(
        above, (F.col("file") == F.col("p_file")) & (F.floor(F.col(place) / span).cast("bigint") == F.col("p_node")), "left_semi"
    )


def _status() -> Column:
    return (
        F.when(F.col("a_digest").isNull(), "extra").when(F.col("b_digest").isNull(), "missing").otherwise("differs")
    ).alias("status")


def _report(found: DataFrame, level: int, span: int) -> DataFrame:
    return found.select(
        "file",
        F.lit(level).alias("level"),
        (F.col("node") * F.lit(span)).alias("first_offset"),
        ((F.col("node") + 1) * F.lit(span)).alias("end_offset"),
        _status(),
        "a_digest",
        "b_digest",
    )


def damaged_replica(records: DataFrame) -> DataFrame:
    """A second replica with known damage, decided by the page id.

    Of every 211 ids, one has a changed byte, one is missing, and one lies 7 bytes later.
    """
    case = F.pmod(F.col("page_id"), F.lit(211))
    return records.where(case.isNull() | (case != 11)).select(
        "page_id",
        "file",
        F.when(case == 13, F.col("offset") + 7).otherwise(F.col("offset")).alias("offset"),
        F.when(case == 7, F.concat(F.lit("w"), F.substring("record", 2, 1 << 30))).otherwise(F.col("record")).alias("record"),
    )
