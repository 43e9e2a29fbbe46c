"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from modelsieve.llm.oracle_climbs import ORACLES as CLIMBS


def _merkle_sql() -> str:
    """Every node of both trees, compared without descending; levels as the longest file needs."""
    ctes = [
        r"""r AS (
            SELECT page_id, 'segment-' || floor(page_id / 500)::BIGINT AS file, 'WARC/1.1' || e || 'WARC-Type: resource' || e
                   || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e
                   || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e
                   || coalesce(html, '') || e || e AS record
            FROM pages, (SELECT chr(13) || chr(10) AS e)
        )""",
        """o AS (
            SELECT page_id, file, record, coalesce(sum(strlen(record)) OVER (
                PARTITION BY file ORDER BY page_id, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
            FROM r
        )""",
        "a AS (SELECT file, pos, sha256(record) AS digest FROM o)",
        """b AS (
            SELECT file, pos + CASE WHEN page_id % 211 = 13 THEN 7 ELSE 0 END AS pos,
                   sha256(CASE WHEN page_id % 211 = 7 THEN 'w' || substr(record, 2) ELSE record END) AS digest
            FROM o WHERE page_id % 211 <> 11
        )""",
        "longest AS (SELECT max(pos) AS pos FROM (SELECT pos FROM a UNION ALL SELECT pos FROM b))",
    ]
    parts = [
        """SELECT file, -1 AS level, pos AS first_offset, NULL::BIGINT AS end_offset, a.digest AS a_digest, b.digest AS b_digest
           FROM a FULL JOIN b USING (file, pos)"""
    ]
    for level in range(6):
        span = 65536 * 16**level
        for side in "ab":
            below = side if level == 0 else f"{side}{level - 1}"
            step = 65536 if level == 0 else 16
            ctes.append(
                f"""{side}{level} AS (
                    SELECT file, pos // {step} AS pos, sha256(string_agg(pos || ':' || digest, ',' ORDER BY pos, digest)) AS digest
                    FROM {below} GROUP BY file, pos // {step}
                )"""
            )
        # A level is part of the trees if the one below does not cover the longest file.
        needed = "TRUE" if level == 0 else f"(SELECT pos FROM longest) >= {span // 16}"
        parts.append(
            f"""SELECT file, {level}, pos * {span}, (pos + 1) * {span}, a{level}.digest, b{level}.digest
                FROM a{level} FULL JOIN b{level} USING (file, pos) WHERE {needed}"""
        )
    union = " UNION ALL ".join(parts)
    return f"""WITH {", ".join(ctes)}
        SELECT file, level, first_offset, end_offset,
               CASE WHEN a_digest IS NULL THEN 'extra' WHEN b_digest IS NULL THEN 'missing' ELSE 'differs' END AS status,
               a_digest, b_digest
        FROM ({union}) WHERE a_digest IS DISTINCT FROM b_digest"""


ORACLES: dict[str, str] = {
    **CLIMBS,
    "op6_warc_fixity": _merkle_sql(),
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
        ), g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
               sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body""",
    "op7_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, source, ' ' || chr(9) || chr(11) || chr(12) || chr(13) AS ends, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents
        ), b AS (
            SELECT trim(line, ends) AS line, min({'doc_id': doc_id, 'pos': pos}) AS first FROM l WHERE trim(line, ends) <> ''
            GROUP BY trim(line, ends) HAVING count(DISTINCT coalesce(source, '')) >= 10
        ), m AS (
            SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AND {'doc_id': l.doc_id, 'pos': l.pos} <> b.first AS gone
            FROM l LEFT JOIN b ON trim(l.line, ends) = b.line
        ), d AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest
            FROM m GROUP BY doc_id
        )
        SELECT doc_id, n_lines, n_removed, length(rest) AS n_chars, sha256(rest) AS text_sha256 FROM d""",
    # Every window of the size of an item, and every shorter text as a whole, compared with that item through their shingle texts.
    "op9_decontaminate": r"""
        WITH dw AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
            FROM documents
        ), iw AS (
            SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
            FROM benchmark
        ), ds AS (
            SELECT doc_id, len(w) - 4 AS total, unnest(range(1, len(w) - 3)) AS p,
                   unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
            FROM dw WHERE len(w) >= 5
        ), s AS (
            SELECT item_id, len(w) - 4 AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
            FROM iw WHERE len(w) >= 5
        ), i AS (SELECT item_id, n, s, count(*) AS times FROM s GROUP BY ALL),
        hit AS (SELECT doc_id, total, p, ds.s, item_id, n, times FROM ds JOIN i ON ds.s = i.s),
        win AS (
            SELECT doc_id, item_id, n, s, times, unnest(range(greatest(p - n + 1, 1), least(p, total - n + 1) + 1)) AS start, n AS size
            FROM hit WHERE total >= n
            UNION ALL SELECT doc_id, item_id, n, s, times, 1, total FROM hit WHERE total < n
        ), shared AS (
            SELECT doc_id, item_id, n, size, start, sum(least(found, times)) AS common
            FROM (SELECT doc_id, item_id, n, size, start, s, times, count(*) AS found FROM win GROUP BY ALL) GROUP BY ALL
        ), best AS (
            SELECT doc_id, item_id, max(common / (n + size - common)) AS similarity FROM shared GROUP BY ALL
            HAVING max(common / (n + size - common)) >= 0.8
        ), d AS (SELECT doc_id, count(*) AS n_items, max(similarity) AS max_similarity FROM best GROUP BY doc_id)
        SELECT o.doc_id, d.doc_id IS NOT NULL AS contaminated, coalesce(d.n_items, 0) AS n_items,
               coalesce(d.max_similarity, 0.0) AS max_similarity
        FROM documents o LEFT JOIN d ON o.doc_id = d.doc_id""",
}
