"""DuckDB SQL for conversation repair, URL verdicts and the Merkle manifest."""

from __future__ import annotations

from modelsieve.llm import url_filter
from modelsieve.llm.rules import LISTED_SITES, URL_RULES

#: CRC-32 by bytes; the table follows from the polynomial.
CRC_TABLE = """k AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc)"""


def _crc(ascii_text: str) -> str:
    return f"""xor(list_reduce(list_transform(range(1, length({ascii_text}) + 1), lambda i: ascii(substr({ascii_text}, i, 1))::BIGINT),
        lambda c, b: xor(c >> 8, k.crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""


def repair_sql() -> str:
    """All edits of all conversations, row by row; per state of the dialogue the best (cost, audit) goes on."""
    return rf"""
        WITH RECURSIVE {CRC_TABLE}, base AS (
            SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id, turn, coalesce(role, ' ') AS role,
                   coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
            FROM conversations
        ), hit AS (
            SELECT base.*, {_crc("name")} % 20 AS kind, sha256(length(role) || ':' || role || text) AS tie FROM base, k
        ), d AS (
            SELECT cid, turn, tie, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE kind <> 0)
        ), o AS (
            SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, tie, copy) AS i FROM d
        ), f AS (
            SELECT *, left(role, 1) AS c, CASE
                WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'd'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
                lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) AS pair
            FROM o
        ), counts AS (
            SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                   count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                   count(*) AS n
            FROM f GROUP BY cid
        ), ins(q, q2, times, added) AS (
            VALUES (0, 0, 0, []::VARCHAR[]), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']),
                   (1, 1, 0, []), (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']),
                   (2, 2, 0, []), (2, 3, 1, ['assistant:']), (3, 3, 0, []), (3, 2, 1, ['user:'])
        ), edit(q2, letter, c, q3, price) AS (
            VALUES (0, 'D', NULL, 0, 2), (1, 'D', NULL, 1, 2), (2, 'D', NULL, 2, 2), (3, 'D', NULL, 3, 2),
                   (0, 'R', NULL, 2, 1), (1, 'R', NULL, 2, 1), (2, 'R', NULL, 3, 1), (3, 'R', NULL, 2, 1),
                   (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)
        ), s AS (
            SELECT cid, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS turns FROM counts
            UNION ALL
            SELECT cid, i, q, cost, audit, turns FROM (
                SELECT *, row_number() OVER (PARTITION BY cid, q ORDER BY cost, audit) AS place FROM (
                    SELECT s.cid, f.i, edit.q3 AS q,
                           s.cost + 5 * times + price + CASE WHEN fault = 't' AND letter <> 'D' THEN 5 ELSE 0 END AS cost,
                           s.audit || repeat('I', times) || letter AS audit,
                           CASE letter WHEN 'D' THEN list_concat(s.turns, added)
                                WHEN 'K' THEN list_append(list_concat(s.turns, added), f.role || ':' || f.text)
                                ELSE list_append(list_concat(s.turns, added), CASE WHEN edit.q3 = 3 THEN 'assistant:' ELSE 'user:' END || f.text)
                                END AS turns
                    FROM s JOIN f ON f.cid = s.cid AND f.i = s.i + 1 JOIN ins ON ins.q = s.q JOIN edit ON edit.q2 = ins.q2
                    WHERE (letter = 'D' OR fault NOT IN ('b', 'd')) AND (letter <> 'K' OR edit.c = f.c)
                )
            ) WHERE place = 1
        ), ends AS (
            SELECT s.cid, s.cost + 5 * times AS cost, s.audit || repeat('I', times) AS audit, list_concat(s.turns, added) AS turns,
                   row_number() OVER (PARTITION BY s.cid ORDER BY s.cost + 5 * times, s.audit || repeat('I', times)) AS place
            FROM s JOIN counts ON counts.cid = s.cid AND counts.n = s.i JOIN ins ON ins.q = s.q WHERE ins.q2 IN (0, 3)
        )
        SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT cid, conv_id FROM base) b LEFT JOIN counts USING (cid)
        LEFT JOIN (SELECT * FROM ends WHERE place = 1) e USING (cid)"""


def verdict_sql() -> str:
    """Every URL against every rule, and its canonical form among those of the listed sites."""
    rules = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in URL_RULES)
    sites = "|".join(LISTED_SITES)
    return rf"""
        WITH r(r_host, r_path, action) AS (VALUES {rules}), p AS (
            SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url, contains(coalesce(url, ''), '://') AS has,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                   list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
                             lambda q: q <> '' AND NOT starts_with(q, 'utm_'))) AS parts
            FROM pages
        ), c AS (
            SELECT *, CASE WHEN has THEN regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:80|:443)?$', '') || array_to_string(list_transform(
                   string_split(regexp_replace(path, '/+$', ''), '%'), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^[0-9a-fA-F]{{2}}')
                   THEN upper(left(x, 2)) || substr(x, 3) ELSE x END), '%') || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END
                   END AS canonical
            FROM p
        ), best AS (
            SELECT n, max({{'chars': length(r_host || r_path), 'host': length(r_host), 'action': action, 'rule': r_host || r_path}}) AS b
            FROM c JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n
        ), bad AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\.)({sites})\.'))
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.action, CASE WHEN bad.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
               bad.canonical IS NOT NULL AS listed
        FROM c LEFT JOIN best USING (n) LEFT JOIN bad ON c.canonical = bad.canonical"""


def manifest_sql() -> str:
    """Both kinds of trees level by level, and a climb per leaf, one level at a time."""

    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    def leaf(n_chars: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"

    def tree(name: str, start: str) -> str:
        return f"""{name} AS (
            SELECT t, 0 AS lvl, pos, digest, n FROM {start}
            UNION ALL
            SELECT t, lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1
            GROUP BY t, lvl, pos // 2, n
        )"""

    def climb(name: str, start: str, nodes: str) -> str:
        return f"""{name} AS (
            SELECT rid, t, 0 AS lvl, pos, n, h, proof FROM ({start})
            UNION ALL
            SELECT rid, c.t, c.lvl + 1, c.pos // 2, (c.n + 1) // 2,
                   sha256(CASE WHEN s.digest IS NULL THEN h WHEN c.pos % 2 = 1 THEN s.digest || h ELSE h || s.digest END),
                   proof || coalesce(s.digest, '')
            FROM {name} c LEFT JOIN {nodes} s ON s.t = c.t AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.n > 1
        )"""

    return f"""
        WITH RECURSIVE {CRC_TABLE}, d AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS t, {leaf("n_chars")} AS digest,
                   {leaf("(n_chars::HUGEINT + 1)")} AS changed, n_chars, doc_id::VARCHAR AS name
            FROM documents
        ), l AS (
            SELECT rid, doc_id, t, digest, CASE WHEN n_chars IS NOT NULL AND {_crc("name")} % 7 = 0 THEN changed ELSE digest END AS h,
                   row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n
            FROM d, k
        ), {tree("nodes", "l")}, subs AS (
            SELECT '^' AS t, t AS name, digest, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
        ), {tree("top", "subs")},
        {climb("c", "SELECT rid, t, pos, n, h, '' AS proof FROM l", "nodes")},
        {climb("e", "SELECT rid, subs.t, subs.pos, subs.n, h, proof FROM c JOIN subs ON subs.name = c.t WHERE c.n = 1", "top")}
        SELECT l.doc_id, l.digest AS leaf, subs.digest AS subroot, top.digest AS root, sha256(e.proof) AS proof_sha256,
               e.h AS folded_root, e.h = top.digest AS verified
        FROM l JOIN subs ON subs.name = l.t JOIN e ON e.rid = l.rid AND e.n = 1 JOIN top ON top.n = 1"""


ORACLES: dict[str, str] = {
    "op11_conversation_repair": repair_sql(),
    "op12_url_filter": verdict_sql(),
    "op13_merkle_manifest": manifest_sql(),
}
