"""Equivalent SQL for the registered queries, over the same Parquet tables.

The SQL does not read definition text or JSON back. It states, from the rows that the text was
built from, what the extraction has to find.
"""

from __future__ import annotations

import re

from modelsieve.plans.encodings import STAR, STAR_KEYS, TYPES, star_columns

_TYPES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"


def _type(index: str) -> str:
    return f"({_TYPES})[CAST({index} AS INT) + 1]"


_MODEL = "'sm' || (p_partkey % 25) AS semantic_model_id"
_PARENT = "((p_partkey // 50) * 25 + p_partkey % 25)"

# name → SQL. A CTE may use the ones above it; those in RECURSIVE also use themselves.
CTES: dict[str, str] = {
    "e_measure": f"""
        SELECT {_MODEL}, p_brand AS table_name, 'm' || p_partkey AS measure_name,
          'VAR v_' || p_partkey || ' = SUM(''' || CASE WHEN p_partkey % 2 = 1 THEN upper(p_brand) ELSE p_brand END
          || '''[' || p_type || ']) // old: [m0]' || chr(10) || 'RETURN v_' || p_partkey
          || CASE WHEN p_partkey >= 25 THEN CASE WHEN p_partkey % 4 = 0 THEN ' + [M' ELSE ' + [m' END || {_PARENT} || ']' ELSE '' END
          || CASE WHEN p_partkey % 3 = 0 THEN ' + MAX(Dim_' || p_type || '[Size_' || p_size || '])' ELSE '' END
          || CASE WHEN p_partkey % 7 = 0 THEN ' + COUNTROWS(Dim_' || p_type || ')' ELSE '' END
          || CASE WHEN p_partkey % 13 = 0 THEN ' + COUNTROWS(Calc_' || p_size || ')' ELSE '' END
          || CASE WHEN p_partkey % 11 = 0 THEN ' + [Budget ' || p_size || ']' ELSE '' END
          || ' & "[text]"' || chr(10) || 'lineageTag: ' || p_partkey AS expression,
          CASE WHEN p_partkey % 2 = 0 THEN '0.00' END AS format_string, p_partkey % 9 = 0 AS is_hidden,
          p_partkey, p_type, p_size
        FROM part""",
    "e_model": """
        SELECT 'sm' || n_nationkey AS semantic_model_id, 'w' || (n_nationkey * 3) AS workspace_id,
          n_name || '.SemanticModel' AS name FROM nation""",
    "e_calc": """
        SELECT 'sm' || (p_partkey % 25) AS semantic_model_id, p_size, min(p_type) AS t, min(p_partkey) AS k
        FROM part GROUP BY 1, 2""",
    "e_table": """
        SELECT DISTINCT 'sm' || (p_partkey % 25) AS semantic_model_id, p_brand AS table_name, false AS is_hidden, false AS is_calculated FROM part
        UNION ALL SELECT DISTINCT 'sm' || (p_partkey % 25), 'Dim_' || p_type, p_type = 'SMALL', false FROM part
        UNION ALL SELECT semantic_model_id, 'Calc_' || p_size, false, true FROM e_calc""",
    "e_column": """
        SELECT DISTINCT 'sm' || (p_partkey % 25) AS semantic_model_id, table_name, column_name, data_type, sort_by_column,
          column_name = 'Key' AS is_hidden
        FROM (
          SELECT p_partkey, p_brand AS table_name, p_type AS column_name, 'decimal' AS data_type,
            CASE p_type WHEN 'PROMO' THEN 'SMALL' WHEN 'SMALL' THEN 'Key' END AS sort_by_column FROM part
          UNION ALL SELECT p_partkey, p_brand, 'Key', 'int64', NULL FROM part
          UNION ALL SELECT p_partkey, p_brand, p_type || ' (bins)', 'string', NULL FROM part WHERE p_size > 45
          UNION ALL SELECT p_partkey, 'Dim_' || p_type, 'Size_' || p_size, 'int64', NULL FROM part
          UNION ALL SELECT p_partkey, 'Dim_' || p_type, 'Key', 'int64', NULL FROM part
          UNION ALL SELECT p_partkey, 'Calc_' || p_size, 'Value', 'double', NULL FROM part)""",
    "e_rel": """
        SELECT DISTINCT 'sm' || (p_partkey % 25) AS semantic_model_id, 'rel_' || p_brand || '_' || p_type AS relationship_name,
          p_brand AS from_table, 'Key' AS from_column, 'Dim_' || p_type AS to_table, 'Key' AS to_column,
          CASE p_type WHEN 'LARGE' THEN 'oneToOne' WHEN 'PROMO' THEN 'manyToMany' END AS cardinality,
          p_type <> 'SMALL' AS is_active FROM part""",
    "e_bin": """
        SELECT DISTINCT 'sm' || (p_partkey % 25) AS semantic_model_id, p_brand AS table_name, p_type AS source_column,
          p_brand AS bin_table, p_type || ' (bins)' AS bin_column FROM part WHERE p_size > 45""",
    "e_partition": """
        SELECT 'sm' || (p_partkey % 25) AS semantic_model_id, p_brand AS table_name, 'part-' || p_partkey AS partition_name,
          'm' AS source_type, CASE p_partkey % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'directQuery' WHEN 2 THEN 'dual' END AS mode,
          'let' || chr(10) || '    a = ' || p_partkey || CASE WHEN p_size > 25 THEN chr(10) || 'x' || chr(10) || 'y' || chr(10) || 'z' ELSE '' END
          || chr(10) || 'in' || chr(10) || '    a' AS source_expression, p_partkey, p_size FROM part""",
    "e_workspace": "SELECT 'w' || s_suppkey AS id, s_name AS displayName FROM supplier",
    "e_report": """
        SELECT 'r' || c_custkey AS report_id, n_name AS name, 'w' || (c_custkey % 100) AS workspace_id,
          'sm' || (c_custkey % 30) AS semantic_model_reference
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "e_line": "SELECT lineitem.*, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "e_page": "SELECT DISTINCT 'r' || o_custkey AS report_id, 'p' || l_linenumber AS name, l_linenumber FROM e_line",
    "e_visual": """
        SELECT DISTINCT 'r' || o_custkey AS report_id, 'p' || l_linenumber AS page_name, l_returnflag || l_linestatus AS name,
          CASE l_returnflag WHEN 'R' THEN 'card' WHEN 'A' THEN 'slicer' ELSE 'tableEx' END AS visual_type,
          CAST(l_linenumber * 10 AS DOUBLE) AS x FROM e_line""",
    "e_measure_used": """
        SELECT 'r' || o_custkey AS report_id, 'p' || l_linenumber AS page_name, l_returnflag || l_linestatus AS visual_name,
          p_brand AS table_name, 'm' || p_partkey AS measure_name, count(*) AS usage_count
        FROM e_line JOIN customer ON o_custkey = c_custkey
          JOIN part ON p_partkey = (l_partkey // 50) * 25 + c_nationkey
        GROUP BY 1, 2, 3, 4, 5""",
    "e_event": "SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "e_column_used": f"""
        SELECT 'r' || user_id AS report_id, event_type AS page_name, 'v' || (event_id % 7) AS visual_name,
          'Brand#' || (k % 25 + 1) AS table_name, {_type('k % 6')} AS column_name, count(*) AS usage_count
        FROM e_event GROUP BY 1, 2, 3, 4, 5""",
    "e_usage": """
        SELECT report_id, page_name, visual_name, 'column' AS kind, table_name, column_name AS field, usage_count FROM e_column_used
        UNION ALL SELECT report_id, page_name, visual_name, 'measure', table_name, measure_name, usage_count FROM e_measure_used""",
    "e_filter": f"""
        SELECT 'r' || o_custkey AS report_id, 'Dim_' || {_type('o_orderkey % 6')} AS table_name,
          'Size_' || (o_orderkey % 50 + 1) AS column_name FROM orders""",
    "e_link": "SELECT report_id, semantic_model_id FROM e_report JOIN e_model ON e_model.name = e_report.name || '.SemanticModel'",
    "e_ref_link": "SELECT report_id, semantic_model_id FROM e_report JOIN e_model ON semantic_model_reference = semantic_model_id",
    "e_linked": "SELECT DISTINCT semantic_model_id, kind, table_name, field FROM e_usage JOIN e_link USING (report_id)",
    # What the expressions refer to, stated from the part rows.
    "e_column_ref": """
        SELECT semantic_model_id, table_name, measure_name, table_name AS ref_table, p_type AS ref_column FROM e_measure
        UNION SELECT semantic_model_id, table_name, measure_name, 'Dim_' || p_type, 'Size_' || p_size FROM e_measure WHERE p_partkey % 3 = 0""",
    "e_measure_ref": f"""
        SELECT semantic_model_id, table_name, measure_name, 'm' || {_PARENT} AS ref_measure, true AS is_known FROM e_measure WHERE p_partkey >= 25
        UNION SELECT semantic_model_id, table_name, measure_name, 'Budget ' || p_size, false FROM e_measure WHERE p_partkey % 11 = 0""",
    "e_table_ref": """
        SELECT semantic_model_id, table_name, measure_name, 'Dim_' || p_type AS ref_table FROM e_measure WHERE p_partkey % 7 = 0
        UNION SELECT semantic_model_id, table_name, measure_name, 'Calc_' || p_size FROM e_measure WHERE p_partkey % 13 = 0""",
    "e_direct": """
        SELECT semantic_model_id, measure_name, table_name AS measure_table, 'column' AS dependency_type, ref_column AS referenced_name, ref_table AS referenced_table FROM e_column_ref
        UNION SELECT semantic_model_id, measure_name, table_name, 'table', ref_table, NULL FROM e_table_ref
        UNION SELECT semantic_model_id, measure_name, table_name, 'table', ref_table, NULL FROM e_column_ref
        UNION SELECT r.semantic_model_id, r.measure_name, r.table_name, 'measure', ref_measure, coalesce(m.table_name, '')
          FROM e_measure_ref r LEFT JOIN e_measure m ON m.semantic_model_id = r.semantic_model_id AND m.measure_name = ref_measure""",
    "e_closure": """
        SELECT semantic_model_id, measure_name, measure_table, referenced_name AS reached FROM e_direct WHERE dependency_type = 'measure'
        UNION SELECT c.semantic_model_id, c.measure_name, c.measure_table, d.referenced_name
          FROM e_closure c JOIN e_direct d ON d.semantic_model_id = c.semantic_model_id AND d.measure_name = c.reached
          WHERE d.dependency_type = 'measure'""",
    "e_function": """
        SELECT semantic_model_id, measure_name, 'SUM' AS function_name FROM e_measure
        UNION SELECT semantic_model_id, measure_name, 'MAX' FROM e_measure WHERE p_partkey % 3 = 0
        UNION SELECT semantic_model_id, measure_name, 'COUNTROWS' FROM e_measure WHERE p_partkey % 7 = 0 OR p_partkey % 13 = 0""",
    "e_closed": """
        SELECT * FROM e_direct
        UNION SELECT c.semantic_model_id, c.measure_name, c.measure_table, d.dependency_type, d.referenced_name, d.referenced_table
          FROM e_closure c JOIN e_direct d ON d.semantic_model_id = c.semantic_model_id AND d.measure_name = c.reached""",
    # An earlier state of the measures, with the later one for the models of region 1.
    "r_early": f"""
        SELECT semantic_model_id, measure_name, table_name, 'column' AS dependency_type, 'c' AS referenced_name, 'Old' AS referenced_table FROM e_measure
        UNION SELECT semantic_model_id, measure_name, table_name, 'table', 'Old', NULL FROM e_measure
        UNION SELECT r.semantic_model_id, r.measure_name, r.table_name, 'measure', ref, coalesce(m.table_name, '') FROM (
          SELECT semantic_model_id, measure_name, table_name, 'm' || (p_partkey + 25) AS ref FROM e_measure WHERE p_partkey < 25
          UNION SELECT semantic_model_id, measure_name, table_name, 'm' || {_PARENT} FROM e_measure WHERE p_partkey >= 25 AND p_partkey % 5 <> 2
          UNION SELECT semantic_model_id, measure_name, table_name, 'm' || (p_partkey % 25) FROM e_measure WHERE p_partkey % 7 = 3) r
          LEFT JOIN e_measure m ON m.semantic_model_id = r.semantic_model_id AND m.measure_name = r.ref""",
    "r_direct": """
        SELECT * FROM r_early WHERE semantic_model_id NOT IN (SELECT 'sm' || n_nationkey FROM nation WHERE n_regionkey = 1)
        UNION SELECT * FROM e_direct WHERE semantic_model_id IN (SELECT 'sm' || n_nationkey FROM nation WHERE n_regionkey = 1)""",
    "r_closure": """
        SELECT semantic_model_id, measure_name, table_name, referenced_name AS reached FROM r_direct WHERE dependency_type = 'measure'
        UNION SELECT c.semantic_model_id, c.measure_name, c.table_name, d.referenced_name
          FROM r_closure c JOIN r_direct d ON d.semantic_model_id = c.semantic_model_id AND d.measure_name = c.reached
          WHERE d.dependency_type = 'measure'""",
    "e_calc_dep": """
        SELECT semantic_model_id, 'Calc_' || p_size AS calculated_table_name, 'column' AS dependency_type, 'Key' AS referenced_name, 'Dim_' || t AS referenced_table FROM e_calc
        UNION ALL SELECT semantic_model_id, 'Calc_' || p_size, 'table', 'Dim_' || t, NULL FROM e_calc
        UNION ALL SELECT semantic_model_id, 'Calc_' || p_size, 'measure', 'm' || k, NULL FROM e_calc
        UNION ALL SELECT semantic_model_id, 'Calc_' || p_size, 'table', 'Calc_' || (p_size - 1), NULL FROM e_calc c
          WHERE p_size % 4 <> 0 AND EXISTS (SELECT 1 FROM e_calc o WHERE o.semantic_model_id = c.semantic_model_id AND o.p_size = c.p_size - 1)""",
    "e_edge": """
        SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b, true AS walk FROM lineitem
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey % 5 <> 0 FROM supplier
        UNION ALL SELECT 'n' || n_nationkey, 'g' || n_regionkey, true FROM nation""",
    "e_seed": """
        SELECT 'p' || p_partkey AS table_name, 'ManyToOne' AS direction FROM part WHERE p_brand = 'Brand#1'
        UNION ALL SELECT 'n' || n_nationkey, 'Both' FROM nation WHERE n_regionkey = 0""",
    "e_step1": """
        SELECT DISTINCT b AS table_name FROM e_seed JOIN e_edge ON a = table_name AND walk
        UNION SELECT a FROM e_seed JOIN e_edge ON b = table_name AND walk WHERE direction = 'Both'""",
    "e_walk": """
        SELECT table_name, 1 AS depth FROM e_step1 WHERE table_name NOT IN (SELECT table_name FROM e_seed)
        UNION SELECT b, depth + 1 FROM e_walk JOIN e_edge ON a = table_name AND walk
          WHERE depth < 4 AND b NOT IN (SELECT table_name FROM e_seed)""",
    "e_expanded": """
        SELECT DISTINCT 'data' AS semantic_model_id, table_name, 0 AS depth FROM e_seed
        UNION ALL SELECT 'data', table_name, min(depth) FROM e_walk GROUP BY table_name""",
    # The minimal model, step by step.
    "m_used_column": "SELECT DISTINCT semantic_model_id, table_name, field AS column_name FROM e_linked WHERE kind = 'column'",
    "m_used_measure": "SELECT DISTINCT semantic_model_id, table_name, field AS measure_name FROM e_linked WHERE kind = 'measure'",
    "m_need": """
        SELECT DISTINCT d.semantic_model_id, dependency_type, referenced_name, referenced_table FROM e_closed d
        WHERE EXISTS (SELECT 1 FROM m_used_measure u WHERE u.semantic_model_id = d.semantic_model_id AND u.measure_name = d.measure_name)""",
    "m_report_table": """
        SELECT semantic_model_id, table_name FROM m_used_column UNION SELECT semantic_model_id, table_name FROM m_used_measure""",
    "m_start": """
        SELECT * FROM m_report_table
        UNION SELECT semantic_model_id, referenced_name FROM m_need WHERE dependency_type = 'table'
        UNION SELECT semantic_model_id, referenced_table FROM m_need WHERE dependency_type IN ('column', 'measure') AND coalesce(referenced_table, '') <> ''""",
    "m_closed_table": """
        SELECT semantic_model_id, table_name FROM m_start
        UNION SELECT d.semantic_model_id, CASE dependency_type WHEN 'table' THEN referenced_name ELSE referenced_table END
          FROM m_closed_table t JOIN e_calc_dep d ON d.semantic_model_id = t.semantic_model_id AND calculated_table_name = t.table_name
          WHERE dependency_type IN ('table', 'column')""",
    "m_measure": """
        SELECT * FROM m_used_measure
        UNION SELECT m.semantic_model_id, m.table_name, m.measure_name FROM e_measure m
          JOIN m_need n ON n.semantic_model_id = m.semantic_model_id AND n.referenced_name = m.measure_name AND dependency_type = 'measure'""",
    "m_table0": "SELECT * FROM m_closed_table UNION SELECT semantic_model_id, table_name FROM m_measure",
    "m_rel": """
        SELECT e.* FROM e_rel e
        JOIN m_table0 f ON f.semantic_model_id = e.semantic_model_id AND f.table_name = from_table
        JOIN m_table0 t ON t.semantic_model_id = e.semantic_model_id AND t.table_name = to_table""",
    "m_column0": """
        SELECT * FROM m_used_column
        UNION SELECT semantic_model_id, referenced_table, referenced_name FROM m_need WHERE dependency_type = 'column' AND coalesce(referenced_table, '') <> ''
        UNION SELECT d.semantic_model_id, referenced_table, referenced_name FROM m_closed_table t
          JOIN e_calc_dep d ON d.semantic_model_id = t.semantic_model_id AND calculated_table_name = t.table_name AND dependency_type = 'column'
        UNION SELECT semantic_model_id, from_table, from_column FROM m_rel
        UNION SELECT semantic_model_id, to_table, to_column FROM m_rel""",
    "m_sorted": """
        SELECT semantic_model_id, table_name, column_name FROM m_column0
        UNION SELECT c.semantic_model_id, c.table_name, c.sort_by_column FROM m_sorted s
          JOIN e_column c ON c.semantic_model_id = s.semantic_model_id AND c.table_name = s.table_name AND c.column_name = s.column_name
          JOIN e_column x ON x.semantic_model_id = c.semantic_model_id AND x.table_name = c.table_name AND x.column_name = c.sort_by_column""",
    "m_column": """
        SELECT * FROM m_sorted
        UNION SELECT b.semantic_model_id, bin_table, bin_column FROM e_bin b
          JOIN m_sorted s ON s.semantic_model_id = b.semantic_model_id AND s.table_name = b.table_name AND s.column_name = b.source_column
        UNION SELECT b.semantic_model_id, b.table_name, source_column FROM e_bin b
          JOIN m_sorted s ON s.semantic_model_id = b.semantic_model_id AND s.table_name = b.bin_table AND s.column_name = b.bin_column""",
    "m_kept": """
        SELECT DISTINCT semantic_model_id, table_name FROM e_table
        SEMI JOIN m_table0 USING (semantic_model_id, table_name)""",
    "m_kept_column": """
        SELECT semantic_model_id, table_name, column_name FROM e_column SEMI JOIN m_kept USING (semantic_model_id, table_name)
          SEMI JOIN m_column USING (semantic_model_id, table_name, column_name)
        UNION SELECT semantic_model_id, table_name, column_name FROM e_column SEMI JOIN m_kept USING (semantic_model_id, table_name)
          ANTI JOIN m_column USING (semantic_model_id, table_name)""",
    "m_kept_measure": """
        SELECT semantic_model_id, table_name, measure_name FROM e_measure SEMI JOIN m_kept USING (semantic_model_id, table_name)
          SEMI JOIN m_measure USING (semantic_model_id, table_name, measure_name)
        UNION SELECT semantic_model_id, table_name, measure_name FROM e_measure SEMI JOIN m_kept USING (semantic_model_id, table_name)
          ANTI JOIN m_measure USING (semantic_model_id, table_name)""",
    "m_flag": """
        SELECT k.semantic_model_id, k.table_name,
          CASE WHEN r.table_name IS NOT NULL THEN 'report' ELSE 'dax-dep' END AS provenance,
          c.table_name IS NULL AS keeps_all_columns, m.table_name IS NULL AS keeps_all_measures
        FROM m_kept k
        LEFT JOIN m_report_table r USING (semantic_model_id, table_name)
        LEFT JOIN (SELECT DISTINCT semantic_model_id, table_name FROM m_column) c USING (semantic_model_id, table_name)
        LEFT JOIN (SELECT DISTINCT semantic_model_id, table_name FROM m_measure) m USING (semantic_model_id, table_name)""",
    # Unused objects.
    "u_used_measure": """
        SELECT semantic_model_id, measure_name FROM m_used_measure
        UNION SELECT semantic_model_id, referenced_name FROM m_need WHERE dependency_type = 'measure'""",
    "u_measure": """
        SELECT semantic_model_id, table_name, measure_name, expression FROM e_measure
        ANTI JOIN u_used_measure USING (semantic_model_id, measure_name)""",
    "u_used_column": """
        SELECT semantic_model_id, table_name, column_name FROM m_used_column
        UNION SELECT semantic_model_id, referenced_table, referenced_name FROM e_closed WHERE dependency_type = 'column'
        UNION SELECT semantic_model_id, from_table, from_column FROM e_rel UNION SELECT semantic_model_id, to_table, to_column FROM e_rel""",
    "u_column": """
        SELECT semantic_model_id, table_name, column_name, data_type, is_hidden FROM e_column
        ANTI JOIN u_used_column USING (semantic_model_id, table_name, column_name)""",
    "u_used_table": """
        SELECT semantic_model_id, table_name FROM m_report_table
        UNION SELECT semantic_model_id, referenced_name FROM e_closed WHERE dependency_type = 'table'
        UNION SELECT semantic_model_id, referenced_table FROM e_closed WHERE dependency_type = 'column'""",
    "u_reached_table": """
        SELECT * FROM u_used_table
        UNION SELECT e.semantic_model_id, unnest([from_table, to_table]) FROM e_rel e JOIN u_used_table u
          ON u.semantic_model_id = e.semantic_model_id AND u.table_name IN (from_table, to_table)""",
    "u_table": """
        SELECT semantic_model_id, table_name, is_hidden FROM e_table ANTI JOIN u_reached_table USING (semantic_model_id, table_name)""",
    "u_summary": """
        SELECT semantic_model_id, table_name, CAST(sum(c) AS BIGINT) AS unused_columns, CAST(sum(m) AS BIGINT) AS unused_measures, CAST(sum(t) AS BIGINT) AS unused_tables
        FROM (SELECT semantic_model_id, table_name, 1 AS c, 0 AS m, 0 AS t FROM u_column
          UNION ALL SELECT semantic_model_id, table_name, 0, 1, 0 FROM u_measure
          UNION ALL SELECT semantic_model_id, table_name, 0, 0, 1 FROM u_table)
        GROUP BY GROUPING SETS ((semantic_model_id, table_name), (semantic_model_id))""",
    "e_kpi": """
        SELECT semantic_model_id,
          (SELECT count(*) FROM e_column x WHERE x.semantic_model_id = m.semantic_model_id) AS columns,
          (SELECT count(*) FROM e_measure x WHERE x.semantic_model_id = m.semantic_model_id) AS measures,
          (SELECT count(*) FROM e_table x WHERE x.semantic_model_id = m.semantic_model_id) AS tables,
          (SELECT count(*) FROM e_rel x WHERE x.semantic_model_id = m.semantic_model_id) AS relationships,
          (SELECT count(*) FROM e_link x WHERE x.semantic_model_id = m.semantic_model_id) AS reports_using_model,
          (SELECT count(*) FROM e_page p JOIN e_link x USING (report_id) WHERE x.semantic_model_id = m.semantic_model_id) AS pages
        FROM e_model m""",
    # The star schema as a model.
    "s_column": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{t}', '{c}')" for i, (t, c) in enumerate(star_columns())) + ") AS v(i, table_name, column_name)",
    "s_edge": "SELECT * FROM (VALUES " + ", ".join(str(k) for k in STAR_KEYS) + ") AS v(ft, fc, tt, tc)",
    "s_used": f"""
        SELECT DISTINCT table_name, column_name FROM s_column
        JOIN e_event ON i = (k * k) % {len(star_columns())} SEMI JOIN customer ON c_custkey = user_id""",
    "s_rel": """
        SELECT * FROM s_edge WHERE ft IN (SELECT table_name FROM s_used) AND tt IN (SELECT table_name FROM s_used)""",
    "s_kept": "SELECT * FROM s_used UNION SELECT ft, fc FROM s_rel UNION SELECT tt, tc FROM s_rel",
    # Report documents.
    "p_page": """
        SELECT CAST(user_id AS BIGINT) AS source_order, event_id AS position,
          event_type || CASE WHEN user_id = 0 AND event_id % 3 = 0 THEN ' (' || (event_id % 50) || ')' ELSE '' END AS name FROM events""",
    "p_renamed": """
        SELECT source_order, position, name, row_number() OVER (PARTITION BY name ORDER BY source_order, position)
          - CASE WHEN name IN (SELECT name FROM p_page WHERE source_order = 0) THEN 0 ELSE 1 END AS rank
        FROM p_page WHERE source_order <> 0""",
    "p_free": """
        SELECT name, number, row_number() OVER (PARTITION BY name ORDER BY number) AS rank
        FROM (SELECT name, unnest(range(2, max(rank) + 60)) AS number FROM p_renamed GROUP BY name) n
        WHERE name || ' (' || number || ')' NOT IN (SELECT name FROM p_page WHERE source_order = 0)""",
    "v_doc": "SELECT 'r' || o_custkey AS report_id, 'page' || o_orderstatus AS page_name, 'v' || o_orderkey AS visual_name, * FROM orders",
    "v_ref": """
        SELECT report_id, page_name, visual_name, 'measure' AS kind, 'T' || (o_custkey % 7) || '.M' || (o_orderkey % 11) AS ref, 2 AS n FROM v_doc
        UNION ALL SELECT report_id, page_name, visual_name, 'column', 'Dim' || (o_custkey % 3) || '.C' || (o_orderkey % 5), 2 FROM v_doc
        UNION ALL SELECT report_id, page_name, visual_name, 'column', 'T' || (o_custkey % 7) || '.Sort', 2 FROM v_doc
        UNION ALL SELECT report_id, page_name, visual_name, 'column', 'T' || (o_custkey % 7) || '.Fill', 2 FROM v_doc
        UNION ALL SELECT report_id, page_name, visual_name, 'column', 'E' || (o_custkey % 2) || '.Flt', 1 FROM v_doc""",
}

RECURSIVE = {"e_closure", "r_closure", "e_walk", "m_closed_table", "m_sorted"}


def _needed(text: str, found: list[str]) -> None:
    words = set(re.findall(r"\b[a-z]_\w+\b", text))
    for name in CTES:
        if name in words and name not in found:
            _needed(CTES[name].replace(name, "") if name in RECURSIVE else CTES[name], found)
            if name not in found:
                found.append(name)


def sql(body: str) -> str:
    """Body with the CTEs it uses, directly or through others, in definition order."""
    found: list[str] = []
    _needed(body, found)
    parts = []
    for name in CTES:
        if name not in found:
            continue
        parts.append(f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({CTES[name]})")
    if not parts:
        return body
    recursive = "RECURSIVE " if any(n in RECURSIVE for n in found) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body


_VISUAL = "report_id, page_name, visual_name"


def _profile() -> str:
    """Row count, filled count and a checksum for every column of the star schema."""
    rows = []
    for table, names in STAR.items():
        for c in names:
            rows.append(
                f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count({c}) AS filled, "
                f"CAST(sum({checksum_sql(c)}) AS BIGINT) AS checksum FROM {table}"
            )
    return " UNION ALL ".join(rows)


def checksum_sql(column: str) -> str:
    """Integer that both engines compute alike, by the kind of the column."""
    if column.endswith("date"):
        return f"year({column}) * 12 + month({column})"
    if column.endswith(("price", "bal", "discount", "tax", "quantity")):
        return f"CAST(round({column} * 100) AS BIGINT)"
    if column.endswith(("key", "number", "size")):
        return column
    return f"length({column})"


# Query name → body. Built once by ``oracles``.
BODIES: dict[str, str] = {
    # usage
    "column_usage": f"SELECT {_VISUAL}, table_name, column_name, usage_count FROM e_column_used",
    "measure_usage": f"SELECT {_VISUAL}, table_name, measure_name, usage_count FROM e_measure_used",
    "fields_by_table": "SELECT DISTINCT report_id, kind, table_name, field FROM e_usage",
    "fields_by_page": "SELECT DISTINCT report_id, page_name, kind, table_name, field FROM e_usage",
    "usage_by_report": """
        SELECT report_id, name AS report_name, workspace_id,
          CAST(coalesce(sum(usage_count) FILTER (kind = 'column'), 0) AS BIGINT) AS total_column_usage,
          CAST(coalesce(sum(usage_count) FILTER (kind = 'measure'), 0) AS BIGINT) AS total_measure_usage
        FROM e_report LEFT JOIN e_usage USING (report_id) GROUP BY 1, 2, 3""",
    "usage_by_table": """
        SELECT semantic_model_id, table_name, CAST(coalesce(sum(usage_count) FILTER (kind = 'column'), 0) AS BIGINT) AS column_usage,
          CAST(coalesce(sum(usage_count) FILTER (kind = 'measure'), 0) AS BIGINT) AS measure_usage, count(DISTINCT report_id) AS reports
        FROM e_usage JOIN e_ref_link USING (report_id) GROUP BY 1, 2""",
    "usage_by_visual": f"""
        SELECT {_VISUAL}, kind, table_name, field, CAST(sum(usage_count) AS BIGINT) AS usage_count FROM e_usage GROUP BY ALL""",
    "usage_matrix": "SELECT table_name, report_id, count(DISTINCT field) AS fields FROM e_usage GROUP BY 1, 2",
    "reports_per_table": "SELECT table_name, count(DISTINCT report_id) AS reports FROM e_usage GROUP BY 1",
    "model_usage_summary": """
        SELECT semantic_model_id, t AS total_tables, u AS used_tables, greatest(t - u, 0) AS unused_tables FROM (
          SELECT semantic_model_id,
            (SELECT count(*) FROM e_table x WHERE x.semantic_model_id = m.semantic_model_id) AS t,
            (SELECT count(DISTINCT table_name) FROM e_usage JOIN e_ref_link l USING (report_id) WHERE l.semantic_model_id = m.semantic_model_id) AS u
          FROM e_model m)""",
    "tables_without_usage": """
        SELECT semantic_model_id, table_name FROM e_table ANTI JOIN
          (SELECT semantic_model_id, table_name FROM e_usage JOIN e_ref_link USING (report_id)) USING (semantic_model_id, table_name)""",
    "model_kpis": "SELECT * FROM e_kpi",
    "page_details": """
        SELECT DISTINCT report_id, page_name, 'column' AS kind, table_name, column_name AS name, NULL AS text FROM e_column_used
        UNION ALL SELECT u.*, expression FROM (
            SELECT DISTINCT report_id, page_name, 'measure', CAST(NULL AS VARCHAR), measure_name FROM e_measure_used) u(report_id, page_name, kind, t, name)
          LEFT JOIN e_link l ON l.report_id = u.report_id
          LEFT JOIN e_measure m ON m.semantic_model_id = l.semantic_model_id AND m.measure_name = u.name
        UNION ALL SELECT u.report_id, page_name, 'source', u.table_name, partition_name, source_expression
          FROM (SELECT DISTINCT report_id, page_name, table_name FROM e_column_used) u
          JOIN e_link l ON l.report_id = u.report_id
          JOIN e_partition p ON p.semantic_model_id = l.semantic_model_id AND p.table_name = u.table_name""",
    "workspace_counts": """
        SELECT id, displayName, reports, models, reports = 0 AND models = 0 AS is_empty FROM (
          SELECT id, displayName, (SELECT count(*) FROM e_report r WHERE r.workspace_id = w.id) AS reports,
            (SELECT count(*) FROM e_model m WHERE m.workspace_id = w.id) AS models FROM e_workspace w)""",
    "partition_mode_histogram": """
        SELECT coalesce(mode, 'total') AS mode, count(*) AS partitions FROM (
          SELECT CASE WHEN lower(mode) IN ('import', 'directquery', 'dual') THEN lower(mode) ELSE 'other' END AS mode FROM e_partition)
        GROUP BY ROLLUP (mode)""",
    "model_info": """
        SELECT semantic_model_id, table_name,
          (SELECT count(*) FROM e_column x WHERE x.semantic_model_id = t.semantic_model_id AND x.table_name = t.table_name) AS columns,
          (SELECT count(*) FROM e_measure x WHERE x.semantic_model_id = t.semantic_model_id AND x.table_name = t.table_name) AS measures,
          (SELECT count(*) FROM e_partition x WHERE x.semantic_model_id = t.semantic_model_id AND x.table_name = t.table_name) AS partitions
        FROM e_table t""",
    "first_relationships": """
        SELECT * FROM (SELECT semantic_model_id, CAST(row_number() OVER (PARTITION BY semantic_model_id ORDER BY relationship_name) AS INT) AS position,
          relationship_name, from_table, from_column, to_table, to_column FROM e_rel) WHERE position <= 10""",
    "table_columns_listing": """
        SELECT semantic_model_id, table_name, position, column_name, data_type, greatest(n - 5, 0) AS more_columns FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY semantic_model_id, table_name ORDER BY column_name) AS INT) AS position,
            count(*) OVER (PARTITION BY semantic_model_id, table_name) AS n FROM e_column) WHERE position <= 5""",
    "partition_previews": """
        SELECT semantic_model_id, table_name, partition_name, source_type, coalesce(mode, 'N/A') AS mode,
          CASE WHEN p_size > 25 THEN 'let' || chr(10) || '    a = ' || p_partkey || chr(10) || 'x' || chr(10) || 'y' || chr(10) || 'z' ELSE source_expression END AS preview,
          CAST(CASE WHEN p_size > 25 THEN 7 ELSE 4 END AS BIGINT) AS source_lines FROM e_partition""",
    "visuals_per_page": """
        SELECT p.report_id, p.name AS page_name, 'Page ' || l_linenumber AS display_name, 1280 AS width, 720 AS height, count(v.name) AS visuals
        FROM e_page p LEFT JOIN e_visual v ON v.report_id = p.report_id AND v.page_name = p.name GROUP BY ALL""",
    "page_visual_fields": """
        SELECT v.report_id, v.page_name, v.name AS visual_name, visual_type, x, 0.0::DOUBLE AS y, 100.0::DOUBLE AS width, 100.0::DOUBLE AS height,
          kind, table_name, field
        FROM e_visual v LEFT JOIN (SELECT DISTINCT report_id, page_name, visual_name, kind, table_name, field FROM e_usage) u
          ON u.report_id = v.report_id AND u.page_name = v.page_name AND u.visual_name = v.name""",
    "linked_by_name_ratio": """
        SELECT count(*) FILTER (name || '.SemanticModel' IN (SELECT name FROM e_model)) AS linked_reports, count(*) AS total_reports FROM e_report""",
    # links
    "reports_for_model": """
        SELECT semantic_model_id, m.name AS model_name, report_id, r.name AS report_name FROM e_report r JOIN e_model m ON m.name = r.name || '.SemanticModel'""",
    "model_for_report": """
        SELECT semantic_model_id, m.name AS model_name, report_id, r.name AS report_name FROM e_report r LEFT JOIN e_model m ON m.name = r.name || '.SemanticModel'""",
    "reports_by_reference": "SELECT report_id, semantic_model_id FROM e_ref_link",
    "model_with_workspace": "SELECT semantic_model_id, name AS model_name, displayName AS workspace_name FROM e_model LEFT JOIN e_workspace ON id = workspace_id",
    "sibling_counts": """
        SELECT report_id, semantic_model_reference, count(*) OVER (PARTITION BY semantic_model_reference) - 1 AS siblings FROM e_report""",
    "sibling_reports": """
        SELECT a.report_id, b.report_id AS sibling_id, b.name AS sibling_name, a.semantic_model_reference FROM e_report a JOIN e_report b
          ON a.semantic_model_reference = b.semantic_model_reference AND a.report_id <> b.report_id
        WHERE a.report_id IN (SELECT 'r' || max(c_custkey) FROM customer GROUP BY c_mktsegment)""",
    "resolve_model_id": """
        SELECT 'q' || c_custkey AS request_id,
          CASE WHEN c_custkey % 50 < 25 THEN 'sm' || (c_custkey % 50) WHEN c_nationkey % 3 = 0 THEN 'sm' || c_nationkey ELSE (SELECT min(semantic_model_id) FROM e_model) END AS resolved_id,
          CASE WHEN c_custkey % 50 < 25 THEN 'id' WHEN c_nationkey % 3 = 0 THEN 'name' ELSE 'first' END AS resolved_by
        FROM customer""",
    # references
    "clean_expression": r"""
        SELECT doc_id, regexp_replace(regexp_replace(text, '(?is)(?:^|\n)[ \t\r\f]*(?:lineagetag:|changedproperty|formatstring:).*$', ''),
          '(\[[^\]]*\]|''(?:[^''\n]|'''')*''|"(?:[^"]|"")*")|/\*(?s:.*?)\*/|//[^\n]*', '\1 ', 'g') AS cleaned FROM documents""",
    "qualified_refs": "SELECT *, true AS is_known FROM e_column_ref",
    "measure_refs": "SELECT * FROM e_measure_ref",
    "functions_used": """
        SELECT semantic_model_id, table_name, measure_name, 'SUM' AS function_name FROM e_measure
        UNION ALL SELECT semantic_model_id, table_name, measure_name, 'COUNTROWS' FROM e_measure WHERE p_partkey % 7 = 0 OR p_partkey % 13 = 0""",
    "variables_used": "SELECT semantic_model_id, table_name, measure_name, 'v_' || p_partkey AS variable_name FROM e_measure",
    "bare_table_refs": "SELECT * FROM e_table_ref",
    "direct_dependencies": "SELECT * FROM e_direct",
    "calculated_table_dependencies": "SELECT * FROM e_calc_dep",
    "external_table_refs": """
        SELECT DISTINCT semantic_model_id, 'Dim_' || p_type AS table_name, 'Size_' || p_size AS column_name FROM e_measure
        WHERE p_partkey % 3 = 0""",
    "own_table_columns": """
        SELECT DISTINCT 'sm' || (l_suppkey % 25) AS semantic_model_id, l_returnflag || l_linestatus AS table_name, 'Q' || l_linenumber AS column_name FROM lineitem""",
    "search_measures": """
        SELECT semantic_model_id, table_name, measure_name FROM e_measure WHERE expression ILIKE '%countrows(calc_%'""",
    "search_measures_indexed": """
        SELECT DISTINCT text, semantic_model_id, table_name, measure_name FROM e_measure, (
          SELECT DISTINCT lower(p_brand) || '[' AS text FROM part UNION SELECT '[m' || n_nationkey || ']' FROM nation
          UNION SELECT unnest(['v_', 'CountRows(calc_'])) t
        WHERE contains(lower(measure_name), lower(text)) OR contains(lower(expression), lower(text))""",
    "search_documents": "SELECT doc_id FROM documents WHERE text ILIKE '%license%'",
    # graph
    "measure_closure": "SELECT DISTINCT semantic_model_id, measure_name, reached FROM e_closure",
    "transitive_dependencies": "SELECT * FROM e_closed",
    "table_dependency_graph": """
        SELECT DISTINCT semantic_model_id, measure_table AS table_name, referenced_name AS depends_on FROM e_closed
        WHERE dependency_type = 'table' AND measure_table <> referenced_name""",
    "inherited_functions": """
        SELECT semantic_model_id, measure_name, function_name FROM e_function
        UNION SELECT c.semantic_model_id, c.measure_name, f.function_name FROM e_closure c
          JOIN e_function f ON f.semantic_model_id = c.semantic_model_id AND f.measure_name = c.reached""",
    "expand_tables": "SELECT * FROM e_expanded",
    "neighbours": """
        SELECT 'data' AS semantic_model_id, a AS table_name, b AS neighbour FROM e_edge UNION SELECT 'data', b, a FROM e_edge""",
    "close_calculated_tables": "SELECT * FROM m_closed_table",
    "close_sort_by": "SELECT * FROM m_sorted",
    "pair_bins": "SELECT * FROM m_column",
    "relationships_between": "SELECT semantic_model_id, relationship_name FROM m_rel",
    "relationship_key_columns": """
        SELECT semantic_model_id, from_table AS table_name, from_column AS column_name FROM e_rel UNION SELECT semantic_model_id, to_table, to_column FROM e_rel""",
    # unused
    "unused_measures": "SELECT * FROM u_measure",
    "unused_columns": "SELECT * FROM u_column",
    "unused_tables": "SELECT * FROM u_table",
    "unused_summary": "SELECT * FROM u_summary",
    "reduction_preview": """
        SELECT k.semantic_model_id, tables - coalesce(unused_tables, 0) AS used_tables, tables AS total_tables, coalesce(unused_tables, 0) AS removed_tables,
          columns - coalesce(unused_columns, 0) AS used_columns, columns AS total_columns, coalesce(unused_columns, 0) AS removed_columns,
          measures - coalesce(unused_measures, 0) AS used_measures, measures AS total_measures, coalesce(unused_measures, 0) AS removed_measures
        FROM e_kpi k LEFT JOIN (SELECT * FROM u_summary WHERE table_name IS NULL) s ON s.semantic_model_id = k.semantic_model_id""",
    # subset
    "used_objects": "SELECT * FROM e_linked",
    "used_objects_with_filters": """
        SELECT * FROM e_linked UNION SELECT l.semantic_model_id, 'column', f.table_name, f.column_name
        FROM (SELECT DISTINCT * FROM e_filter) f JOIN e_link l USING (report_id)
        SEMI JOIN e_column c ON c.semantic_model_id = l.semantic_model_id AND c.table_name = f.table_name AND c.column_name = f.column_name""",
    "required_by_measures": """
        SELECT DISTINCT semantic_model_id, 'table' AS kind, referenced_name AS table_name, CAST(NULL AS VARCHAR) AS name FROM m_need WHERE dependency_type = 'table'
        UNION SELECT semantic_model_id, 'table', referenced_table, NULL FROM m_need WHERE dependency_type = 'measure' AND referenced_table <> ''
        UNION SELECT semantic_model_id, 'column', referenced_table, referenced_name FROM m_need WHERE dependency_type = 'column'
        UNION SELECT semantic_model_id, 'measure', NULL, referenced_name FROM m_need WHERE dependency_type = 'measure'""",
    "minimal_model_tables": "SELECT * FROM m_flag",
    "minimal_model_columns": "SELECT * FROM m_kept_column",
    "minimal_model_measures": "SELECT * FROM m_kept_measure",
    "minimal_model_relationships": "SELECT semantic_model_id, relationship_name, from_table, from_column, to_table, to_column FROM m_rel",
    "subset_summary": """
        SELECT f.*, (SELECT count(*) FROM m_kept_column x WHERE x.semantic_model_id = f.semantic_model_id AND x.table_name = f.table_name) AS columns,
          (SELECT count(*) FROM m_kept_measure x WHERE x.semantic_model_id = f.semantic_model_id AND x.table_name = f.table_name) AS measures
        FROM m_flag f""",
    "removed_columns": "SELECT semantic_model_id, table_name, column_name FROM e_column ANTI JOIN m_kept_column USING (semantic_model_id, table_name, column_name)",
    "subset_manifest": """
        SELECT 'all reports' AS subset_name, 'from_db' AS method, semantic_model_id, CASE provenance WHEN 'report' THEN 'report_table' ELSE 'dax_extra_table' END AS section,
          table_name, CAST(NULL AS VARCHAR) AS entry FROM m_flag
        UNION ALL SELECT 'all reports', 'from_db', k.semantic_model_id, CASE WHEN u.measure_name IS NULL THEN 'chained_measure' ELSE 'used_measure' END, k.table_name, k.measure_name
          FROM m_kept_measure k LEFT JOIN m_used_measure u USING (semantic_model_id, table_name, measure_name)
        UNION ALL SELECT 'all reports', 'from_db', semantic_model_id, 'relationship', from_table, relationship_name FROM m_rel""",
    "subset_totals": """
        SELECT k.semantic_model_id, count(*) AS tables, (SELECT count(*) FROM m_rel r WHERE r.semantic_model_id = k.semantic_model_id) AS relationships
        FROM m_kept k GROUP BY k.semantic_model_id""",
    "clear_invalid_sort_by": """
        SELECT c.semantic_model_id, c.table_name, c.column_name, k.column_name AS sort_by_column FROM e_column c
        SEMI JOIN m_kept_column s ON s.semantic_model_id = c.semantic_model_id AND s.table_name = c.table_name AND s.column_name = c.column_name
        LEFT JOIN m_kept_column k ON k.semantic_model_id = c.semantic_model_id AND k.table_name = c.table_name AND k.column_name = c.sort_by_column""",
    "apply_element_spec": """
        SELECT semantic_model_id, table_name, column_name FROM e_column
        WHERE NOT (table_name LIKE 'Brand%') OR column_name = 'Key'
          OR EXISTS (SELECT 1 FROM e_linked l WHERE l.kind = 'column' AND l.semantic_model_id = e_column.semantic_model_id
                     AND l.table_name = e_column.table_name AND l.field = e_column.column_name)
          OR NOT EXISTS (SELECT 1 FROM e_linked l WHERE l.kind = 'column' AND l.semantic_model_id = e_column.semantic_model_id AND l.table_name = e_column.table_name)""",
    "report_based_specs": """
        SELECT semantic_model_id, table_name, 'include' AS mode, 'column' AS kind, field AS element FROM e_linked SEMI JOIN e_table USING (semantic_model_id, table_name) WHERE kind = 'column'
        UNION ALL SELECT DISTINCT semantic_model_id, table_name, 'include', 'column', NULL FROM e_linked SEMI JOIN e_table USING (semantic_model_id, table_name) WHERE kind = 'column'""",
    "drop_invalid_variations": """
        SELECT 'sm' || (p_partkey % 25) AS semantic_model_id, p_brand || '-' || p_partkey AS table_name, 'rel' || p_size AS relationship_name
        FROM part WHERE (p_partkey % 25, p_size) IN (SELECT (p_partkey % 25, p_size) FROM part WHERE p_type = 'PROMO')""",
    "subset_from_seeds": """
        SELECT DISTINCT e.semantic_model_id, e.table_name FROM e_table e
        WHERE table_name = 'Brand#1' OR table_name LIKE 'Dim_%' AND EXISTS (
            SELECT 1 FROM e_rel r WHERE r.semantic_model_id = e.semantic_model_id AND from_table = 'Brand#1' AND to_table = e.table_name
              AND coalesce(cardinality, 'many') ILIKE '%many%')
          OR EXISTS (SELECT 1 FROM e_measure m WHERE m.semantic_model_id = e.semantic_model_id AND m.table_name = 'Brand#1' AND p_partkey % 3 = 0
              AND 'Dim_' || p_type = e.table_name)""",
    # Only pages of the target bear numbers, so the r-th renamed page takes the r-th number that they leave free.
    "merge_pages": """
        SELECT -1 AS source_order, position, name AS original_name, name FROM p_page WHERE source_order = 0
        UNION ALL SELECT source_order, position, r.name, CASE WHEN r.rank = 0 THEN r.name ELSE r.name || ' (' || f.number || ')' END
        FROM p_renamed r LEFT JOIN p_free f ON f.name = r.name AND f.rank = r.rank""",
    "prune_star": """
        SELECT p.* FROM (""" + _profile() + """) p SEMI JOIN s_kept USING (table_name, column_name)""",
    # sources
    "classify_files": r"""
        SELECT 'src ' || source AS workspace, 'local_src ' || source || '/Doc ' || doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 'model' ELSE 'report' END AS item_kind,
          CASE WHEN doc_id % 2 = 0 THEN 'definition/tables/' || lang || '.tmdl' ELSE 'definition/report.json' END AS rel_path, text AS content FROM documents""",
    "decode_definition_parts": "SELECT doc_id, 'files/' || doc_id || '.txt' AS rel_path, text AS content FROM documents",
    "explode_workspace_inventory": """
        SELECT 'w' || s_suppkey AS workspace_id, s_name AS workspace_name, 'report' AS kind, 'r' || s_suppkey || '-' || i AS item_id, 'Report ' || i AS item_name
          FROM supplier, (SELECT unnest([1, 2]) AS i)
        UNION ALL SELECT 'w' || s_suppkey, s_name, 'semantic_model', 'm' || s_suppkey, 'Model ' || s_nationkey FROM supplier""",
    "normalize_workspaces": """
        SELECT 'w' || s_suppkey AS id, s_name AS displayName, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'nation ' || s_nationkey END AS description,
          CASE WHEN s_suppkey % 2 = 0 AND s_acctbal <= 5000 AND s_suppkey % 4 IN (0, 2, 3) THEN 'ppu'
            WHEN s_suppkey % 4 = 0 THEN 'workspace' ELSE 'Workspace' END AS type,
          CASE WHEN s_suppkey % 2 = 0 THEN 'cap' || s_nationkey END AS capacityId, CAST(NULL AS VARCHAR) AS domainId,
          s_suppkey % 2 = 0 AND s_acctbal > 5000 AS isOnDedicatedCapacity FROM supplier""",
    "safe_name": r"""
        SELECT doc_id, regexp_replace(regexp_replace(text, '^[\s\x{0B}\x{85}\x{A0}\x{1C}-\x{1F}\p{Z}]+|[\s\x{0B}\x{85}\x{A0}\x{1C}-\x{1F}\p{Z}]+$', '', 'g'),
          '[^\p{L}\p{N} _-]', '_', 'g') AS name FROM documents""",
    "upsert_catalog": """
        SELECT semantic_model_id, table_name, measure_name, CASE WHEN semantic_model_id IN (SELECT 'sm' || n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'new' ELSE expression END AS expression
        FROM e_measure WHERE NOT (semantic_model_id IN (SELECT 'sm' || n_nationkey FROM nation WHERE n_regionkey = 1) AND p_type = 'LARGE')""",
    "reimport_closure": """
        SELECT semantic_model_id, measure_name, table_name AS measure_table, dependency_type, referenced_name, referenced_table FROM r_direct
        UNION SELECT c.semantic_model_id, c.measure_name, c.table_name, d.dependency_type, d.referenced_name, d.referenced_table
          FROM r_closure c JOIN r_direct d ON d.semantic_model_id = c.semantic_model_id AND d.measure_name = c.reached""",
    "stored_catalog": """
        SELECT id AS semantic_model_id, workspace_id, n_name || '.SemanticModel' AS name, m.table_name, m.measure_name, coalesce(new_text, m.expression) AS expression
        FROM nation JOIN e_measure m ON m.semantic_model_id = 'sm' || n_nationkey JOIN (
          SELECT n_nationkey AS k, 'sm' || n_nationkey AS id, 'w' || (n_nationkey * 3) AS workspace_id,
            CASE WHEN n_regionkey = 1 THEN 'new' END AS new_text FROM nation
          UNION ALL SELECT n_nationkey, 'twin' || n_nationkey, 'elsewhere', 'new twin' FROM nation WHERE n_regionkey = 2
          UNION ALL SELECT n_nationkey, x || n_nationkey, 'w' || (n_nationkey * 3), x FROM nation, (VALUES ('x'), ('y')) v(x) WHERE n_regionkey = 3
        ) i ON i.k = n_nationkey WHERE new_text IS NULL OR m.p_type <> 'LARGE'""",
    "upsert_workspaces": """
        SELECT 'u' || user_id AS id, arg_max(event_type, event_id) AS displayName, max(event_id) AS updated_at, min(event_id) AS created_at FROM events GROUP BY user_id""",
    "table_counts": """
        SELECT table_name, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS tables FROM (
          SELECT 'workspaces' AS table_name, count(*) AS n FROM e_workspace UNION ALL SELECT 'semantic_model', count(*) FROM e_model
          UNION ALL SELECT 'semantic_model_table', count(*) FROM e_table UNION ALL SELECT 'semantic_model_column', count(*) FROM e_column
          UNION ALL SELECT 'semantic_model_measure', count(*) FROM e_measure UNION ALL SELECT 'semantic_model_relationship', count(*) FROM e_rel
          UNION ALL SELECT 'semantic_model_table_bins', count(*) FROM e_bin UNION ALL SELECT 'semantic_model_partitions', count(*) FROM e_partition
          UNION ALL SELECT 'report', count(*) FROM e_report UNION ALL SELECT 'report_page', count(*) FROM e_page
          UNION ALL SELECT 'report_visual', count(*) FROM e_visual UNION ALL SELECT 'report_column_used', count(*) FROM e_column_used
          UNION ALL SELECT 'report_measure_used', count(*) FROM e_measure_used UNION ALL SELECT 'report_filter', count(*) FROM e_filter)
        GROUP BY ROLLUP (table_name)""",
    "query_catalog": """
        SELECT t.semantic_model_id, t.table_name, count(m.measure_name) AS measures FROM e_table t LEFT JOIN e_measure m
          ON m.semantic_model_id = t.semantic_model_id AND m.table_name = t.table_name GROUP BY 1, 2 HAVING count(m.measure_name) > 1""",
    "query_with_parameters": """
        SELECT m.semantic_model_id, m.measure_name, count(c.reached) AS reached, count(*) FILTER (starts_with(c.reached, 'm1')) AS matching
        FROM e_measure m LEFT JOIN (SELECT DISTINCT semantic_model_id, measure_name, reached FROM e_closure) c USING (semantic_model_id, measure_name)
        GROUP BY ALL""",
    "load_calc_dependencies": """
        SELECT 'w1' AS workspace_id, CASE WHEN p_partkey % 40 < 25 THEN 'sm' || (p_partkey % 40) END AS semantic_model_id,
          'NATION_' || (p_partkey % 40) || '.SemanticModel' AS database_name, p_name AS object_name, 'MEASURE' AS object_type,
          CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS referenced_object_name, CAST(NULL AS VARCHAR) AS referenced_object_type,
          CAST(NULL AS VARCHAR) AS referenced_database_name, '' AS expression_text, CAST(NULL AS VARCHAR) AS calc_dependency_type FROM part""",
    "subset_spec_seeds": """
        SELECT 'S' || c_custkey AS name, 'M' || c_nationkey AS base_model, unnest(CASE c_custkey % 3 WHEN 0 THEN [c_mktsegment, c_name] ELSE [c_mktsegment] END) AS table_name,
          CASE c_custkey % 3 WHEN 1 THEN 'Both' ELSE 'ManyToOne' END AS direction, c_custkey % 2 = 0 AS recursive, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 10 END AS max_depth FROM customer""",
    # extraction from definition text
    "attribute_blocks": """
        SELECT 'sm' || (p_partkey % 25) AS semantic_model_id, p_brand || '-' || p_partkey AS table_name, b.kind,
          CASE b.i WHEN 0 THEN p_brand || '-' || p_partkey WHEN 1 THEN 'M ' || p_partkey WHEN 2 THEN 'n' || p_partkey WHEN 3 THEN p_type
            WHEN 4 THEN 'Size ' || p_size ELSE p_brand || '-' || p_partkey END AS block_name,
          CAST(CASE b.i WHEN 0 THEN CASE WHEN p_size > 40 THEN 2 ELSE 1 END + CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 2 ELSE 6 END AS BIGINT) AS lines
        FROM part, (SELECT unnest(['table', 'measure', 'measure', 'column', 'column', 'partition']) AS kind, unnest([0, 1, 2, 3, 4, 5]) AS i) b""",
    "extract_tables": """
        SELECT 'sm' || (p_partkey % 25) AS semantic_model_id, p_brand || '-' || p_partkey AS table_name, p_size > 40 AS is_hidden, p_partkey % 5 = 0 AS is_calculated,
          CASE WHEN p_partkey % 5 = 0 THEN 'let' || chr(10) || 'a = ' || p_partkey || chr(10) || 'table = a{[Item="Sales"]}[Data],' || chr(10) || 'in a' END AS source_code FROM part""",
    "extract_columns": """
        SELECT 'sm' || (p_partkey % 25) AS semantic_model_id, p_brand || '-' || p_partkey AS table_name, p_type AS column_name, 'int64' AS data_type,
          'src_' || p_type AS source_column, 'none' AS summarize_by, 'Size ' || p_size AS sort_by_column, false AS is_hidden, NULL AS format_string FROM part
        UNION ALL SELECT 'sm' || (p_partkey % 25), p_brand || '-' || p_partkey, 'Size ' || p_size, 'string', NULL, NULL, NULL, true, NULL FROM part""",
    "extract_measures": """
        SELECT 'sm' || (p_partkey % 25) AS semantic_model_id, p_brand || '-' || p_partkey AS table_name, 'M ' || p_partkey AS measure_name,
          'SUM(''' || p_brand || '''[' || p_type || '])'::VARCHAR AS expression, '0' AS format_string, false AS is_hidden FROM part
        UNION ALL SELECT 'sm' || (p_partkey % 25), p_brand || '-' || p_partkey, 'n' || p_partkey,
          'VAR x = ' || p_size || chr(10) || 'column + x' || chr(10) || 'RETURN x + [M ' || p_partkey || ']', NULL, true FROM part""",
    "extract_partitions": """
        SELECT 'sm' || (p_partkey % 25) AS semantic_model_id, p_brand || '-' || p_partkey AS table_name, p_brand || '-' || p_partkey AS partition_name,
          CASE WHEN p_partkey % 5 = 0 THEN 'calculated' ELSE 'm' END AS source_type, 'import' AS mode,
          'let' || chr(10) || 'a = ' || p_partkey || chr(10) || 'table = a{[Item="Sales"]}[Data],' || chr(10) || 'in a' AS source_expression FROM part""",
    "extract_bins": """
        SELECT 'sm' || (p_partkey % 25) AS semantic_model_id, p_brand || '-' || p_partkey AS table_name, p_type AS source_column,
          'G' || p_size AS bin_table, p_type || ' (bins)' AS bin_column FROM part WHERE p_partkey % 3 = 0""",
    "extract_relationships": """
        SELECT 'sup' || s_suppkey AS semantic_model_id, 'r' || s_suppkey || '-1' AS relationship_name, 'Fact' AS from_table, 'Key' || s_nationkey AS from_column,
          'Dim ' || s_nationkey AS to_table, 'The ''Key''' AS to_column, CAST(NULL AS VARCHAR) AS cardinality, CAST(NULL AS VARCHAR) AS cross_filtering_behavior,
          CAST(NULL AS VARCHAR) AS security_filtering_behavior, true AS is_active FROM supplier
        UNION ALL SELECT 'sup' || s_suppkey, 'r' || s_suppkey || '-2', 'Fact', 'A', 'Dim', 'B', CASE WHEN s_suppkey % 3 = 0 THEN 'manyToMany' END, 'bothDirections', NULL, false
          FROM supplier WHERE s_suppkey % 4 <> 0""",
    "extract_model_header": """
        SELECT 'sup' || s_suppkey AS semantic_model_id, 'w' || s_nationkey AS workspace_id, s_name || '.SemanticModel' AS name,
          CASE WHEN s_suppkey % 2 = 0 THEN 'es-ES' ELSE 'en-US' END AS culture, 'powerBI_V3' AS data_source_version, CAST(NULL AS VARCHAR) AS source_query_culture,
          'true' AS legacy_redirects, CAST(s_nationkey AS VARCHAR) AS timeout, CAST(s_nationkey AS VARCHAR) AS region FROM supplier""",
    # extraction from report documents
    "extract_report_header": """
        SELECT 'r' || c_custkey AS report_id, 'Report ' || c_custkey AS name, 'pbir' AS report_format,
          CASE WHEN c_custkey % 2 = 0 THEN 'Model ' || c_nationkey ELSE 'ws' || c_nationkey END AS model_name,
          CASE WHEN c_custkey % 2 = 1 THEN 'abc-' || c_nationkey END AS semantic_model_reference, 'O' AS active_page_name FROM customer
        UNION ALL SELECT 'leg' || s_suppkey, s_name, 'legacy', NULL, NULL, 'Page 1' FROM supplier""",
    "extract_pages": """
        SELECT 'r' || c_custkey AS report_id, 'page' || c AS name, 'Page ' || c AS display_name, 720 AS height, 1280 AS width, c_custkey % 2 = 0 AS is_visible, i AS position
        FROM customer, (SELECT unnest(['P', 'O', 'F']) AS c, unnest([0, 1, 2]) AS i)""",
    "flatten_legacy_pages": """
        SELECT 'leg' || s_suppkey AS report_id, 'Page 1' AS name, 'First ' || s_suppkey AS display_name, 720 AS height, 1280 AS width, s_suppkey % 2 = 0 AS is_visible FROM supplier""",
    "extract_visuals": """
        SELECT report_id, page_name, visual_name AS name, o_orderstatus AS visual_type, (o_orderkey % 100) + 0.5::DOUBLE AS x, 10.0::DOUBLE AS y, 100.0::DOUBLE AS width, 300.0::DOUBLE AS height,
          o_orderpriority AS text_content FROM v_doc
        UNION ALL SELECT 'leg' || s_suppkey, 'Page 1', 'lv' || s_suppkey, 'card', s_suppkey + 0.25::DOUBLE, 2, 300, 100, NULL FROM supplier
        UNION ALL SELECT 'leg' || s_suppkey, 'Page 1', 'visual_1', NULL, 0, 0, 100, 100, NULL FROM supplier""",
    "extract_field_refs": f"""
        SELECT {_VISUAL}, kind, ref, CAST(n AS BIGINT) AS n FROM v_ref
        UNION ALL SELECT 'leg' || s_suppkey, 'Page 1', 'lv' || s_suppkey, 'column', 'Tab' || s_nationkey || '.Col' || (s_suppkey % 6), 1 FROM supplier
        UNION ALL SELECT 'leg' || s_suppkey, 'Page 1', 'lv' || s_suppkey, 'measure', 'Tab.Mes', 1 FROM supplier""",
    "resolve_alias": """
        SELECT report_id, page_name, visual_name, 'd' AS alias, 'Dim' || (o_custkey % 3) AS entity FROM v_doc
        UNION ALL SELECT 'leg' || s_suppkey, 'Page 1', 'lv' || s_suppkey, 'a', 'Tab' || s_nationkey FROM supplier""",
    "document_column_usage": f"""
        SELECT {_VISUAL}, split_part(ref, '.', 1) AS table_name, split_part(ref, '.', 2) AS column_name, CAST(n AS BIGINT) AS usage_count FROM v_ref WHERE kind = 'column'
        UNION ALL SELECT 'leg' || s_suppkey, 'Page 1', 'lv' || s_suppkey, 'Tab' || s_nationkey, 'Col' || (s_suppkey % 6), 1 FROM supplier""",
    "document_measure_usage": f"""
        SELECT {_VISUAL}, split_part(ref, '.', 1) AS table_name, split_part(ref, '.', 2) AS measure_name, CAST(n AS BIGINT) AS usage_count FROM v_ref WHERE kind = 'measure'
        UNION ALL SELECT 'leg' || s_suppkey, 'Page 1', 'lv' || s_suppkey, 'Tab', 'Mes', 1 FROM supplier""",
    "extract_filters": """
        SELECT 'r' || c_custkey AS report_id, 'report' AS level, CAST(NULL AS VARCHAR) AS page_name, CAST(NULL AS VARCHAR) AS visual_name, 'rf' AS filter_name,
          'Seg' AS table_name, c_mktsegment AS column_name, CAST(NULL AS VARCHAR) AS filter_description FROM customer
        UNION ALL SELECT report_id, 'visual', page_name, visual_name, 'f' || o_orderkey, 'E' || (o_custkey % 2), 'Flt',
          CASE o_orderkey % 4 WHEN 0 THEN 'Se incluyen valores en ''E' || (o_custkey % 2) || '''.''Flt''' WHEN 1 THEN 'Se excluyen valores en ''E' || (o_custkey % 2) || '''.''Flt'''
            WHEN 2 THEN 'Filtro de column where ''Flt'' es mayor o igual que' ELSE 'Condición desconocida en ''E' || (o_custkey % 2) || '''.''Flt''' END FROM v_doc
        UNION ALL SELECT 'leg' || s_suppkey, 'visual', 'Page 1', 'lv' || s_suppkey, 'lf', 'Tab', 'Mes', NULL FROM supplier""",
}


def oracles() -> dict[str, str]:
    return {name: sql(body) for name, body in BODIES.items()}
