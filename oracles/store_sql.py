"""SQL for the discovery and store queries."""

from oracles.identity_sql import DUP, MT, PEF
from oracles.shared import ALIASES, BASE, PE

PATHS = BASE + """, files AS (SELECT DISTINCT edition, budget_year, r_name, short_name, l_suppkey, order_year,
  CASE WHEN order_year = 2017 THEN '2017-18 PBS ' ELSE '' END || r_name AS folder,
  CASE WHEN l_suppkey % 9 = 0 THEN '~$' ELSE '' END || budget_year || ' PBS ' || short_name || '-S' || CAST(l_suppkey AS VARCHAR) || ' tables.xlsx' AS name,
  short_name || ' S' || CAST(l_suppkey AS VARCHAR) AS agency FROM base),
ctx AS (SELECT 'data/' || edition || '/' || folder || '/' || name AS path, edition, r_name AS portfolio, agency, budget_year FROM files WHERE l_suppkey % 9 <> 0)"""
ALF = ALIASES.replace("formal_name, short_name, id FROM (", "formal_name, short_name, id, edition || '/' || r_name || '/' || short_name || '.xlsx' AS source_file FROM (", 1)
REBUILT = f"""WITH {PEF}, {ALF}, t AS (SELECT source_file, amount_thousands, edition IN ('2016-17 MYEFO', '2018-19 Budget') OR source_file IN (SELECT source_file FROM al WHERE formal_name LIKE '%Commission') AS hit FROM pe)
SELECT source_file, count(*) AS n, CAST(sum(amount_thousands + CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS total FROM t GROUP BY ALL"""
DOCUMENT = """doc AS (SELECT mt.measure_id AS id, mt.measure_name || CASE WHEN full_measure_text <> '' THEN chr(10) || full_measure_text ELSE '' END ||
   coalesce((SELECT chr(10) || string_agg(text, chr(10) ORDER BY ordinal) FROM comp WHERE comp.measure_id = mt.measure_id), '') AS document, measure_name, edition, coalesce(portfolio, '') AS portfolio FROM mt)"""

SQL = {
    "S1_discovered_workbooks": f"WITH {PATHS} SELECT * FROM ctx",
    "S3_borrowed_portfolios": f"""WITH {PATHS} SELECT path, budget_year, agency, coalesce((SELECT max(portfolio) FROM ctx o WHERE o.edition LIKE '%Budget' AND o.budget_year = ctx.budget_year AND o.agency = ctx.agency), '') AS portfolio
FROM ctx WHERE edition LIKE '%MYEFO'""",
    "S5_written_table": f"WITH {PE} SELECT edition, agency, count(*) AS n, CAST(sum(amount_thousands) AS BIGINT) AS total FROM pe GROUP BY ALL",
    "S6_child_tables": f"""WITH {MT}, l AS (SELECT measure_id, unnest(lines) AS t, CAST(generate_subscripts(lines, 1) - 1 AS INT) AS i FROM wu)
SELECT measure_id, 'figure' AS child, i AS row_ordinal, y AS year_index, CASE y WHEN 0 THEN CAST(length(t) AS VARCHAR) ELSE '1' END AS content FROM l, (VALUES (0), (1)) v(y)
UNION ALL SELECT measure_id, 'component', i, 0, md5(t) FROM l
UNION ALL SELECT measure_id, 'phrase', 0, 0, source || '.pdf' FROM wu UNION ALL SELECT measure_id, 'phrase', 1, 0, portfolio FROM wu""",
    "S7_rebuilt_subset": REBUILT,
    "S7_rebuilt_table": REBUILT,
    "S8_collection_actions": f"""WITH {MT} SELECT measure_id AS id, CASE CAST(measure_id AS BIGINT) % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'keep' END AS action FROM mt
UNION ALL SELECT 'old-' || measure_id, 'delete' FROM mt WHERE CAST(measure_id AS BIGINT) % 5 = 2""",
    "S8_reconciled_collection": f"WITH {MT}, {DOCUMENT} SELECT id, md5(document) AS digest FROM doc",
    "S9_assembled_documents": f"WITH {MT}, {DOCUMENT} SELECT id, md5(document) AS digest, length(document) AS n_chars, measure_name, edition, portfolio FROM doc",
    "S10_ingest_audit": f"""WITH {PEF}, {ALF}, r AS (SELECT * FROM pe), f AS (SELECT DISTINCT source_file FROM al), c AS (SELECT f.source_file, count(r.id) AS n FROM f LEFT JOIN r USING (source_file) GROUP BY ALL),
k AS (SELECT amount_thousands, first(amount_thousands) OVER (PARTITION BY {DUP} ORDER BY id) AS kept FROM r)
SELECT count(*) AS files_scanned, count(*) FILTER (n > 0) AS files_with_records, count(*) FILTER (n = 0) AS files_without_records, CAST(sum(n) AS BIGINT) AS rows,
  (SELECT count(*) FROM k WHERE amount_thousands <> kept) AS conflicting_duplicates FROM c""",
    "S10_files_without_records": f"WITH {PEF}, {ALF} SELECT DISTINCT source_file FROM al WHERE source_file NOT IN (SELECT source_file FROM pe)",
    "S11_isolated_errors": """WITH d AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.xlsx' AS source_file, len(string_split(text, chr(10))) AS n FROM documents)
SELECT source_file, CASE WHEN n < 2 THEN 0 ELSE n END AS n_cells, CASE WHEN n < 2 THEN 'ValueError(''a single line'')' END AS error FROM d""",
    "S12_append_and_count": f"WITH {MT} SELECT 3 * count(*) AS rows, count(*) AS first_append, count(*) AS second_append FROM mt",
}
