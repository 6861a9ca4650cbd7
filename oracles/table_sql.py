"""SQL for the sheet-reading queries: what the facts say the sheets must contain."""

from oracles.shared import BASE, fy

FACTS = BASE + """, wb AS (
  SELECT *, edition || '/' || r_name || '/' || short_name || ' S' || CAST(l_suppkey AS VARCHAR) || '.xlsx' AS source_file, l_suppkey AS supplier,
         l_suppkey % 5 AS v, l_suppkey // 5 % 3 AS h FROM (SELECT * REPLACE (greatest(-1, least(3, gap)) AS gap) FROM base)
), prog AS (
  SELECT source_file, order_year, supplier, v, h, outcome_number AS k, brand AS b, gap, CAST(sum(amount_thousands) AS BIGINT) AS a FROM wb GROUP BY ALL
), sheet AS (
  SELECT source_file, order_year, supplier, v, h, outcome_number AS k, count(DISTINCT brand) AS n, lower(min(p_type)) AS kind,
         v = 0 AND outcome_number = 5 AND supplier // 5 % 2 = 0 AS unheaded,
         CASE WHEN v = 2 THEN 'Outcome ' || CAST(outcome_number AS VARCHAR) ELSE 'Table 2.' || CAST(outcome_number AS VARCHAR) || '.1' END AS sheet_name
  FROM wb GROUP BY ALL
), mapped AS (SELECT *, NOT unheaded OR EXISTS (SELECT 1 FROM sheet o WHERE o.source_file = sheet.source_file AND NOT o.unheaded) AS has_columns FROM sheet)"""
GAPS = "(VALUES (-1, 'estimated_actual'), (0, 'budget'), (1, 'forward_estimate'), (2, 'forward_estimate'), (3, 'forward_estimate')) g(gap, etype)"
YEAR = fy("order_year + gap")
LINES = BASE + """, wb AS (
  SELECT *, edition || '/' || r_name || '/' || short_name || ' S' || CAST(l_suppkey AS VARCHAR) || '.xlsx' AS source_file,
         short_name || ' S' || CAST(l_suppkey AS VARCHAR) AS own, p_type || ' - ' || p_name AS measure,
         CASE WHEN l_returnflag = 'R' THEN 'receipt' ELSE 'payment' END AS direction, l_linestatus = 'O' AS dep FROM (SELECT * REPLACE (greatest(-1, least(3, gap)) AS gap) FROM base)
), ln AS (
  SELECT source_file, own, order_year, n_name, p_name, direction, measure, dep,
         CASE WHEN dep THEN CAST(outcome_number AS VARCHAR) ELSE CAST(outcome_number AS VARCHAR) || '.' || CAST(brand AS VARCHAR) END AS code,
         list_value(%s) AS amounts FROM wb GROUP BY ALL
), nl AS (
  SELECT *, row_number() OVER (PARTITION BY source_file, direction, measure ORDER BY dep, code) AS i FROM ln
), rec AS (
  SELECT source_file, measure AS measure_name, CASE WHEN length(p_name) %% 3 <> 0 THEN 'Department of ' || n_name ELSE own END AS agency, direction,
         CASE WHEN dep THEN code || '.0' WHEN i = 1 THEN regexp_replace(code, '0$', '') ELSE code END AS programs, dep AS is_departmental, order_year, gap, amounts[gap + 2] AS amount_thousands
  FROM nl, (VALUES (-1), (0), (1), (2), (3)) g(gap)
)""" % ", ".join(f"CAST(coalesce(sum(amount_thousands) FILTER (gap = {g}), 0) AS BIGINT)" for g in (-1, 0, 1, 2, 3))
CODE = "CAST(k AS VARCHAR) || '.' || CAST(b AS VARCHAR)"
RECORDS = f"""
SELECT source_file, outcome_number, program_number, fiscal_year, estimate_type, outcome_description, program_name, amount_thousands FROM (
  SELECT prog.source_file, prog.k AS outcome_number, CAST(prog.k AS VARCHAR) || '.' || CAST(b AS VARCHAR) AS program_number, {fy('prog.order_year + gap')} AS fiscal_year,
    CASE gap WHEN -1 THEN 'estimated_actual' WHEN 0 THEN 'budget' ELSE 'forward_estimate' END AS estimate_type, 'Deliver ' || kind AS outcome_description,
    'Brand#' || CAST(b AS VARCHAR) AS program_name, a AS amount_thousands
  FROM prog JOIN mapped USING (source_file, k) WHERE has_columns AND NOT (n > 1 AND b % 7 = 0 AND gap = 3))"""

BUDGET_YEAR = "substr(split_part(source_file, '/', 1), 1, 7)"
AGENCY = "replace(split_part(source_file, '/', 3), '.xlsx', '')"

SQL = {
    "S13_built_agency_aliases": f"""WITH {FACTS} SELECT DISTINCT edition, budget_year, r_name AS portfolio, n_name || ' Authority' AS formal_name, {AGENCY} AS short_name, source_file
FROM wb WHERE supplier % 7 <> 0""",
    "S14_built_program_expenses": f"""WITH {FACTS}, rec AS ({RECORDS}) SELECT split_part(source_file, '/', 1) AS edition, {BUDGET_YEAR} AS budget_year, split_part(source_file, '/', 2) AS portfolio,
  {AGENCY} AS agency, rec.*, s.sheet_name FROM rec JOIN (SELECT source_file, k AS outcome_number, sheet_name FROM sheet) s USING (source_file, outcome_number)""",
    "S2_sheet_cells": f"""WITH {FACTS}, r AS (SELECT source_file, 'Table 1.1' AS sheet_name, k AS row_idx, NULL::BIGINT AS num FROM sheet WHERE v = 3
  UNION ALL SELECT s.source_file, s.sheet_name, x.row_idx, NULL FROM sheet s, (VALUES (0), (1), (60), (61), (62), (63)) x(row_idx) WHERE NOT (row_idx = 1 AND v = 3)
  UNION ALL SELECT source_file, sheet_name, 63, 1 FROM sheet, {GAPS}
  UNION ALL SELECT source_file, sheet_name, x.row_idx, NULL FROM sheet, {GAPS}, (VALUES (2), (3), (4)) x(row_idx) WHERE NOT unheaded AND (h = 1 OR row_idx = 3)
  UNION ALL SELECT prog.source_file, sheet_name, 60, CAST(sum(a) AS BIGINT) FROM prog JOIN sheet USING (source_file, k) GROUP BY prog.source_file, sheet_name, gap
  UNION ALL SELECT DISTINCT prog.source_file, sheet_name, b * 2 + 5, NULL FROM prog JOIN sheet USING (source_file, k)
  UNION ALL SELECT DISTINCT prog.source_file, sheet_name, b * 2 + 6, NULL FROM prog JOIN sheet USING (source_file, k) WHERE n > 1
  UNION ALL SELECT prog.source_file, sheet_name, b * 2 + 6, CASE WHEN b % 2 = 1 AND NOT (b % 7 = 0 AND gap = 3) THEN a END FROM prog JOIN sheet USING (source_file, k) WHERE n > 1)
SELECT source_file, sheet_name, count(*) AS n_cells, max(row_idx) AS last_row, CAST(sum(num) AS BIGINT) AS num_total FROM r GROUP BY ALL""",
    "T2_header_windows": f"""WITH {FACTS} SELECT source_file, sheet_name, CASE WHEN h = 1 THEN 4 ELSE 3 END AS header_row,
  string_agg(CAST(gap + 2 AS VARCHAR) || ':' || CASE WHEN h = 2 AND gap = 3 THEN CAST(order_year + 3 AS VARCHAR) || '-' || substr(CAST(order_year + 3 AS VARCHAR), 3, 2) ELSE {YEAR} END || ':' || etype, '|' ORDER BY gap) AS columns
FROM sheet, {GAPS} WHERE NOT unheaded GROUP BY ALL""",
    "T3_repaired_years": f"WITH {FACTS} SELECT source_file, sheet_name, gap + 2 AS col_idx, {YEAR} AS fiscal_year, etype AS estimate_type FROM sheet, {GAPS} WHERE NOT unheaded",
    "T4_borrowed_columns": f"""WITH {FACTS} SELECT source_file, sheet_name, unheaded AS is_borrowed, CASE WHEN has_columns THEN 5 ELSE 0 END AS n_columns FROM mapped
UNION ALL SELECT DISTINCT source_file, 'Table 1.1', true, 5 FROM sheet WHERE v = 3""",
    "T5_outcome_consensus": f"WITH {FACTS} SELECT source_file, sheet_name, k AS outcome_number, 'Deliver ' || kind AS outcome_description FROM sheet",
    "T6_outcome_names": f"WITH {FACTS} SELECT source_file, k AS outcome_number, 'Deliver ' || kind AS outcome_name FROM sheet",
    "T7_program_of_total_row": f"""WITH {FACTS} SELECT DISTINCT prog.source_file, sheet_name, b * 2 + 6 AS row_idx, CAST(prog.k AS VARCHAR) || '.' || CAST(b AS VARCHAR) AS program_number
FROM prog JOIN mapped USING (source_file, k) WHERE n > 1 AND has_columns""",
    "T8_single_program_totals": f"""WITH {FACTS} SELECT DISTINCT prog.source_file, sheet_name, 60 AS row_idx, CAST(prog.k AS VARCHAR) || '.' || CAST(b AS VARCHAR) AS program_number
FROM prog JOIN mapped USING (source_file, k) WHERE n = 1""",
    "T9_program_records": f"WITH {FACTS} {RECORDS}",
    "T10_year_columns": f"""WITH {LINES}, f AS (SELECT DISTINCT source_file, order_year FROM ln) SELECT source_file, 'Table 1.2' AS sheet_name,
  string_agg(CAST(gap + 3 AS VARCHAR) || ':' || {YEAR}, '|' ORDER BY gap) AS years FROM f, {GAPS} GROUP BY ALL""",
    "T11_row_classes": f"""WITH {LINES}, d AS (SELECT DISTINCT source_file, direction FROM ln), m AS (SELECT DISTINCT source_file, direction, measure, p_name FROM ln),
c AS (SELECT source_file, unnest(['header', 'title', 'part']) AS row_class, 1 AS n FROM (SELECT DISTINCT source_file FROM ln)
  UNION ALL SELECT source_file, unnest(['section', 'grand_total', 'category']), 1 FROM d UNION ALL SELECT source_file, unnest(['text', 'total']), 1 FROM m
  UNION ALL SELECT source_file, 'text', 1 FROM m WHERE length(p_name) % 3 <> 0 UNION ALL SELECT source_file, CASE WHEN i > 1 AND NOT dep THEN 'bare_program' ELSE 'category' END, 1 FROM nl)
SELECT source_file, row_class, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL""",
    "T12_measure_records": f"WITH {LINES} SELECT source_file, measure_name, agency, direction, programs, is_departmental, {YEAR} AS fiscal_year, amount_thousands FROM rec",
    "T12_impacts_of_sheets": f"""WITH {LINES} SELECT source_file, measure_name, agency, direction, {YEAR} AS fiscal_year, CAST(sum(amount_thousands) AS BIGINT) AS amount_thousands FROM rec GROUP BY ALL""",
    "T12_programs_of_sheets": f"WITH {LINES} SELECT DISTINCT source_file, measure_name, agency, direction, is_departmental, programs AS program_number FROM rec",
    "T13_sparse_totals": f"""WITH {LINES}, t AS (SELECT source_file, count(DISTINCT direction) + count(*) FILTER (NOT (i > 1 AND NOT dep)) AS n_category,
   count(DISTINCT direction) + count(DISTINCT direction || measure) AS n_total FROM nl GROUP BY ALL)
SELECT source_file, 'Table 1.2' AS sheet_name, n_category, n_total, n_category >= 5 AND n_total / n_category < 0.2 AS sparse FROM t""",
    "T14_table_titles": f"WITH {LINES} SELECT DISTINCT source_file, 'Table 1.2' AS sheet_name, 'Table 1.2: ' || split_part(source_file, '/', 1) || ' Measures' AS title, true AS is_measures FROM ln",
    "A22_reconciled_sheets": f"""WITH {LINES} SELECT source_file, direction, CAST(sum(amount_thousands) AS BIGINT) AS parsed_total, CAST(sum(amount_thousands) AS BIGINT) AS printed_total, 0 AS difference
FROM rec GROUP BY ALL""",
}
