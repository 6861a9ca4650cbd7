"""SQL for the column-function queries."""

from oracles.shared import BASE, EDITIONS, fy, measure_id
from vintagebook.functions.fixed import PORTFOLIO_FAMILIES, PORTFOLIO_NAMES
from vintagebook.plans.bindings import RAW_PORTFOLIOS

_BLANK = "[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+"
_Q = lambda s: "'" + s.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(_Q(v) for v in values) + "]"


DOCS = f"""
docs AS (
  SELECT doc_id, lang, source, text,
    CASE WHEN doc_id % 4 = 0 AND p_name IS NOT NULL THEN p_type || ' - ' || p_name ELSE source || ' - write-up ' || CAST(doc_id AS VARCHAR) END AS measure_name,
    {EDITIONS}[doc_id % len({EDITIONS}) + 1] AS edition,
    {array(RAW_PORTFOLIOS)}[CAST(replace(source, 'src', '') AS INT) % 20 + 1] AS portfolio,
    CASE lang WHEN 'en' THEN 'payment' WHEN 'fr' THEN 'receipt' ELSE 'capital' END AS document_section,
    CAST(doc_id % 300 + 1 AS INT) AS source_page, string_split(text, chr(10)) AS lines
  FROM documents LEFT JOIN part ON p_partkey = doc_id
)"""


def canonical(raw: str) -> str:
    bare = (
        f"regexp_replace(regexp_replace(regexp_replace(trim({raw}), '^\\d{{4}}-\\d{{2}}\\s+(PAES|PBS|MYEFO)\\s+', '', 'i'), '([A-Za-z])\\d+$', '\\1'), '\\s+', ' ', 'g')"
    )
    pairs = list(PORTFOLIO_NAMES.items())
    keys = "[" + ", ".join(_Q(v) for v, _ in pairs) + "]"
    names = "[" + ", ".join(_Q(n) for _, n in pairs) + "]"
    return (
        f"CASE WHEN {raw} IS NULL OR {raw} = '' THEN {raw} ELSE coalesce({names}[list_position({keys}, trim({bare}))], trim({bare})) END"
    )


FAMILY = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(portfolio), {_Q(k)})" for k in keys) + f" THEN {_Q(name)}" for name, keys in PORTFOLIO_FAMILIES
) + " ELSE portfolio END"
COMMAS = "format('{:,}', CAST(trunc(CAST(l_extendedprice AS DECIMAL(18,2))) AS BIGINT)) || '.' || split_part(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', 2)"
PLAIN = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)"
AMOUNT = f"CASE l_linenumber WHEN 1 THEN '(' || {COMMAS} || ')' WHEN 2 THEN 'nfp' WHEN 3 THEN '..' WHEN 4 THEN ' ' || {COMMAS} || chr(160) ELSE {PLAIN} END"
VALUE = "CASE WHEN l_linenumber IN (2, 3) THEN NULL WHEN l_linenumber = 1 THEN -CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) END"
ROUNDED = "CAST(round_even({v}, 0) AS BIGINT)"
DASH = "[' – ', ' — ', ' ‑ ', ' ─ ', ' ‐ '][p_size % 5 + 1]"
MARKS = "['', ' (a)', ' (b),(d)', chr(8203) || ' (abc) (d)'][p_size % 4 + 1]"
PRINTED = f"p_type || '’s' || {DASH} || p_name || {MARKS}"
SHIP = "CAST(year(l_shipdate) AS INT) + 20"
CLEAN_NAME = "p_type || '''s - ' || p_name"


def number_label(dollars: str) -> str:
    d = dollars
    return f"""CASE WHEN {d} >= 1000000000 THEN CAST(({d} + 5000000) // 10000000 // 100 AS VARCHAR) || '.' || lpad(CAST(({d} + 5000000) // 10000000 % 100 AS VARCHAR), 2, '0') || 'B'
 WHEN {d} >= 1000000 THEN CAST(({d} + 50000) // 100000 // 10 AS VARCHAR) || '.' || CAST(({d} + 50000) // 100000 % 10 AS VARCHAR) || 'M'
 WHEN {d} >= 1000 THEN CAST(({d} + 500) // 1000 AS VARCHAR) || 'K' ELSE CAST({d} AS VARCHAR) END"""


KINDS = ["Tables", "cleaned", "Portfolio Budget Statements", "PAES", "excel tables", "Statement"]
SHEETS = ["Table 1.2", "T_1.2", "2.1.2 Prog 1.2", "Program 1.2", "old 1.2", "1.1 Resources", "Table 1.2 Footnotes", "1.2.1", "program 1.1", "Prog Exp 1.2", "1.2 levies", "11.2"]
AMT = "CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(round(l_extendedprice) AS BIGINT) * [1, 100, 10000, 1][l_linenumber % 4 + 1] - 50000 END"

SQL = {
    "C1_squash": f"""WITH m AS (SELECT doc_id, trim(regexp_replace(replace(replace(replace(chr(160) || ' ' || replace(text, ' ', ' ' || chr(173) || chr(9)) || '_x000D_', chr(173), ' '), chr(160), ' '), '_x000D_', ' '), '{_BLANK}', ' ', 'g')) AS s FROM documents)
SELECT doc_id, md5(s) AS digest, CAST(length(s) AS INT) AS n FROM m""",
    "C2_clean_agency": f"""WITH p AS (SELECT l_linenumber, {fy(SHIP)} || ' PBS ' AS y, 'Agency ' || CAST(l_suppkey % 50 AS VARCHAR) AS a, {array(KINDS)}[l_linenumber % 6 + 1] AS k, l_suppkey FROM lineitem)
SELECT 'data/x/' || CASE WHEN l_linenumber = 7 THEN y || 'tables' ELSE y || replace(a, ' ', '_') || ' - ' || k END || '.xlsx' AS path,
  CASE WHEN l_linenumber = 7 THEN y || 'tables' ELSE a END AS agency, count(*) AS n FROM p GROUP BY ALL""",
    "C3_clean_portfolio_folder": """WITH p AS (SELECT ['2021-22 PBS ', '2022–23 pbs ', ''][l_linenumber % 3 + 1] AS pre, l_returnflag || ' & ' || l_linestatus AS s FROM lineitem)
SELECT pre || s AS folder, s AS portfolio, count(*) AS n FROM p GROUP BY ALL""",
    "C4_strip_portfolio_prefix": """WITH p AS (SELECT ['2021-22 PBS ', ' 2020-21 paes  ', '2023-24 MYEFO ', ''][l_linenumber % 4 + 1] AS pre, l_returnflag AS f,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE ' ' END AS post FROM lineitem)
SELECT pre || 'Brand  ' || f || post AS raw, 'Brand ' || f AS portfolio, count(*) AS n FROM p GROUP BY ALL""",
    "C5_canonical_portfolio": f"WITH {DOCS} SELECT portfolio AS raw, {canonical('portfolio')} AS portfolio, count(*) AS n FROM docs GROUP BY ALL",
    "C6_portfolio_family": f"WITH {DOCS} SELECT portfolio AS raw, {FAMILY} AS family, count(*) AS n FROM docs GROUP BY ALL",
    "C7_budget_year": f"""WITH p AS (SELECT {fy('CAST(year(o_orderdate) AS INT) + 20')} AS y, month(o_orderdate) = 1 AS mini FROM orders)
SELECT CASE WHEN mini THEN 'Mini update' ELSE 'Draft ' || y || ' Budget' END AS edition, CASE WHEN mini THEN 'Mini update' ELSE y END AS year,
  CASE WHEN mini THEN 'Mini update' ELSE y END AS built_year, count(*) AS n FROM p GROUP BY ALL""",
    "C8_fiscal_year": f"""WITH p AS (SELECT {SHIP} AS y, l_linenumber, l_returnflag = 'R' AS r FROM lineitem), q AS (
SELECT *, CAST((y + 1) % 100 AS VARCHAR) AS s FROM p)
SELECT CASE WHEN r THEN 'no year here' ELSE 'FY ' || CAST(y AS VARCHAR) || ['-', ' to ', '/' || chr(10)][l_linenumber % 3 + 1] || s || ' $''000' END AS cell,
  CASE WHEN NOT r THEN CAST(y AS VARCHAR) || '-' || s END AS fiscal_year, count(*) AS n FROM q GROUP BY ALL""",
    "C9_year_arithmetic": f"""SELECT {fy('CAST(year(o_orderdate) AS INT) + 20')} AS label, CAST(year(o_orderdate) AS INT) + 20 AS start, 2 AS gap, count(*) AS n FROM orders GROUP BY ALL""",
    "C10_to_amount": f"""WITH p AS (SELECT l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'R' THEN l_quantity + 0.5 ELSE {VALUE} END AS v FROM lineitem)
SELECT l_linenumber, l_returnflag, CAST(sum({ROUNDED.format(v='v')}) AS BIGINT) AS total, count(v) AS n_numbers, count(*) AS n FROM p GROUP BY ALL""",
    "C11_numeric_like": f"SELECT l_orderkey, l_partkey, l_linenumber, round({VALUE}, 2) AS number FROM lineitem",
    "C12_money_cell": f"""WITH p AS (SELECT *, CASE WHEN l_linenumber = 5 THEN '-' ELSE replace(replace({AMOUNT}, '(', '-'), ')', '') END AS raw FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber IN (2, 3, 4) THEN 'special' ELSE 'numeric' END AS value_kind,
  CASE WHEN l_linenumber = 5 THEN 0.0 WHEN l_linenumber = 4 THEN NULL ELSE {VALUE} END AS value_numeric_million, raw AS value_raw FROM p""",
    "C13_is_data_like": "SELECT l_linenumber, CAST(sum(CASE WHEN l_linenumber IN (1, 2, 3, 6) THEN 0 ELSE 1 END) AS BIGINT) AS n_data, count(*) AS n FROM lineitem GROUP BY ALL",
    "C14_canonical_measure_name": f"""SELECT {PRINTED} AS printed, {CLEAN_NAME} AS from_table,
  CASE p_size % 4 WHEN 2 THEN {CLEAN_NAME} || ' (b),' WHEN 3 THEN {CLEAN_NAME} || chr(8203) ELSE {CLEAN_NAME} END AS from_prose, count(*) AS n FROM part GROUP BY ALL""",
    "C15_phrase_key": f"SELECT lower({CLEAN_NAME} || {MARKS}) AS key, count(*) AS n FROM part GROUP BY ALL",
    "C16_clean_program_name": """SELECT p_name || [' (a)', '  (a) (b) ', ' (ab)', ''][p_size % 4 + 1] AS printed,
  CASE WHEN p_size % 4 = 2 THEN p_name || ' (ab)' ELSE p_name END AS name, count(*) AS n FROM part GROUP BY ALL""",
    "C17_direction_words": """WITH w AS (SELECT ['Receipts', 'REVENUE', 'payment', 'Expenses', 'Capital', 'Equity', 'Expense'][l_linenumber] AS word FROM lineitem)
SELECT word, CASE WHEN word IN ('Receipts', 'REVENUE') THEN 'receipt' WHEN word IN ('payment', 'Expenses', 'Expense') THEN 'payment' WHEN word = 'Capital' THEN 'capital' END AS direction,
  word IN ('Receipts', 'REVENUE') AS receipt_like, count(*) AS n FROM w GROUP BY ALL""",
    "C18_rejoin_drop_caps": """WITH p AS (SELECT upper(p_name) AS u, regexp_replace(upper(p_name), '\\b([A-Z])', '\\1 ', 'g') AS b FROM part)
SELECT b || ' -' || b AS heading, u || '-' || u AS joined, count(*) AS n FROM p GROUP BY ALL""",
    "C19_measure_id": f"WITH {DOCS} SELECT doc_id, {measure_id('measure_name', 'edition')} AS measure_id, {measure_id('measure_name', 'edition', 1)} AS salted_id FROM docs",
    "C20_snippet": f"""WITH h AS (SELECT doc_id, text, instr(lower(text), 'the and') AS p, length(text) AS n FROM documents),
s AS (SELECT *, greatest(0, p - 1 - 60) AS a, least(n, p - 1 + 7 + 60) AS z FROM h)
SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN a > 0 THEN '…' ELSE '' END || regexp_replace(substr(text, a + 1, z - a), '^{_BLANK}|{_BLANK}$', '', 'g') || CASE WHEN z < n THEN '…' ELSE '' END END AS snippet FROM s""",
    "C21_opening_excerpt": f"SELECT doc_id, regexp_replace(substr(text, 1, 180), '^{_BLANK}|{_BLANK}$', '', 'g') AS excerpt FROM documents",
    "C22_edition_order": f"""WITH {BASE} SELECT edition, order_year * 10 + CASE WHEN edition LIKE '%MYEFO' THEN 2 WHEN edition LIKE '%October%' THEN 1 ELSE 0 END AS sort_key, count(*) AS n FROM base GROUP BY ALL""",
    "C23_program_list": """WITH p AS (SELECT CAST(l_partkey % 9 + 1 AS VARCHAR) AS a, CAST(l_suppkey % 5 + 1 AS VARCHAR) AS c, l_linenumber AS t FROM lineitem)
SELECT CASE t WHEN 1 THEN a || '.' || c || ' & 2.3' WHEN 2 THEN a || '; ' || c WHEN 3 THEN 'All' WHEN 4 THEN a || '.0' WHEN 5 THEN a || '.' || c || ', 3.1' ELSE 'various' END AS cell,
  CASE t WHEN 1 THEN a || '.' || c || '|2.3' WHEN 2 THEN a || '|' || c WHEN 3 THEN '' WHEN 4 THEN a WHEN 5 THEN a || '.' || c || '|3.1' END AS programs, t > 5 AS is_label, count(*) AS n FROM p GROUP BY ALL""",
    "C24_departmental": """WITH p AS (SELECT CAST(l_suppkey % 7 AS VARCHAR) AS o, l_linenumber % 2 = 0 AS bare, l_linestatus = 'O' AS d FROM lineitem)
SELECT CASE WHEN bare THEN o ELSE o || '.1' END AS stated, d AS is_departmental, CASE WHEN NOT bare THEN o || '.1' WHEN d THEN o || '.0' ELSE o END AS number,
  'Departmental (Outcome ' || o || ')' AS label, count(*) AS n FROM p GROUP BY ALL""",
    "C25_formal_agency_name": """SELECT ' Table 1.1' || CASE WHEN s_suppkey % 2 = 0 THEN ': ' ELSE '  ' END || s_name || ' – ' || CASE WHEN s_suppkey % 3 = 0 THEN 'measures' ELSE ' Resource  statement 2016' END AS title,
  CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS formal_name, count(*) AS n FROM supplier GROUP BY ALL""",
    "C26_sheet_classes": f"""WITH s AS (SELECT l_partkey % 12 AS i, {array(SHEETS)}[l_partkey % 12 + 1] || ' ' || l_returnflag AS sheet FROM lineitem)
SELECT sheet, i IN (0, 1) AS is_measures, i = 5 AS is_resources, count(*) AS n FROM s GROUP BY ALL""",
    "C27_labels_of_money": f"""WITH p AS (SELECT l_orderkey, l_partkey, l_linenumber, {AMT} AS a FROM lineitem), q AS (SELECT *, abs(a) * 1000 AS d, (abs(a) + 50) // 100 AS t FROM p)
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN a < 0 THEN '-$' ELSE '$' END || {number_label('d')} AS dollars,
  CASE WHEN a = 0 THEN '-' ELSE CASE WHEN a < 0 THEN '-' ELSE '' END || format('{{:,}}', t // 10) || '.' || CAST(t % 10 AS VARCHAR) END AS millions FROM q""",
    "C27_short_label": f"""SELECT doc_id, CASE WHEN length(text) <= 55 THEN text ELSE regexp_replace(substr(text, 1, 55), '{_BLANK}$', '') || '…' END AS label,
  CASE WHEN length(source) <= 4 THEN source ELSE substr(source, 1, 4) || '…' END AS source_label FROM documents""",
    "C28_outcome_label": """SELECT p_size, CASE WHEN p_size % 3 = 2 THEN p_type ELSE 'Outcome ' || CAST(p_size AS VARCHAR) || ' (no description in source)' END AS label, count(*) AS n FROM part GROUP BY ALL""",
    "C29_placeholder_names": "SELECT p_size % 4 < 2 AS is_placeholder, count(*) AS n FROM part GROUP BY ALL",
    "C30_resolved_titles": """WITH r AS (SELECT user_id, event_id, event_type, event_id % 4 AS t, event_type <> 'error' AS s FROM events),
l AS (SELECT *, CASE t WHEN 0 THEN '– ' || event_type WHEN 1 THEN event_type || ': - first' WHEN 2 THEN '- second' ELSE event_type END AS label,
  CASE WHEN s AND t = 1 THEN event_type || ':' WHEN s AND t = 3 THEN event_type END AS h FROM r),
w AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM l)
SELECT user_id, event_id, label, CASE WHEN NOT s THEN NULL WHEN t IN (0, 2) AND p IS NOT NULL THEN p || ' ' || label ELSE label END AS title FROM w""",
    "C31_similarity": "SELECT l_orderkey, l_partkey, l_linenumber, round(greatest(0.0, 1 - l_quantity / 32), 6) AS score FROM lineitem",
    "T1_typed_header_cells": f"""WITH p AS (SELECT {fy(SHIP)} AS y, l_linenumber AS t FROM lineitem)
SELECT y || ' ' || ['Estimated' || chr(10) || 'actual', 'Budget $''000', 'Forward estimate', 'Revised budget', 'Actual', 'factual', 'estimate ' || repeat('x', 60)][t] AS cell,
  CASE WHEN t < 6 THEN y END AS fiscal_year, CASE WHEN t IN (1, 4, 5) THEN 'estimated_actual' WHEN t = 2 THEN 'budget' WHEN t = 3 THEN 'forward_estimate' END AS estimate_type, count(*) AS n FROM p GROUP BY ALL""",
}
