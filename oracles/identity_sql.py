"""SQL for the identity, measure and set queries."""

from oracles.scalar_sql import DOCS, canonical
from oracles.series_sql import SPELL
from oracles.shared import LATEST, ALIASES, BASE, MI, MIP, MR, PE, PE_ONLY, eord, measure_id

MT = f"""{DOCS}, wu AS (
  SELECT *, {measure_id('measure_name', 'edition')} AS measure_id FROM docs QUALIFY row_number() OVER (PARTITION BY measure_name, edition ORDER BY doc_id) = 1),
mt AS (SELECT measure_id, measure_name, edition, portfolio, document_section, source_page, doc_id AS id,
  coalesce((SELECT string_agg(t, chr(10) || chr(10) ORDER BY i) FROM (SELECT unnest(lines) AS t, generate_subscripts(lines, 1) - 1 AS i) WHERE trim(t) <> ''), '') AS full_measure_text FROM wu),
comp AS (SELECT measure_id, CAST(i AS INT) AS ordinal, CAST(i % 3 AS INT) AS level, ['text', 'dot', 'dash'][i % 3 + 1] AS marker,
  CASE WHEN i % 3 = 2 THEN CAST(i - 1 AS INT) END AS parent_ordinal, t AS text
  FROM (SELECT measure_id, unnest(lines) AS t, generate_subscripts(lines, 1) - 1 AS i FROM wu) WHERE trim(t) <> '')"""
RELATED = """rel AS (SELECT measure_id AS text_id, o AS ordinal, CASE WHEN o = 1 THEN 'Act ' || CAST(doc_id AS VARCHAR)
    WHEN p_size % 2 = 0 THEN upper(p_type) || ' – ' || upper(p_name) ELSE p_type || ' - ' || p_name END AS phrase
  FROM wu LEFT JOIN part ON p_partkey = doc_id, (VALUES (0), (1)) v(o) WHERE o = 1 OR p_partkey IS NOT NULL)"""
FIN = """fin AS (SELECT measure_id, CAST(i AS INT) AS row_ordinal, CASE WHEN i % 2 = 0 THEN 'Payment' ELSE 'Receipt' END AS impact_type, i % 4 = 3 AS is_related,
    'Department ' || CAST(length(t) % 6 AS VARCHAR) AS department_name, y AS year_index,
    CASE y WHEN 0 THEN CASE length(t) % 5 WHEN 0 THEN 'nfp' WHEN 1 THEN '-' ELSE CAST(length(t) AS VARCHAR) || '.5' END
           WHEN 1 THEN CASE WHEN length(t) % 7 = 0 THEN '..' ELSE '-' || CAST(length(t) * 2 AS VARCHAR) END
           ELSE '1,' || lpad(CAST(length(t) % 1000 AS VARCHAR), 3, '0') END AS value_raw
  FROM (SELECT measure_id, unnest(lines) AS t, generate_subscripts(lines, 1) - 1 AS i FROM wu), (VALUES (0), (1), (2)) v(y) WHERE trim(t) <> '')"""
NAMES = f"""names AS (SELECT DISTINCT measure_name, edition, measure_id FROM mt UNION SELECT DISTINCT measure_name, edition, measure_id FROM mi)"""
DIRECTORY = f"""dir AS (SELECT budget_year, agency, program_number, program_name, outcome_number, outcome_description FROM pe
  QUALIFY row_number() OVER (PARTITION BY budget_year, agency, program_number ORDER BY {eord('edition')} DESC, edition DESC, id DESC) = 1)"""
RESOLVED = f"""wanted AS (SELECT DISTINCT agency, portfolio FROM mp), {SPELL}, {DIRECTORY},
hit AS (SELECT mp.id, d.program_name, d.outcome_number, d.outcome_description FROM mp JOIN spelled s ON s.agency = mp.agency AND s.portfolio = mp.portfolio
  JOIN dir d ON d.budget_year = substr(mp.edition, 1, 7) AND d.agency = s.spelling AND d.program_number = mp.program_number
  QUALIFY row_number() OVER (PARTITION BY mp.id ORDER BY s.spelling <> mp.agency, s.spelling) = 1),
resolved AS (SELECT mp.*, CASE WHEN hit.id IS NOT NULL THEN hit.program_name WHEN is_departmental THEN 'Departmental (Outcome ' || split_part(program_number, '.', 1) || ')' END AS program_name,
  CASE WHEN hit.id IS NOT NULL THEN hit.outcome_number WHEN is_departmental THEN CAST(split_part(program_number, '.', 1) AS INT) END AS outcome_number,
  hit.outcome_description, hit.id IS NOT NULL AS matched FROM mp LEFT JOIN hit USING (id))"""
SPELL_CANON = SPELL.replace("a.portfolio = w.portfolio", "a.portfolio = replace(w.portfolio, '2017-18 PBS ', '')").replace("b.portfolio = w.portfolio", "b.portfolio = replace(w.portfolio, '2017-18 PBS ', '')")
DISPLAY = "disp AS (SELECT edition, short_name AS agency, arg_min(formal_name, id) AS formal_name FROM al GROUP BY ALL)"


def matrix(rows: str, key: str) -> str:
    """Common tables ``mx``: the rows (key columns, fiscal_year, amount) with all years of their edition as text."""
    return f"""cl AS ({rows}), yr AS (SELECT DISTINCT edition, fiscal_year FROM cl), ky AS (SELECT DISTINCT {key} FROM cl),
mx AS (SELECT {key}, string_agg(fiscal_year || ':' || CAST(coalesce(amount, 0) AS VARCHAR), ',' ORDER BY fiscal_year) AS figures
  FROM ky JOIN yr USING (edition) LEFT JOIN cl USING ({key}, fiscal_year) GROUP BY ALL)"""


BY_DIRECTION = matrix("SELECT edition, direction, fiscal_year, CAST(sum(amount_thousands) AS BIGINT) AS amount FROM mi GROUP BY ALL", "edition, direction")
DUP = "source_file, outcome_number, program_number, fiscal_year, estimate_type"
PEF = PE.replace("fiscal_year, estimate_type, amount_thousands\n", "fiscal_year, estimate_type, amount_thousands, edition || '/' || r_name || '/' || short_name || '.xlsx' AS source_file\n")
SEL = """sel AS (SELECT r_name AS portfolio, p_brand AS program_name, min(p_type) AS kind FROM base WHERE gap = 0 GROUP BY ALL),
itm AS (SELECT r_name AS portfolio, p_brand AS program_name, min(p_name) AS kind FROM base WHERE gap = 3 AND p_name LIKE '%ring%' GROUP BY ALL)"""
CAT = f"""allrows AS (SELECT measure_name, edition, measure_id, CASE WHEN portfolio = '' THEN NULL ELSE {canonical('portfolio')} END AS portfolio, NULL AS agency, 0 AS p, false AS f FROM mt
  UNION ALL SELECT measure_name, edition, measure_id, {canonical('portfolio')}, agency, 1, true FROM mi
  UNION ALL SELECT measure_name, edition, measure_id, {canonical('portfolio')}, agency, 2, true FROM mp),
cat AS (SELECT measure_name, edition, arg_max(measure_id, p) AS measure_id, coalesce(list_sort(list(DISTINCT portfolio) FILTER (portfolio IS NOT NULL)), []) AS portfolios,
  coalesce(list_sort(list(DISTINCT agency) FILTER (agency IS NOT NULL)), []) AS agencies, bool_or(f) AS has_financial_data FROM allrows GROUP BY ALL)"""
HIERARCHY = f"""hr AS (SELECT pe.*, coalesce(formal_name, pe.agency) AS shown FROM pe LEFT JOIN disp USING (edition, agency)),
hd AS (SELECT portfolio, shown, outcome_number, outcome_description FROM hr QUALIFY row_number() OVER (PARTITION BY portfolio, shown, outcome_number
   ORDER BY edition = {LATEST} DESC, CASE WHEN edition = {LATEST} THEN -id ELSE id END) = 1),
hier AS (SELECT DISTINCT portfolio, shown AS agency, outcome_number, hd.outcome_description, program_number, program_name
   FROM hr JOIN hd USING (portfolio, shown, outcome_number))"""

SQL = {
    "J1_same_year_alias": f"""WITH {MIP}, {ALIASES} SELECT substr(edition, 1, 7) AS budget_year, agency, coalesce((SELECT arg_max(short_name, id) FROM al
  WHERE al.budget_year = substr(mp.edition, 1, 7) AND lower(al.formal_name) = lower(mp.agency)), agency) AS resolved_agency, count(*) AS n FROM mp GROUP BY ALL""",
    "J2_agency_spellings": f"WITH {MIP}, {ALIASES}, wanted AS (SELECT DISTINCT agency, portfolio FROM mp), {SPELL} SELECT * FROM spelled",
    "J2_agency_spellings_canonical": f"WITH {MIP}, {ALIASES}, wanted AS (SELECT DISTINCT agency, portfolio FROM mp), {SPELL_CANON} SELECT * FROM spelled",
    "J3_display_agency": f"""WITH {PE}, {ALIASES}, {DISPLAY} SELECT edition, agency, coalesce(formal_name, agency) AS display_agency, CAST(sum(amount_thousands) AS BIGINT) AS total
  FROM pe LEFT JOIN disp USING (edition, agency) GROUP BY ALL""",
    "J4_resolved_programs": f"""WITH {MIP}{PE_ONLY}, {ALIASES}, {RESOLVED} SELECT measure_id, agency, direction, program_number, is_departmental, program_name, outcome_number, outcome_description FROM resolved""",
    "J5_program_reverse_index": f"""WITH {MIP}{PE_ONLY}, {ALIASES}, {RESOLVED} SELECT DISTINCT program_name, replace(portfolio, '2017-18 PBS ', '') AS portfolio, measure_name, edition FROM resolved WHERE matched""",
    "J6_related_measures": f"""WITH {MT}, {MI}, {RELATED}, {NAMES} SELECT rel.text_id, rel.ordinal, rel.phrase, n.measure_id, n.measure_name, n.edition
  FROM rel JOIN names n ON lower(n.measure_name) = lower(replace(rel.phrase, '–', '-')) QUALIFY row_number() OVER (PARTITION BY rel.text_id, rel.ordinal ORDER BY n.edition DESC, n.measure_id DESC, n.measure_name DESC) = 1""",
    "J7_measure_by_id": f"""WITH {MT}, {MIP}, a AS (SELECT measure_id, measure_name, edition, id, 0 AS source FROM mi UNION ALL SELECT measure_id, measure_name, edition, id, 1 FROM mp
  UNION ALL SELECT measure_id, measure_name, edition, id, 2 FROM mt) SELECT measure_id, measure_name, edition, source FROM a QUALIFY row_number() OVER (PARTITION BY measure_id ORDER BY source, id) = 1""",
    "J8_catalogue_keys": f"""WITH {MT}, {MIP}, a AS (SELECT measure_name, edition, 'text' AS s FROM mt UNION SELECT measure_name, edition, 'impacts' FROM mi UNION SELECT measure_name, edition, 'programs' FROM mp)
SELECT measure_name, edition, string_agg(s, '|' ORDER BY s) AS sources FROM a GROUP BY ALL""",
    "J10_components_of_measures": f"WITH {MT} SELECT comp.measure_id, measure_name, ordinal, level, marker, parent_ordinal, text FROM comp JOIN mt USING (measure_id)",
    "J11_tagged_programs": f"WITH {MIP} SELECT DISTINCT edition, agency, direction, program_number, program_number AS program_name, measure_id, measure_name FROM mp",
    "J13_source_coverage": f"""WITH {MT}, {MI}, k AS (SELECT DISTINCT measure_name, edition FROM mi) SELECT mt.edition, count(*) AS n_keys, count(k.edition) AS n_matched
  FROM (SELECT DISTINCT measure_name, edition FROM mt) mt LEFT JOIN k USING (measure_name, edition) GROUP BY ALL""",
    "J14_agency_portfolio": f"""WITH {MIP}, a AS (SELECT measure_name, edition, agency, portfolio, 0 AS s, id FROM mp UNION ALL SELECT measure_name, edition, agency, portfolio, 1, id FROM mi)
SELECT measure_name, edition, agency, portfolio FROM a QUALIFY row_number() OVER (PARTITION BY measure_name, edition, agency ORDER BY s, id) = 1""",
    "A6_combined_impacts": f"WITH {MI} SELECT edition, measure_name, portfolio, agency, direction, source_file, fiscal_year, amount_thousands FROM mi",
    "A7_programs_touched": f"WITH {MIP} SELECT edition, measure_name, portfolio, agency, direction, source_file, is_departmental, program_number FROM mp",
    "A8_catalogue": f"""WITH {MT}, {MIP}, {CAT} SELECT measure_name, edition, measure_id, array_to_string(portfolios, '|') AS portfolios, array_to_string(agencies, '|') AS agencies, has_financial_data FROM cat""",
    "A9_hierarchy": f"WITH {PE}, {ALIASES}, {DISPLAY}, {HIERARCHY} SELECT * FROM hier",
    "A10_conflicting_duplicates": f"""WITH {PEF}, k AS (SELECT {DUP}, id, amount_thousands, first(amount_thousands) OVER (PARTITION BY {DUP} ORDER BY id) AS kept_amount FROM pe)
SELECT {DUP}, id, amount_thousands AS dropped_amount, kept_amount FROM k WHERE amount_thousands <> kept_amount""",
    "W1_first_of_duplicates": f"WITH {PEF} SELECT {DUP}, id, amount_thousands FROM pe QUALIFY row_number() OVER (PARTITION BY {DUP} ORDER BY id) = 1",
    "A12_direction_totals": f"WITH {MI} SELECT measure_name, edition, fiscal_year, direction, CAST(sum(amount_thousands) AS BIGINT) AS amount_thousands FROM mi GROUP BY ALL",
    "A13_impact_matrix": f"""WITH {MI}, {matrix("SELECT edition, direction, agency, false AS is_total, fiscal_year, CAST(sum(amount_thousands) AS BIGINT) AS amount FROM mi GROUP BY ALL UNION ALL "
        "SELECT edition, direction, 'Total', true, fiscal_year, CAST(sum(amount_thousands) AS BIGINT) FROM mi GROUP BY ALL", "edition, direction, agency, is_total")} SELECT * FROM mx""",
    "A14_combined_matrix": f"WITH {MI}, {BY_DIRECTION} SELECT * FROM mx",
    "A14_net_totals": f"""WITH {MI} SELECT measure_id, measure_name, edition, CAST(sum(amount_thousands) AS BIGINT) AS net_total,
  CAST(coalesce(sum(amount_thousands) FILTER (direction = 'payment'), 0) AS BIGINT) AS payment_total, CAST(coalesce(sum(amount_thousands) FILTER (direction = 'receipt'), 0) AS BIGINT) AS receipt_total FROM mi GROUP BY ALL""",
    "A15_dominant_agency": f"""WITH {MI}, t AS (SELECT measure_name, edition, agency, CAST(sum(amount_thousands) AS BIGINT) AS total FROM mi GROUP BY ALL)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY measure_name, edition ORDER BY abs(total) DESC, agency) = 1""",
    "A16_merged_programs": f"""WITH {MIP} SELECT edition, agency, direction, program_number, 'Program ' || program_number AS program_name,
  string_agg(DISTINCT CASE WHEN is_departmental THEN 'Departmental' ELSE 'Administered' END, '|' ORDER BY CASE WHEN is_departmental THEN 'Departmental' ELSE 'Administered' END) AS channels,
  count(DISTINCT measure_id) AS touched_by, min(portfolio) AS portfolio FROM mp GROUP BY edition, agency, direction, program_number""",
    "A16_programs_by_agency": f"""WITH {MIP}, g AS (SELECT edition, agency, direction, program_number, 'Program ' || program_number AS program_name,
  string_agg(DISTINCT CASE WHEN is_departmental THEN 'Departmental' ELSE 'Administered' END, '+' ORDER BY CASE WHEN is_departmental THEN 'Departmental' ELSE 'Administered' END) AS channels,
  count(DISTINCT measure_id) AS touched_by, min(portfolio) AS portfolio FROM mp GROUP BY edition, agency, direction, program_number)
SELECT edition, agency, min(portfolio) OVER (PARTITION BY edition, agency) AS portfolio, CAST(row_number() OVER (PARTITION BY edition, agency ORDER BY program_name, program_number, direction) AS INT) AS place,
  program_name, program_number, direction, channels, touched_by FROM g""",
    "A17_grouped_financials": f"""WITH {MT}, {FIN} SELECT measure_id, impact_type, is_related, department_name, min(row_ordinal) AS first_row,
  string_agg(CAST(row_ordinal AS VARCHAR) || ':' || CAST(year_index AS VARCHAR) || ':' || CASE WHEN value_raw IN ('nfp', '..') THEN 'special' ELSE 'numeric' END || ':' || value_raw, ';' ORDER BY row_ordinal, year_index) AS "values" FROM fin GROUP BY ALL""",
    "A22_reconciliation": f"""WITH {PEF}, s AS (SELECT source_file, CAST(sum(amount_thousands) AS BIGINT) AS parsed_total, CAST(sum(amount_thousands) FILTER (estimate_type <> 'forward_estimate') AS BIGINT) AS printed_total FROM pe GROUP BY ALL)
SELECT *, parsed_total - coalesce(printed_total, 0) AS difference FROM s""",
    "F1_equality_filters": f"WITH {PE} SELECT agency, count(*) AS n, CAST(sum(amount_thousands) AS BIGINT) AS total FROM pe WHERE portfolio = 'ASIA' AND budget_year = '2016-17' GROUP BY ALL",
    "F2_membership": f"WITH {PE}, {ALIASES} SELECT agency, count(*) AS n FROM pe WHERE agency IN (SELECT short_name FROM al WHERE formal_name LIKE '%Commission') GROUP BY ALL",
    "F3_case_insensitive_equality": f"WITH {MI}, {ALIASES} SELECT agency, count(*) AS n FROM mi WHERE lower(agency) IN (SELECT lower(formal_name) FROM al) GROUP BY ALL",
    "F5_agency_filters": f"""WITH {PE} SELECT agency, 'pattern' AS how, count(*) AS n FROM pe WHERE regexp_matches(lower(agency), 'oct n1|n2$') GROUP BY ALL
UNION ALL SELECT agency, 'exact', count(*) FROM pe WHERE agency IN ('N7', 'OCT N7') GROUP BY ALL UNION ALL SELECT DISTINCT agency, 'label', 0 FROM pe WHERE agency LIKE '%N3%'""",
    "F8_known_measures": f"WITH {MT}, {MIP} SELECT measure_id, measure_name, edition FROM mt WHERE (measure_name, edition) IN (SELECT (measure_name, edition) FROM mi UNION SELECT (measure_name, edition) FROM mp)",
    "F9_not_found": f"""WITH {MT}, {MIP}, {RELATED}, r AS (SELECT DISTINCT {measure_id('phrase', "'2018-19 Budget'")} AS measure_id FROM rel)
SELECT measure_id FROM r WHERE measure_id NOT IN (SELECT measure_id FROM mi UNION SELECT measure_id FROM mp UNION SELECT measure_id FROM mt)""",
    "U1_union_of_keys": f"WITH {MT}, {MIP} SELECT measure_name, edition FROM mi UNION SELECT measure_name, edition FROM mp UNION SELECT measure_name, edition FROM mt",
    "U2_union_of_agencies": f"WITH {MIP}{PE_ONLY} SELECT agency, portfolio FROM mi UNION SELECT agency, portfolio FROM mp UNION SELECT agency, portfolio FROM pe",
    "U3_stale_keys": f"WITH {MT}, {MI} SELECT measure_name, edition FROM mt EXCEPT SELECT measure_name, edition FROM mi",
    "U4_add_to_selection": f"WITH {BASE}, {SEL} SELECT * FROM sel UNION ALL SELECT * FROM itm WHERE (portfolio, program_name) NOT IN (SELECT (portfolio, program_name) FROM sel)",
    "U4_remove_from_selection": f"WITH {BASE}, {SEL} SELECT * FROM sel WHERE (portfolio, program_name) NOT IN (SELECT (portfolio, program_name) FROM itm)",
    "U4_toggle_selection": f"""WITH {BASE}, {SEL} SELECT * FROM sel WHERE (portfolio, program_name) NOT IN (SELECT (portfolio, program_name) FROM itm)
UNION ALL SELECT * FROM itm WHERE (portfolio, program_name) NOT IN (SELECT (portfolio, program_name) FROM sel)""",
    "U5_assigned_ids": f"WITH {MR} SELECT DISTINCT measure_name, edition, {measure_id('measure_name', 'edition')} AS measure_id, 0 AS salt FROM mr",
    "U5_assigned_ids_seeded": f"""WITH {MR}, {MT}, k AS (SELECT measure_name, edition FROM mr UNION SELECT measure_name, edition FROM mt)
SELECT measure_name, edition, {measure_id('measure_name', 'edition')} AS measure_id, 0 AS salt FROM k""",
    "U5_assigned_ids_crowded": f"""WITH RECURSIVE {DOCS}, k AS MATERIALIZED (SELECT measure_name AS n, edition AS e, row_number() OVER (ORDER BY edition, measure_name) AS i,
    (SELECT count(*) * 5 // 4 + 1 FROM (SELECT DISTINCT measure_name, edition FROM docs)) AS space FROM (SELECT DISTINCT measure_name, edition FROM docs)),
c AS MATERIALIZED (SELECT *, list_transform(range(0, 300), lambda x: lpad(CAST(('0x' || substr(sha256(n || chr(31) || e || chr(31) || CAST(x AS VARCHAR)), 1, 12))::BIGINT % space AS VARCHAR), 8, '0')) AS ids FROM k),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS n, CAST('' AS VARCHAR) AS e, CAST('' AS VARCHAR) AS id, CAST([] AS VARCHAR[]) AS taken
  UNION ALL SELECT c.i, c.n, c.e, f.id, list_append(s.taken, f.id) FROM s JOIN c ON c.i = s.i + 1, LATERAL (SELECT list_filter(c.ids, lambda y: NOT list_contains(s.taken, y))[1] AS id) f)
SELECT n AS measure_name, e AS edition, id AS measure_id FROM s WHERE i > 0""",
    "P7_canonical_join": f"""WITH {MIP}{PE_ONLY}, {ALIASES}, {RESOLVED.replace(SPELL, SPELL_CANON)} SELECT replace(portfolio, '2017-18 PBS ', '') AS portfolio, program_name, count(*) AS n FROM resolved GROUP BY ALL""",
}
SQL["J5_refreshed_index"] = SQL["J5_program_reverse_index"]
