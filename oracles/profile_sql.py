"""SQL for the user-facing queries."""

from oracles.identity_sql import BY_DIRECTION, CAT, DISPLAY, FIN, HIERARCHY, MT, RELATED, RESOLVED, SQL as ID_SQL
from oracles.scalar_sql import _BLANK, DOCS, canonical
from oracles.search_sql import ENRICH, HITS, NEAR
from oracles.series_sql import SQL as SERIES_SQL
from oracles.shared import LATEST, ALIASES, MIP, PE, PE_ONLY, measure_id, stitch

HEADS = """raw AS (SELECT measure_name, edition, measure_id, {portfolio} AS portfolio, agency, 0 AS p FROM mi UNION ALL SELECT measure_name, edition, measure_id, {portfolio}, agency, 1 FROM mp),
heads AS (SELECT measure_name, edition, any_value(measure_id) AS measure_id, array_to_string(list_sort(list(DISTINCT portfolio)), '|') AS portfolios,
  array_to_string(list_sort(list(DISTINCT coalesce(formal_name, agency))), '|') AS agencies, count(*) FILTER (p = 0) AS n_impacts, count(*) FILTER (p = 1) AS n_programs
  FROM raw LEFT JOIN disp USING (edition, agency) GROUP BY ALL)"""
RAW_HEADS = HEADS.format(portfolio="portfolio")
CANON_HEADS = HEADS.format(portfolio="replace(portfolio, '2017-18 PBS ', '')")
DOM = """tot AS (SELECT {k}, agency, CAST(sum(amount_thousands) AS BIGINT) AS total FROM mi GROUP BY ALL),
dom AS (SELECT * FROM tot QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY abs(total) DESC, agency) = 1)"""
IDS = """ids AS (SELECT measure_id, measure_name, edition FROM (SELECT measure_id, measure_name, edition, id, 0 AS s FROM mi UNION ALL SELECT measure_id, measure_name, edition, id, 1 FROM mp
  UNION ALL SELECT measure_id, measure_name, edition, id, 2 FROM mt) QUALIFY row_number() OVER (PARTITION BY measure_id ORDER BY s, id) = 1)"""

def _number(*key: str) -> str:
    return f"('0x' || substr(sha256(concat_ws('|', {', '.join(key)})), 1, 15))::BIGINT"


REQUEST = f"""rid AS (SELECT measure_id, {_number('measure_id')} AS n FROM (SELECT measure_id FROM mt UNION SELECT {measure_id('phrase', "'nowhere'")} FROM rel)),
req AS (SELECT measure_id, n AS position FROM rid UNION ALL SELECT measure_id, {_number('measure_id', "'again'")} FROM rid WHERE n % 10 = 0)"""

SQL = {
    "Q1_measure_heads": f"WITH {MIP}, {ALIASES}, {DISPLAY}, {RAW_HEADS} SELECT * FROM heads",
    "Q1_measure_impacts": f"""WITH {MIP}, {ALIASES}, {DISPLAY} SELECT measure_name, edition, portfolio, coalesce(formal_name, agency) AS agency, direction, fiscal_year, amount_thousands
  FROM mi LEFT JOIN disp USING (edition, agency)""",
    "Q1_measure_programs": f"""WITH {MIP}{PE_ONLY}, {ALIASES}, {DISPLAY}, {RESOLVED} SELECT measure_name, edition, measure_id, portfolio, coalesce(formal_name, agency) AS agency, direction,
  program_number, is_departmental, program_name, outcome_number, outcome_description FROM resolved LEFT JOIN disp USING (edition, agency)""",
    "Q2_program_profile": SERIES_SQL["A2_program_profile"] + " WHERE program_name IN ('Brand#1', 'Brand#12', 'Brand#20')",
    "Q3_estimate_history": f"""WITH {PE}, meta AS (SELECT program_name, outcome_number, outcome_description FROM pe QUALIFY row_number() OVER (PARTITION BY program_name
   ORDER BY edition = {LATEST} DESC, CASE WHEN edition = {LATEST} THEN id ELSE -id END) = 1),
p AS (SELECT program_name, edition, budget_year, fiscal_year, estimate_type, sum(amount_thousands) AS a FROM pe GROUP BY ALL),
v AS (SELECT program_name, edition, budget_year, string_agg(fiscal_year || ':' || estimate_type || ':' || CAST(a AS VARCHAR), ',' ORDER BY fiscal_year, estimate_type) AS series FROM p GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY program_name) AS c, row_number() OVER (PARTITION BY program_name ORDER BY budget_year, edition) - 1 AS i FROM v)
SELECT program_name, edition, budget_year, series, round(CASE WHEN c = 1 THEN 1.0 ELSE CAST(i AS DOUBLE) / (c - 1) END, 6) AS shade, outcome_number, outcome_description FROM n JOIN meta USING (program_name)""",
    "Q4_program_hierarchy": f"WITH {PE}, {ALIASES}, {DISPLAY}, {HIERARCHY} SELECT * FROM hier",
    "Q5_portfolio_profile": SERIES_SQL["A4_portfolio_profile"] + " WHERE budget_year = '2017-18'",
    "Q6_agency_outcome_profile": SERIES_SQL["A5_agency_outcome_profile"].replace("FROM mr),\nres", "FROM mr WHERE edition = '2018-19 Budget'),\nres"),
    "Q7_write_up_heads": f"""WITH {MT}, n AS (SELECT measure_id, count(*) AS n_components FROM comp GROUP BY ALL)
SELECT measure_id, measure_name, edition, portfolio, document_section, source_page, md5(full_measure_text) AS text_digest, n_components FROM mt LEFT JOIN n USING (measure_id)""",
    "Q7_write_up_related": ID_SQL["J6_related_measures"],
    "Q7_write_up_components": f"WITH {MT} SELECT measure_id, ordinal, level, marker, parent_ordinal, md5(text) AS digest FROM comp",
    "Q7_write_up_figures": f"""WITH {MT}, {FIN}, g AS (SELECT *, min(row_ordinal) OVER (PARTITION BY measure_id, impact_type, is_related, department_name) AS first_row FROM fin)
SELECT measure_id, CAST(dense_rank() OVER (PARTITION BY measure_id ORDER BY impact_type, is_related, first_row, department_name) AS INT) AS position, impact_type, is_related, department_name,
  CAST(row_number() OVER (PARTITION BY measure_id, impact_type, is_related, department_name ORDER BY row_ordinal, year_index) - 1 AS INT) AS value_no, CASE WHEN value_raw IN ('nfp', '..') THEN 'special' ELSE 'numeric' END AS value_kind,
  CASE WHEN value_raw = '-' THEN 0.0 ELSE TRY_CAST(replace(value_raw, ',', '') AS DOUBLE) END AS value_numeric_million, value_raw FROM g""",
    "Q8_measure_list": f"""WITH {MT}, {MIP}, {CAT} SELECT measure_name, edition, measure_id, CAST(to_json({{'portfolios': portfolios, 'agencies': agencies}}) AS VARCHAR) AS names, has_financial_data FROM cat""",
    "Q9_measure_by_id": f"WITH {MT}, {MIP}, {IDS} SELECT ids.* FROM ids JOIN mt ON mt.measure_id = ids.measure_id",
    "Q10_combined_measures": f"""WITH {MT}, {MIP}, {ALIASES}, {DISPLAY}, {RELATED}, {IDS}, {CANON_HEADS},
{REQUEST},
j AS (SELECT req.position, req.measure_id, ids.measure_name, ids.edition, heads.portfolios, heads.agencies, heads.n_impacts, heads.n_programs,
   (SELECT CASE WHEN mt.portfolio <> '' THEN {canonical('mt.portfolio')} ELSE '' END FROM mt WHERE mt.measure_name = ids.measure_name AND mt.edition = ids.edition) AS own
   FROM req LEFT JOIN ids USING (measure_id) LEFT JOIN heads ON heads.measure_name = ids.measure_name AND heads.edition = ids.edition)
SELECT position, measure_id, measure_name, edition, CASE WHEN measure_name IS NOT NULL THEN coalesce(portfolios, own) END AS portfolios, CASE WHEN measure_name IS NOT NULL THEN coalesce(agencies, '') END AS agencies,
  coalesce(n_impacts, 0) AS n_impacts, coalesce(n_programs, 0) AS n_programs, n_impacts IS NOT NULL AS has_financial_data, measure_name IS NULL AS not_found FROM j""",
    "Q10_combined_rows": f"""WITH {MT}, {MIP}{PE_ONLY}, {ALIASES}, {DISPLAY}, {RELATED}, {IDS}, {RESOLVED}, {REQUEST},
fnd AS (SELECT position, req.measure_id, ids.measure_name, ids.edition FROM req JOIN ids USING (measure_id)),
im AS (SELECT measure_name, edition, 'impact' AS kind, portfolio, coalesce(formal_name, agency) AS agency, direction, fiscal_year, amount_thousands, NULL AS program_number, NULL AS is_departmental,
  NULL AS program_name, NULL AS outcome_number, NULL AS outcome_description, CAST(row_number() OVER (PARTITION BY measure_name, edition ORDER BY id) AS INT) AS row_no FROM mi LEFT JOIN disp USING (edition, agency)),
pr AS (SELECT measure_name, edition, 'program' AS kind, portfolio, coalesce(formal_name, agency) AS agency, direction, NULL AS fiscal_year, NULL AS amount_thousands, program_number, is_departmental,
  program_name, outcome_number, outcome_description, CAST(row_number() OVER (PARTITION BY measure_name, edition ORDER BY id) AS INT) AS row_no FROM resolved LEFT JOIN disp USING (edition, agency))
SELECT fnd.position, fnd.measure_id, r.* FROM fnd JOIN (SELECT * FROM im UNION ALL SELECT * FROM pr) r USING (measure_name, edition)""",
    "Q11_measures_by_program": f"""WITH {MIP}{PE_ONLY}, {ALIASES}, {RESOLVED}, {DISPLAY}, {CANON_HEADS},
ix AS (SELECT DISTINCT program_name, replace(portfolio, '2017-18 PBS ', '') AS portfolio, measure_name, edition FROM resolved WHERE matched)
SELECT program_name, portfolio, measure_name, edition, measure_id, portfolios, agencies, n_impacts, n_programs FROM ix JOIN heads USING (measure_name, edition)""",
    "Q12_topic_search": f"""WITH {DOCS}, {MIP}, {NEAR}, top AS (SELECT query_id, rank, measure_name, edition, round(greatest(0, 1 - d / 2), 6) AS score, portfolio,
  regexp_replace(substr(text, 1, 180), '^{_BLANK}|{_BLANK}$', '', 'g') AS snippet FROM ranked LEFT JOIN docs ON doc_id = id WHERE rank <= 50),
a AS (SELECT measure_name, edition, CASE WHEN portfolio = '' THEN NULL ELSE {canonical('portfolio')} END AS portfolio, NULL AS agency, false AS f FROM top WHERE measure_name IS NOT NULL
  UNION ALL SELECT measure_name, edition, {canonical('portfolio')}, agency, true FROM mi UNION ALL SELECT measure_name, edition, {canonical('portfolio')}, agency, true FROM mp),
c AS (SELECT measure_name, edition, coalesce(array_to_string(list_sort(list(DISTINCT portfolio) FILTER (portfolio IS NOT NULL)), '|'), '') AS portfolios,
  coalesce(array_to_string(list_sort(list(DISTINCT agency) FILTER (agency IS NOT NULL)), '|'), '') AS agencies, bool_or(f) AS has_financial_data FROM a GROUP BY ALL)
SELECT query_id, rank, measure_name, edition, score, coalesce(snippet, '') AS snippet, coalesce(portfolios, '') AS portfolios, coalesce(agencies, '') AS agencies, coalesce(has_financial_data, false) AS has_financial_data FROM top LEFT JOIN c USING (measure_name, edition)""",
    "Q13_text_search": f"WITH {MT}, {MIP}, {CAT}, {HITS} " + ENRICH.format(extra="h.snippet", source="hits"),
    "Q15_combined_summary": f"WITH {MIP}, {DOM.format(k='edition')}, {BY_DIRECTION} SELECT mx.*, dom.agency, dom.total FROM mx JOIN dom USING (edition)",
    "Q15_program_matrix": f"""WITH {PE}, st AS ({stitch('pe', 'portfolio, program_name')})
SELECT portfolio, program_name, string_agg(fiscal_year || ':' || CAST(amount_thousands AS VARCHAR), ',' ORDER BY fiscal_year) AS figures FROM st GROUP BY ALL""",
    "Q16_overlay_agencies": f"""WITH {MIP}, {DOM.format(k='measure_name, edition')}, ev AS (SELECT measure_name, edition, agency FROM mp UNION SELECT measure_name, edition, agency FROM mi),
f AS (SELECT measure_name, edition, min(agency) AS first_agency FROM ev GROUP BY ALL)
SELECT ev.measure_name, ev.edition, ev.agency, ev.agency = coalesce(dom.agency, f.first_agency) AS is_default FROM ev JOIN f USING (measure_name, edition)
  LEFT JOIN dom ON dom.measure_name = ev.measure_name AND dom.edition = ev.edition""",
    "Q16_agency_overlay": f"""WITH {MIP}{PE_ONLY}, {ALIASES}, {RESOLVED}, {DOM.format(k='measure_name, edition')}, st AS ({stitch('pe', 'program_name')}),
f AS (SELECT *, min(CASE WHEN estimate_type <> 'estimated_actual' THEN fiscal_year END) OVER (PARTITION BY program_name) AS split,
         lead(fiscal_year) OVER (PARTITION BY program_name ORDER BY fiscal_year) AS nxt FROM st),
seg AS (SELECT program_name, fiscal_year, amount_thousands, split IS NULL OR fiscal_year < split AS solid, split IS NOT NULL AND (fiscal_year >= split OR coalesce(nxt >= split, false)) AS dashed FROM f)
SELECT DISTINCT r.measure_name, r.edition, r.agency, 'program' AS line_kind, seg.program_name AS label, fiscal_year, amount_thousands, solid, dashed
FROM resolved r JOIN dom USING (measure_name, edition, agency) JOIN seg ON seg.program_name = r.program_name
UNION ALL SELECT measure_name, edition, agency, 'measure', direction, fiscal_year, CAST(sum(amount_thousands) AS BIGINT), true, false FROM mi JOIN dom USING (measure_name, edition, agency) GROUP BY ALL""",
}
