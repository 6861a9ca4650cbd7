"""SQL for the series queries."""

from oracles.shared import LATEST, ALIASES, MI, MR, PE, PE_ONLY, eord, stitch

SLICE = "NOT (edition = '2016-17 October Budget' AND fiscal_year = '2015-16')"
SPELL = """
spelled AS (
  SELECT DISTINCT agency, portfolio, spelling FROM (
    SELECT w.agency, w.portfolio, w.agency AS spelling FROM wanted w
    UNION ALL
    SELECT w.agency, w.portfolio, b.short_name FROM wanted w
    JOIN al a ON a.portfolio = w.portfolio AND (a.short_name = w.agency OR lower(a.formal_name) = lower(w.agency))
    JOIN al b ON b.portfolio = w.portfolio AND b.formal_name = a.formal_name)
)"""
CLEAN = f"""
clean AS (
  SELECT portfolio AS portfolio_key, program_name, program_number, fiscal_year, edition, budget_year, agency, outcome_number,
         outcome_description, amount_thousands, id, gap, outcome_description AS outcome_label FROM (
    SELECT *, CAST(substr(budget_year, 1, 4) AS INT) - CAST(substr(fiscal_year, 1, 4) AS INT) AS gap,
      row_number() OVER (PARTITION BY portfolio, program_name, program_number, fiscal_year ORDER BY
        CAST(substr(budget_year, 1, 4) AS INT) - CAST(substr(fiscal_year, 1, 4) AS INT), {eord('edition')} DESC, edition DESC, id) AS rn
    FROM pe WHERE estimate_type = 'estimated_actual' AND {SLICE})
  WHERE rn = 1
)"""


def top(source: str, label: str, n: int, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""
SELECT {keys}fiscal_year, CASE WHEN rk <= {n} THEN {label} ELSE 'Other' END AS label_group, CAST(sum(amount_thousands) AS BIGINT) AS amount_thousands
FROM {source} JOIN (SELECT {keys}{label}, row_number() OVER ({part} ORDER BY sum(amount_thousands) DESC, {label}) AS rk
      FROM {source} GROUP BY {keys}{label}) USING ({keys}{label})
GROUP BY ALL"""


SQL = {
    "A1_stitched_series": f"WITH {PE} {stitch('pe', 'program_name')}",
    "A1_stitched_series_per_agency_outcome": f"WITH {PE} {stitch('pe', 'portfolio, agency, outcome_number, program_name')}",
    "A1_stitched_series_prefer_earliest": f"WITH {PE} {stitch('pe', 'program_name', earliest=True)}",
    "A2_program_profile": f"""WITH {PE}, st AS ({stitch('pe', 'program_name')}), meta AS (
  SELECT * FROM (SELECT program_name, outcome_number, outcome_description, row_number() OVER (PARTITION BY program_name ORDER BY
     CASE WHEN edition = {LATEST} THEN 0 ELSE 1 END, CASE WHEN edition = {LATEST} THEN id ELSE -id END) AS rn FROM pe) WHERE rn = 1)
SELECT st.*, outcome_number, outcome_description FROM st JOIN meta USING (program_name)""",
    "A3_vintage_history": f"""WITH {PE}, p AS (SELECT program_name, edition, budget_year, fiscal_year, estimate_type, sum(amount_thousands) AS a FROM pe GROUP BY ALL)
SELECT program_name, edition, budget_year,
  string_agg(fiscal_year || ':' || estimate_type || ':' || CAST(a AS VARCHAR), ',' ORDER BY fiscal_year, estimate_type) AS series FROM p GROUP BY ALL""",
    "A3_actual_series": f"""WITH {PE}, p AS (SELECT program_name, fiscal_year, edition, CAST(sum(amount_thousands) AS BIGINT) AS amount_thousands
  FROM pe WHERE estimate_type = 'estimated_actual' GROUP BY ALL)
SELECT program_name, fiscal_year, edition, amount_thousands FROM p
QUALIFY row_number() OVER (PARTITION BY program_name, fiscal_year ORDER BY {eord('edition')} DESC, edition DESC) = 1""",
    "A4_portfolio_profile": f"""WITH {PE}, {ALIASES}, snap AS (SELECT DISTINCT portfolio, budget_year, agency FROM pe),
wanted AS (SELECT DISTINCT agency, portfolio FROM snap), {SPELL},
linked AS (SELECT s.portfolio, s.agency, pe.fiscal_year, pe.estimate_type, pe.edition, pe.amount_thousands
           FROM spelled s JOIN pe ON pe.portfolio = s.portfolio AND pe.agency = s.spelling),
st AS ({stitch('linked', 'portfolio, agency')})
SELECT * FROM snap JOIN st USING (portfolio, agency)""",
    "A5_agency_outcome_profile": f"""WITH {MR}{PE_ONLY}, {ALIASES},
req AS (SELECT DISTINCT agency, portfolio, substr(edition, 1, 7) AS budget_year FROM mr),
res AS (SELECT req.agency AS requested_agency, coalesce((SELECT arg_max(short_name, id) FROM al
           WHERE al.budget_year = req.budget_year AND lower(al.formal_name) = lower(req.agency)), req.agency) AS agency, portfolio, budget_year FROM req),
wanted AS (SELECT DISTINCT agency, portfolio FROM res), {SPELL},
linked AS (SELECT s.portfolio, s.agency, pe.outcome_number, pe.fiscal_year, pe.estimate_type, pe.edition, pe.amount_thousands
           FROM spelled s JOIN pe ON pe.portfolio = s.portfolio AND pe.agency = s.spelling),
st AS ({stitch('linked', 'portfolio, agency, outcome_number')}),
oc AS (SELECT DISTINCT r.requested_agency, r.agency, r.portfolio, r.budget_year, pe.outcome_number, pe.outcome_description
       FROM res r JOIN spelled s ON s.agency = r.agency AND s.portfolio = r.portfolio
       JOIN pe ON pe.portfolio = r.portfolio AND pe.agency = s.spelling AND pe.budget_year = r.budget_year)
SELECT * FROM oc JOIN st USING (portfolio, agency, outcome_number)""",
    "W2_closest_publication": f"""WITH {PE}
SELECT portfolio, agency, program_name, program_number, fiscal_year, edition, amount_thousands, gap FROM (
  SELECT *, CAST(substr(budget_year, 1, 4) AS INT) - CAST(substr(fiscal_year, 1, 4) AS INT) AS gap FROM pe)
QUALIFY row_number() OVER (PARTITION BY portfolio, agency, program_name, program_number, fiscal_year
  ORDER BY gap, {eord('edition')} DESC, edition DESC, id) = 1""",
    "W4_line_segments": f"""WITH {PE}, st AS ({stitch('pe', 'program_name')}), f AS (
  SELECT *, min(CASE WHEN estimate_type <> 'estimated_actual' THEN fiscal_year END) OVER (PARTITION BY program_name) AS split,
         lead(fiscal_year) OVER (PARTITION BY program_name ORDER BY fiscal_year) AS nxt FROM st)
SELECT program_name, fiscal_year, estimate_type, edition, amount_thousands, split IS NULL OR fiscal_year < split AS solid,
       split IS NOT NULL AND (fiscal_year >= split OR coalesce(nxt >= split, false)) AS dashed FROM f""",
    "W5_year_window": f"""WITH {MI}, d AS (SELECT measure_name, edition, agency, direction, fiscal_year, sum(amount_thousands) AS a FROM mi GROUP BY ALL),
p AS (SELECT measure_name, edition, agency, fiscal_year, sum(abs(a)) AS a FROM d GROUP BY ALL),
y AS (SELECT edition, fiscal_year, row_number() OVER (PARTITION BY edition ORDER BY fiscal_year) AS pos FROM (SELECT DISTINCT edition, fiscal_year FROM p)),
s AS (SELECT measure_name, edition, agency, coalesce(min(CASE WHEN a <> 0 THEN fiscal_year END), min(fiscal_year)) AS f,
             coalesce(max(CASE WHEN a <> 0 THEN fiscal_year END), max(fiscal_year)) AS l FROM p GROUP BY ALL)
SELECT s.measure_name, s.edition, s.agency, y.fiscal_year FROM s JOIN y fy ON fy.edition = s.edition AND fy.fiscal_year = s.f
JOIN y ON y.edition = s.edition AND y.pos >= fy.pos AND (y.fiscal_year <= s.l OR y.pos <= fy.pos + 3)""",
    "W6_latest_meta": f"""WITH {PE} SELECT agency, program_name, edition, outcome_number, outcome_description FROM pe
QUALIFY row_number() OVER (PARTITION BY agency, program_name ORDER BY edition = {LATEST} DESC,
  CASE WHEN edition = {LATEST} THEN id ELSE -id END) = 1""",
    "W7_vintage_shade": f"""WITH {PE}, v AS (SELECT DISTINCT program_number, edition, budget_year FROM pe),
n AS (SELECT *, count(*) OVER (PARTITION BY program_number) AS n, row_number() OVER (PARTITION BY program_number ORDER BY budget_year, edition) - 1 AS i FROM v)
SELECT program_number, edition, budget_year, round(CASE WHEN n = 1 THEN 1.0 ELSE CAST(i AS DOUBLE) / (n - 1) END, 6) AS shade FROM n""",
    "W8_orderings": f"""WITH {PE}, t AS (SELECT portfolio, agency, outcome_number, program_number, CAST(sum(amount_thousands) AS BIGINT) AS total FROM pe GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY portfolio ORDER BY abs(total) DESC, agency, outcome_number, program_number) AS INT) AS size_rank,
  CAST(row_number() OVER (PARTITION BY portfolio ORDER BY agency, outcome_number, program_number) AS INT) AS name_rank FROM t""",
    "W9_top_programs": f"""WITH {PE} SELECT agency, program_name, CAST(sum(amount_thousands) AS BIGINT) AS total FROM pe GROUP BY ALL
ORDER BY total DESC, agency, program_name LIMIT 30""",
    "W10_forecast_revisions": f"""WITH {PE}, p AS (SELECT agency, program_name, fiscal_year, budget_year, edition, CAST(sum(amount_thousands) AS BIGINT) AS amount_thousands FROM pe GROUP BY ALL),
q AS (SELECT *, lag(amount_thousands) OVER (PARTITION BY agency, program_name, fiscal_year ORDER BY budget_year, edition) AS previous_amount FROM p)
SELECT *, amount_thousands - previous_amount AS revision FROM q""",
    "S4_realised_scan": f"""WITH {PE} SELECT edition, budget_year, portfolio, agency, outcome_number, outcome_description, program_number,
  program_name, fiscal_year, amount_thousands, id FROM pe WHERE estimate_type = 'estimated_actual'""",
    "F6_without_slice": f"WITH {PE} SELECT edition, fiscal_year, count(*) AS n, CAST(sum(amount_thousands) AS BIGINT) AS total FROM pe WHERE {SLICE} GROUP BY ALL",
    "Q14_cleaned_actuals": f"WITH {PE}, {CLEAN} SELECT * FROM clean",
    "A11_trend": f"WITH {PE}, {CLEAN} SELECT fiscal_year, CAST(sum(amount_thousands) AS BIGINT) AS amount_thousands FROM clean GROUP BY ALL",
    "A11_trend_by_portfolio": f"WITH {PE}, {CLEAN} SELECT fiscal_year, portfolio_key, CAST(sum(amount_thousands) AS BIGINT) AS amount_thousands FROM clean GROUP BY ALL",
    "Q14_top_portfolios_pivot": f"""WITH {PE}, ac AS (SELECT * FROM pe WHERE estimate_type = 'estimated_actual'), g AS ({top('ac', 'portfolio', 3)})
SELECT label_group, string_agg(fiscal_year || ':' || CAST(amount_thousands AS VARCHAR), ',' ORDER BY fiscal_year) AS figures FROM g GROUP BY ALL""",
    "A18_distinct_counts": f"""WITH {PE} SELECT portfolio, count(DISTINCT agency) AS n_agencies, count(DISTINCT program_name) AS n_programs,
  round(avg(CASE WHEN coalesce(outcome_description, '') = '' THEN 1.0 ELSE 0.0 END), 6) AS missing_share FROM pe GROUP BY ALL""",
    "A19_top_groups": f"WITH {PE}, ac AS (SELECT * FROM pe WHERE estimate_type = 'estimated_actual') {top('ac', 'program_name', 3, 'agency')}",
    "A20_backfilled_labels": f"""WITH {PE}, r AS (SELECT *, CASE WHEN length(program_name) % 2 = 0 THEN outcome_description END AS d FROM pe WHERE estimate_type = 'estimated_actual'),
u AS (SELECT agency, budget_year, program_name, outcome_number, CASE WHEN count(DISTINCT d) = 1 THEN min(d) END AS o FROM r GROUP BY ALL)
SELECT agency, outcome_number, coalesce(u.o, r.d, 'Outcome ' || CAST(outcome_number AS VARCHAR) || ' (no description in source)') AS outcome_label, count(*) AS n
FROM r JOIN u USING (agency, budget_year, program_name, outcome_number) GROUP BY ALL""",
    "Q14_outcome_profile": f"""WITH {PE}, {CLEAN} {top('clean', 'outcome_label', 4, 'agency')}""",
    "Q14_program_profile": f"""WITH {PE}, {CLEAN}, c AS (SELECT * FROM clean WHERE contains(lower(outcome_label), 'promo')) {top('c', 'program_name', 3, 'agency')}""",
    "Q15_program_comparison": f"""WITH {PE}, st AS ({stitch('pe', 'program_name')})
SELECT program_name, string_agg(fiscal_year || ':' || CAST(amount_thousands AS VARCHAR), ',' ORDER BY fiscal_year) AS figures FROM st GROUP BY ALL""",
}
