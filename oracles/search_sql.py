"""SQL for the search queries."""

from oracles.identity_sql import CAT, DISPLAY, HIERARCHY, MT
from oracles.scalar_sql import _BLANK, DOCS
from oracles.shared import ALIASES, MIP, PE

Q = "to thanedble"


def snippet(text: str) -> str:
    p = f"instr(lower({text}), '{Q}')"
    a = f"greatest(0, {p} - 61)"
    z = f"least(length({text}), {p} - 1 + {len(Q)} + 60)"
    return (
        f"CASE WHEN {a} > 0 THEN '…' ELSE '' END || regexp_replace(substr({text}, {a} + 1, {z} - {a}), '^{_BLANK}|{_BLANK}$', '', 'g') "
        f"|| CASE WHEN {z} < length({text}) THEN '…' ELSE '' END"
    )


HITS = f"""hits AS (SELECT mt.measure_id, measure_name, edition, portfolio, {snippet('full_measure_text')} AS snippet FROM mt WHERE contains(lower(full_measure_text), '{Q}')
  UNION ALL SELECT mt.measure_id, measure_name, edition, portfolio, {snippet('c.text')} FROM mt JOIN (SELECT * FROM comp WHERE contains(lower(text), '{Q}')
     QUALIFY row_number() OVER (PARTITION BY measure_id ORDER BY ordinal) = 1) c USING (measure_id) WHERE NOT contains(lower(full_measure_text), '{Q}'))"""
ENRICH = """SELECT h.measure_id, h.measure_name, h.edition, {extra}, cat.agencies, cat.has_financial_data,
  cat.portfolios FROM {source} h JOIN (SELECT measure_name, edition, array_to_string(portfolios, '|') AS portfolios, array_to_string(agencies, '|') AS agencies, has_financial_data FROM cat) cat USING (measure_name, edition)"""
NEAR = """near AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM embeddings c, (SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2, 3, 4)) q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS INT) AS rank FROM near)"""
LISTED = "array_to_string(portfolios, '|') AS portfolios"
HIER = f"WITH {PE}, {ALIASES}, {DISPLAY}, {HIERARCHY}"

SQL = {
    "F4_text_or_component": f"WITH {MT} SELECT measure_id, measure_name, edition FROM mt WHERE contains(lower(full_measure_text), '{Q}') OR measure_id IN (SELECT measure_id FROM comp WHERE contains(lower(text), '{Q}'))",
    "F7_list_filters": f"WITH {MT}, {MIP}, {CAT} SELECT measure_name, edition, {LISTED} FROM cat WHERE list_has_any(portfolios, ['ASIA', 'Health']) AND edition IN ('2016-17 MYEFO', '2018-19 Budget')",
    "V1_topic_search": f"""WITH {DOCS}, {NEAR} SELECT query_id, rank, id AS measure_id, measure_name, edition, round(greatest(0, 1 - d / 2), 6) AS score,
  coalesce(regexp_replace(substr(text, 1, 180), '^{_BLANK}|{_BLANK}$', '', 'g'), '') AS snippet FROM ranked LEFT JOIN docs ON doc_id = id WHERE rank <= 30""",
    "J12_nearest_vectors": f"WITH {NEAR} SELECT query_id, id, round(d, 6) AS distance, rank FROM ranked WHERE rank <= 10",
    "V2_text_search": f"WITH {MT}, {MIP}, {CAT}, {HITS} " + ENRICH.format(extra="h.snippet", source="hits"),
    "V2_indexed_search": f"WITH {MT}, {HITS} SELECT measure_id, measure_name, edition, portfolio, snippet FROM hits",
    "J9_enriched_hits": f"WITH {MT}, {MIP}, {CAT} " + ENRICH.format(extra="h.id", source="mt"),
    "V3_name_search": f"WITH {MT}, {MIP}, {CAT} SELECT measure_id, measure_name, edition, {LISTED} FROM cat WHERE contains(lower(measure_name), 'promo -') AND list_has_any(portfolios, ['EUROPE', 'AFRICA'])",
    "V4_portfolio_facets": f"WITH {MT}, {MIP}, {CAT} SELECT DISTINCT unnest(portfolios) AS portfolio FROM cat",
    "V4_edition_facets": """WITH e AS (SELECT DISTINCT edition FROM cat) SELECT edition, CAST(substr(edition, 1, 4) AS INT) * 10 + CASE WHEN edition LIKE '%MYEFO' THEN 2 WHEN edition LIKE '%October%' THEN 1 ELSE 0 END AS sort_key FROM e""",
    "V5_picker_agencies": f"{HIER} SELECT DISTINCT agency FROM hier WHERE portfolio = 'ASIA'",
    "V5_picker_outcomes": f"{HIER} SELECT DISTINCT outcome_number, outcome_description FROM hier WHERE portfolio = 'ASIA' AND agency = 'Department of NATION_7'",
    "V5_picker_programs": f"{HIER} SELECT DISTINCT program_number, program_name FROM hier WHERE portfolio = 'ASIA' AND agency = 'Department of NATION_7' AND outcome_number = 3",
}
SQL["V4_edition_facets"] = f"WITH {MT}, {MIP}, {CAT}, " + SQL["V4_edition_facets"][5:]
