"""SQL for the write-up queries."""

from oracles.identity_sql import MT
from oracles.scalar_sql import DOCS, _BLANK
from oracles.shared import measure_id

DL = f"""raw AS (SELECT CAST(doc_id AS VARCHAR) AS doc, doc_id, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
st AS (SELECT *, (pos - 1) % 13 AS step, CASE WHEN pos = 0 THEN -1 ELSE (pos - 1) // 13 END AS cyc, doc_id % 10 = 7 AND pos = 45 AS divider, doc_id % 10 = 3 AND pos = 25 AS caption FROM raw),
sh AS (SELECT doc, doc_id, CASE WHEN pos = 0 THEN 0 ELSE (cyc + 1) * 26 + step END AS line_no, step, divider, caption, t, pos = 0 OR divider OR caption OR step BETWEEN 0 AND 7 AS reworded,
  CASE WHEN divider THEN 'divider' WHEN caption OR pos = 0 THEN 'body' WHEN step = 0 THEN 'portfolio' WHEN step IN (1, 2) THEN 'heading' WHEN step BETWEEN 3 AND 7 THEN 'table'
       WHEN step = 10 THEN 'bullet' WHEN step = 12 THEN 'dash' ELSE 'body' END AS style,
  CASE WHEN divider THEN 'Appendix B: Statement of risks' WHEN caption THEN 'Table 1: Summary of measures'
       WHEN pos = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'Part 2: Payment Measures' ELSE 'Part 1: Revenue Measures' END
       WHEN step = 0 THEN 'P ORTFOLIO ' || upper(source) WHEN step = 1 THEN 'Measure ' || doc || ' – item ' || CAST(cyc AS VARCHAR) WHEN step = 2 THEN 'continued (a)'
       WHEN step = 3 THEN CASE WHEN cyc % 2 = 0 THEN 'Payments ($m)' ELSE 'Related receipts ($m)' END WHEN step = 4 THEN '2015-16 2016-17 2017-18'
       WHEN step = 5 THEN 'Department ' || CAST(length(t) % 6 AS VARCHAR) || ' ' || CAST(length(t) AS VARCHAR) || '.5 - nfp' WHEN step = 6 THEN 'and Trade' WHEN step = 7 THEN 'Total – Payments 1.5 - nfp' ELSE t END AS text,
  length(t) AS size, cyc, step IN (11, 12) AS indented FROM st),
d0 AS (SELECT doc, doc_id, line_no, step, divider, caption, style, text, size, cyc, indented FROM sh
  UNION ALL SELECT doc, doc_id, line_no + CASE WHEN line_no = 0 THEN 1 ELSE 13 END, 99, false, false, 'body', t, size, cyc, false FROM sh WHERE reworded),
d1 AS (SELECT *, CAST(line_no // 40 + 1 AS INT) AS page, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM d0),
dl AS (SELECT doc, doc_id, CAST(page * 1024 + row_number() OVER (PARTITION BY doc, page ORDER BY line_no) AS INT) AS line_no, page, step, divider, caption, style,
  array_to_string(ws, ' ') AS text, ws, size, cyc, indented FROM d1 WHERE len(ws) > 0),
pg AS (SELECT doc, page, CASE WHEN any_value(doc_id) % 2 = 0 THEN 'payment' ELSE 'receipt' END AS section,
  NOT coalesce(page >= (SELECT min(page) FROM dl d WHERE d.doc = dl.doc AND d.divider), false) AND NOT bool_or(caption) AS is_read FROM dl GROUP BY doc, page),
gl AS (SELECT dl.*, pg.section FROM dl JOIN pg USING (doc, page) WHERE is_read AND (style IN ('bullet', 'dash') OR regexp_replace(text, '^{_BLANK}|{_BLANK}$', '', 'g') <> '')),
s1 AS (SELECT *, coalesce(lag(style) OVER w, '') AS before, last_value(CASE WHEN style IN ('portfolio', 'heading') THEN style END IGNORE NULLS) OVER w AS structure,
   coalesce(last_value(CASE WHEN style IN ('portfolio', 'heading') THEN style END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS structure_before
   FROM gl WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
s2 AS (SELECT *, CASE WHEN structure = 'heading' THEN CAST(sum(CASE WHEN style = 'heading' AND before <> 'heading' THEN 1 ELSE 0 END) OVER w AS BIGINT) END AS measure_no,
   CAST(sum(CASE WHEN style = 'portfolio' AND structure_before <> 'portfolio' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS portfolio_no FROM s1 WINDOW w AS (PARTITION BY doc ORDER BY line_no))"""
TABLES = """tb AS (SELECT *, last_value(CASE WHEN step = 3 AND style = 'table' THEN line_no WHEN style <> 'table' OR step = 7 THEN -1 END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no) AS table_no
   FROM s2 WHERE measure_no IS NOT NULL),
tp AS (SELECT *, lag(table_no) OVER (PARTITION BY doc ORDER BY line_no) AS table_before FROM tb)"""
PROSE = f"""pr AS (SELECT * FROM tp WHERE style NOT IN ('heading', 'portfolio') AND NOT (step = 3 AND style = 'table') AND NOT coalesce(table_no >= 0, false) AND NOT (step = 7 AND style = 'table' AND coalesce(table_before >= 0, false))),
p1 AS (SELECT *, CAST(sum(CASE WHEN style IN ('bullet', 'dash') THEN 1 ELSE 0 END) OVER (PARTITION BY doc, measure_no ORDER BY line_no) AS BIGINT) AS bullet_no FROM pr),
p2 AS (SELECT *, CASE WHEN style = 'bullet' THEN 'dot' WHEN style = 'dash' THEN 'dash' WHEN indented AND bullet_no > 0 THEN 'more' ELSE 'text' END AS kind,
   regexp_matches(regexp_replace(text, '{_BLANK}$', ''), '[.:!?]["”’)]*$') AS ended FROM p1),
p3 AS (SELECT *, coalesce(sum(CASE WHEN kind = 'text' AND ended THEN 1 ELSE 0 END) OVER (PARTITION BY doc, measure_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para FROM p2),
cp AS (SELECT doc, measure_no, bullet_no, min(line_no) AS line_no, 'text' AS marker, string_agg(text, ' ' ORDER BY line_no) AS text FROM p3 WHERE kind = 'text' GROUP BY doc, measure_no, bullet_no, para
   UNION ALL SELECT doc, measure_no, bullet_no, min(line_no), arg_min(kind, line_no), string_agg(text, ' ' ORDER BY line_no) FROM p3 WHERE kind <> 'text' GROUP BY doc, measure_no, bullet_no),
cm AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc, measure_no ORDER BY line_no) - 1 AS INT) AS ordinal FROM cp)"""
PHRASES = f"""ru AS (SELECT *, CASE WHEN step = 8 THEN ws[greatest(len(ws) - 1, 1):] WHEN step IN (9, 12) THEN ws[1:1] WHEN step = 10 AND len(ws) > 1 THEN ws[2:2] END AS run,
  CASE WHEN step = 8 THEN len(ws) <= 2 ELSE step IN (9, 12) END AS starts, CASE WHEN step = 8 THEN true WHEN step IN (9, 12) THEN len(ws) = 1 ELSE step = 10 AND len(ws) = 2 END AS ends FROM p3),
op AS (SELECT *, coalesce(lag(ends) OVER (PARTITION BY doc, measure_no ORDER BY line_no), false) AS open_before FROM ru),
jo AS (SELECT *, CAST(sum(CASE WHEN starts AND open_before AND kind NOT IN ('dot', 'dash') THEN 0 ELSE 1 END) OVER (PARTITION BY doc, measure_no ORDER BY line_no) AS BIGINT) AS phrase_no FROM op WHERE run IS NOT NULL),
pt AS (SELECT doc, measure_no, min(line_no) AS line_no, regexp_replace(string_agg(array_to_string(run, ' '), ' ' ORDER BY line_no), '^{_BLANK}|{_BLANK}$', '', 'g') AS phrase FROM jo GROUP BY doc, measure_no, phrase_no),
px AS (SELECT * FROM pt WHERE regexp_matches(phrase, '[\\p{{L}}\\p{{N}}]'))"""

TITLES = """h AS (SELECT doc, measure_no, string_agg(text, ' ' ORDER BY line_no) AS title, arg_min(section, line_no) AS document_section, arg_min(page, line_no) AS source_page, arg_min(portfolio_no, line_no) AS portfolio_no
  FROM s2 WHERE style = 'heading' GROUP BY ALL), p AS (SELECT doc, portfolio_no, string_agg(replace(text, 'P ORTFOLIO', 'PORTFOLIO'), ' ' ORDER BY line_no) AS portfolio FROM s2 WHERE style = 'portfolio' GROUP BY ALL),
ms AS (SELECT doc, measure_no, regexp_replace(replace(title, '–', '-'), ' \\(a\\)$', '') AS measure_name, coalesce(portfolio, '') AS portfolio, document_section, source_page FROM h LEFT JOIN p USING (doc, portfolio_no))"""
FIGURES = """r AS (SELECT t.doc, t.measure_no, t.table_no * 4294967296 + 1 AS row_order, CASE WHEN h.cyc % 2 = 0 THEN 'Payment' ELSE 'Receipt' END AS impact_type, h.cyc % 2 <> 0 AS is_related,
  'Department' || CASE WHEN EXISTS (SELECT 1 FROM tp x WHERE x.doc = t.doc AND x.table_no = t.table_no AND x.step = 6) THEN ' and Trade' ELSE '' END AS department_name,
  [CAST(t.size % 6 AS VARCHAR), CAST(t.size AS VARCHAR) || '.5', '-', 'nfp'] AS vals FROM tp t JOIN tp h ON h.doc = t.doc AND h.line_no = t.table_no WHERE t.step = 5 AND t.style = 'table' AND t.table_no >= 0),
fv AS (SELECT doc, measure_no, row_order, impact_type, is_related, department_name, CAST(i AS INT) AS year_index, CASE WHEN vals[i + 1] = 'nfp' THEN 'special' ELSE 'numeric' END AS value_kind,
  CASE WHEN vals[i + 1] = '-' THEN 0.0 ELSE TRY_CAST(vals[i + 1] AS DOUBLE) END AS value_numeric_million, vals[i + 1] AS value_raw FROM r, (VALUES (0), (1), (2), (3)) v(i))"""
FULL = f"""ft AS (SELECT doc, measure_no, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY ordinal), '^{_BLANK}|{_BLANK}$', '', 'g') AS full_text FROM cm WHERE marker = 'text' GROUP BY ALL)"""
NAMED = f"""{DOCS}, nm AS (SELECT ms.*, docs.edition, docs.source || '.pdf' AS source_file, {measure_id('measure_name', 'docs.edition')} AS measure_id
  FROM ms JOIN (SELECT doc_id, edition, source FROM docs) docs ON CAST(docs.doc_id AS VARCHAR) = ms.doc)""".replace("measure_name ||", "ms.measure_name ||").replace("sha256(measure_name", "sha256(ms.measure_name")

SQL = {
    "T15_lines_of_words": f"""WITH {DL} SELECT doc, page, line_no, style, CASE WHEN indented THEN 120e0 ELSE 90e0 END AS indent,
  CASE WHEN step IN (8, 9, 12) OR step = 10 AND len(ws) > 1 THEN 1 ELSE 0 END AS n_runs, md5(text) AS digest FROM dl""",
    "T16_page_sections": f"WITH {DL} SELECT doc, page, section, is_read FROM pg",
    "T17_measures": f"WITH {DL}, {TITLES} SELECT * FROM ms",
    "T18_financial_values": f"WITH {DL}, {TABLES}, {FIGURES} SELECT * FROM fv",
    "T19_paragraphs": f"WITH {DL}, {TABLES}, {PROSE} SELECT doc, measure_no, bullet_no, line_no, md5(text) AS digest FROM cm WHERE marker = 'text'",
    "T20_components": f"""WITH {DL}, {TABLES}, {PROSE} SELECT doc, measure_no, ordinal, CASE marker WHEN 'text' THEN 0 WHEN 'dot' THEN 1 ELSE 2 END AS level, marker,
  CASE WHEN marker = 'dash' THEN last_value(CASE WHEN marker = 'dot' THEN ordinal END IGNORE NULLS) OVER (PARTITION BY doc, measure_no ORDER BY ordinal) END AS parent_ordinal, md5(text) AS digest FROM cm""",
    "T21_related_phrases": f"""WITH {DL}, {TABLES}, {PROSE}, {PHRASES}, f AS (SELECT doc, measure_no, phrase, min(line_no) AS line_no FROM px GROUP BY ALL)
SELECT doc, measure_no, CAST(row_number() OVER (PARTITION BY doc, measure_no ORDER BY line_no) - 1 AS INT) AS ordinal, phrase FROM f""",
    "T22_full_texts": f"WITH {DL}, {TABLES}, {PROSE}, {FULL} SELECT doc, measure_no, md5(full_text) AS digest FROM ft",
    "S6_built_measure_text": f"""WITH {DL}, {TABLES}, {PROSE}, {FULL}, {TITLES}, {NAMED} SELECT measure_id, measure_name, edition, portfolio, document_section, source_page,
  md5(coalesce(full_text, '')) AS full_measure_text, source_file FROM nm LEFT JOIN ft USING (doc, measure_no)""",
    "S6_built_children": f"""WITH {DL}, {TABLES}, {PROSE}, {FIGURES}, {PHRASES}, {TITLES}, {NAMED}, f AS (SELECT doc, measure_no, phrase, min(line_no) AS line_no FROM px GROUP BY ALL)
SELECT measure_id, 'figure' AS child, CAST(dense_rank() OVER (PARTITION BY measure_id ORDER BY row_order) - 1 AS INT) AS ordinal, year_index AS place, concat_ws('|', impact_type, CAST(is_related AS VARCHAR), department_name) AS label, value_raw AS content
  FROM fv JOIN nm USING (doc, measure_no)
UNION ALL SELECT measure_id, 'component', ordinal, CASE marker WHEN 'text' THEN 0 WHEN 'dot' THEN 1 ELSE 2 END, marker, md5(text) FROM cm JOIN nm USING (doc, measure_no)
UNION ALL SELECT measure_id, 'phrase', CAST(row_number() OVER (PARTITION BY doc, measure_no ORDER BY line_no) - 1 AS INT), 0, NULL, phrase FROM f JOIN nm USING (doc, measure_no)""",
    "W3_running_state": """SELECT user_id, event_id, event_type, round(value, 4) AS value, last_value(CASE WHEN event_type = 'error' THEN round(value, 4) END IGNORE NULLS) OVER w AS last_error,
  lag(event_type) OVER w AS previous_type, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS purchases FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "W11_bullet_blocks": f"""WITH {MT}, r AS (SELECT *, (SELECT count(*) FROM comp c WHERE c.measure_id = comp.measure_id AND c.marker = 'dash' AND c.parent_ordinal = comp.ordinal) AS n FROM comp WHERE marker <> 'dash'),
b AS (SELECT *, CASE WHEN marker = 'text' OR coalesce(lag(marker) OVER (PARTITION BY measure_id ORDER BY ordinal), 'text') = 'text' THEN 1 ELSE 0 END AS s FROM r),
k AS (SELECT *, CAST(sum(s) OVER (PARTITION BY measure_id ORDER BY ordinal) AS BIGINT) AS block FROM b)
SELECT measure_id, block, CASE WHEN max(marker) = 'text' THEN 'text' ELSE 'list' END AS block_type, string_agg(CAST(ordinal AS VARCHAR) || '+' || CAST(n AS VARCHAR), '|' ORDER BY ordinal) AS items FROM k GROUP BY ALL""",
}
