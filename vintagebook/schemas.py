"""Schemas of the logical tables and of the pipeline inputs."""

from __future__ import annotations

PROGRAM_EXPENSES = (
    "edition string not null, budget_year string not null, portfolio string not null, agency string not null, "
    "outcome_number int not null, outcome_description string, program_number string not null, program_name string, "
    "fiscal_year string not null, estimate_type string not null, amount_thousands bigint not null, "
    "source_file string not null, sheet_name string, id bigint not null"
)
MEASURE_IMPACTS = (
    "measure_id string not null, edition string not null, measure_name string not null, portfolio string not null, "
    "agency string not null, direction string not null, fiscal_year string not null, amount_thousands bigint not null, "
    "source_file string not null, id bigint not null"
)
MEASURE_PROGRAMS = (
    "measure_id string not null, edition string not null, measure_name string not null, portfolio string not null, "
    "agency string not null, direction string not null, program_number string not null, is_departmental boolean not null, "
    "source_file string not null, id bigint not null"
)
AGENCY_ALIASES = (
    "edition string not null, budget_year string not null, portfolio string not null, formal_name string not null, "
    "short_name string not null, source_file string not null, id bigint not null"
)
MEASURE_TEXT = (
    "measure_id string not null, measure_name string not null, edition string not null, portfolio string not null, "
    "document_section string not null, source_page int not null, full_measure_text string not null, "
    "source_file string not null, id bigint not null"
)
MEASURE_TEXT_FINANCIAL = (
    "measure_id string not null, impact_type string not null, is_related boolean not null, department_name string not null, "
    "row_ordinal int not null, year_index int not null, value_kind string not null, value_numeric_million double, "
    "value_raw string not null"
)
MEASURE_TEXT_COMPONENT = (
    "measure_id string not null, ordinal int not null, level int not null, marker string not null, "
    "parent_ordinal int, text string not null"
)
MEASURE_TEXT_RELATED = "measure_id string not null, ordinal int not null, phrase string not null"
VECTORS = "id string, document string, measure_name string, edition string, portfolio string, embedding array<float>"
CELLS = "source_file string, sheet_name string, sheet_idx int, row_idx int, col_idx int, value string, num double"
WORDS = "doc string, page int, text string, x0 double, x1 double, top double, font string, size double"
LINES = (
    "doc string, page int, line_no int, text string, style string, indent double, "
    "italic_runs array<struct<starts_first: boolean, ends_last: boolean, phrase: string>>"
)
