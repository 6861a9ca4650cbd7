"""The user-facing queries, each for all measures or programs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagebook.operators import identity as I
from vintagebook.operators import measures as M
from vintagebook.operators import search as S
from vintagebook.operators import series as R
from vintagebook.operators.identity import MEASURE_KEY
from vintagebook.plans import comparison as C
from vintagebook.plans import profiles as P
from vintagebook.plans.bindings import Bound, row_id
from vintagebook.plans.registry import query
from vintagebook.plans.search_queries import TEXT_QUERY, TOPIC_QUERIES, _texts_by_document


def listed(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


@query("Q1_measure_heads")
def heads(b: Bound) -> DataFrame:
    rows = P.measure_heads(b.measure_impacts, b.measure_programs, b.agency_aliases)
    return rows.select(*MEASURE_KEY, "measure_id", listed("portfolios"), listed("agencies"), "n_impacts", "n_programs")


@query("Q1_measure_impacts")
def impacts(b: Bound) -> DataFrame:
    return P.measure_impacts_shown(b.measure_impacts, b.agency_aliases).select(
        *MEASURE_KEY, "portfolio", "agency", "direction", "fiscal_year", "amount_thousands"
    )


@query("Q1_measure_programs")
def programs(b: Bound) -> DataFrame:
    return P.measure_programs_shown(b.measure_programs, b.program_expenses, b.agency_aliases)


@query("Q2_program_profile")
def program_profile(b: Bound) -> DataFrame:
    return P.program_profile(b.program_expenses, b.latest, ["Brand#1", "Brand#12", "Brand#20"])


@query("Q3_estimate_history")
def history(b: Bound) -> DataFrame:
    parts = P.estimate_history(b.program_expenses, b.latest)
    point = F.transform("series", lambda p: F.concat_ws(":", p["fiscal_year"], p["estimate_type"], p["amount_thousands"].cast("string")))
    vintages = parts["vintages"].select("program_name", "edition", "budget_year", F.round("shade", 6).alias("shade"), F.array_join(point, ",").alias("series"))
    return vintages.join(parts["meta"], "program_name")


@query("Q4_program_hierarchy")
def hierarchy(b: Bound) -> DataFrame:
    return P.program_hierarchy(b.program_expenses, b.agency_aliases, b.latest)


@query("Q5_portfolio_profile")
def portfolio_profile(b: Bound) -> DataFrame:
    wanted = b.program_expenses.where("budget_year = '2017-18'").select("portfolio", "budget_year").distinct()
    return P.portfolio_profile(b.program_expenses, b.agency_aliases, b.latest, wanted)


@query("Q6_agency_outcome_profile")
def agency_outcomes(b: Bound) -> DataFrame:
    requests = b.measure_impacts.where("edition = '2018-19 Budget'").select("agency", "portfolio", F.lit("2018-19").alias("budget_year"))
    return P.agency_outcome_profile(b.program_expenses, b.agency_aliases, b.latest, requests)


def _write_up(b: Bound) -> dict[str, DataFrame]:
    return P.write_up(b.measure_text, b.components, b.related, b.financials, b.measure_impacts)


@query("Q7_write_up_heads")
def write_up_heads(b: Bound) -> DataFrame:
    parts = _write_up(b)
    sizes = parts["components"].groupBy("measure_id").agg(F.count(F.lit(1)).alias("n_components"))
    return parts["head"].select("measure_id", *MEASURE_KEY, "portfolio", "document_section", "source_page", F.md5("full_measure_text").alias("text_digest")).join(sizes, "measure_id", "left")


@query("Q7_write_up_related")
def write_up_related(b: Bound) -> DataFrame:
    return _write_up(b)["related_measures"]


@query("Q7_write_up_components")
def write_up_components(b: Bound) -> DataFrame:
    parts = _write_up(b)["components"]
    return parts.select("measure_id", "ordinal", "level", "marker", "parent_ordinal", F.md5("text").alias("digest"))


@query("Q7_write_up_figures")
def write_up_figures(b: Bound) -> DataFrame:
    """Headline figures as printed: groups in order, values in order within."""
    groups = _write_up(b)["headline_financials"]
    values = groups.select("measure_id", "position", "impact_type", "is_related", "department_name", F.posexplode("values").alias("value_no", "v"))
    return values.select("measure_id", "position", "impact_type", "is_related", "department_name", "value_no", "v.value_kind", "v.value_numeric_million", "v.value_raw")


@query("Q8_measure_list")
def measure_list(b: Bound) -> DataFrame:
    cat = M.catalogue(b.measure_text, b.measure_impacts, b.measure_programs)
    return cat.select(*MEASURE_KEY, "measure_id", F.to_json(F.struct("portfolios", "agencies")).alias("names"), "has_financial_data")


@query("Q9_measure_by_id")
def by_id(b: Bound) -> DataFrame:
    wanted = b.measure_text.select("measure_id")
    found, _ = I.split_request(wanted, I.resolve_ids(b.measure_impacts, b.measure_programs, b.measure_text))
    return found.select("measure_id", *MEASURE_KEY)


def _request(b: Bound) -> DataFrame:
    """All write-ups plus ids that belong to nothing, in the order of a digest; every tenth is asked for twice."""
    from vintagebook.functions.ids import measure_id

    unknown = b.related.select(measure_id(F.col("phrase"), F.lit("nowhere")).alias("measure_id"))
    ids = b.measure_text.select("measure_id").unionByName(unknown).distinct()
    again = row_id("measure_id") % 10 == 0
    return ids.select("measure_id", F.explode(F.when(again, F.array(row_id("measure_id"), row_id("measure_id", F.lit("again")))).otherwise(F.array(row_id("measure_id")))).alias("position"))


@query("Q10_combined_measures")
def combined(b: Bound) -> DataFrame:
    rows = P.combined_measures(_request(b), b.measure_text, b.measure_impacts, b.measure_programs, b.agency_aliases)
    return rows.select("position", "measure_id", *MEASURE_KEY, listed("portfolios"), listed("agencies"), "n_impacts", "n_programs", "has_financial_data", "not_found")


@query("Q10_combined_rows")
def combined_rows(b: Bound) -> DataFrame:
    """The lists inside the answer: impact and program rows of every requested measure."""
    return P.combined_rows(_request(b), b.measure_text, b.measure_impacts, b.measure_programs, b.program_expenses, b.agency_aliases)


@query("Q11_measures_by_program")
def by_program(b: Bound) -> DataFrame:
    rows = P.measures_by_program(b.measure_impacts, b.measure_programs, b.program_expenses, b.agency_aliases)
    return rows.select("program_name", "portfolio", *MEASURE_KEY, "measure_id", listed("portfolios"), listed("agencies"), "n_impacts", "n_programs")


@query("Q12_topic_search")
def topic_search(b: Bound) -> DataFrame:
    """Topic hits with the fields of the catalogue; a hit without a document has a null measure and empty fields."""
    found = S.topic_search(b.vectors, b.vector_meta, _texts_by_document(b), b.query_vectors(TOPIC_QUERIES), 50)
    hits = found.withColumn("measure_id", F.col("measure_id").cast("string"))
    known = hits.where("measure_name is not null").select(*MEASURE_KEY, "portfolio", "measure_id").distinct()
    rows = S.with_catalogue_fields(known, b.measure_impacts, b.measure_programs, [])
    fields = rows.select(*MEASURE_KEY, listed("portfolios"), listed("agencies"), "has_financial_data")
    joined = hits.select("query_id", "rank", *MEASURE_KEY, "score", "snippet").join(fields, MEASURE_KEY, "left")
    return joined.withColumns({
        "portfolios": F.coalesce("portfolios", F.lit("")), "agencies": F.coalesce("agencies", F.lit("")),
        "has_financial_data": F.coalesce("has_financial_data", F.lit(False)),
    })


@query("Q13_text_search")
def text_search(b: Bound) -> DataFrame:
    hits = S.text_matches(b.measure_text, b.components, TEXT_QUERY.upper())
    rows = S.with_catalogue_fields(hits, b.measure_impacts, b.measure_programs, ["snippet"])
    return rows.select("measure_id", *MEASURE_KEY, listed("portfolios"), listed("agencies"), "has_financial_data", "snippet")


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("figures", R.figures_text(F.col("figures")))


@query("Q15_combined_summary")
def combined_summary(b: Bound) -> DataFrame:
    """One selection per edition: its matrix beside the agency with the largest effect."""
    parts = C.combined_summary(b.measure_impacts, ["edition"])
    return shown(parts["matrix"].join(parts["dominant_agency"], "edition"))


@query("Q15_program_matrix")
def program_matrix(b: Bound) -> DataFrame:
    series = R.stitched_series(b.program_expenses, ["portfolio", "program_name"], b.latest)
    return shown(R.figures_by_year(series, ["portfolio", "program_name"]))


@query("Q16_overlay_agencies")
def overlay_agencies(b: Bound) -> DataFrame:
    return C.overlay_agencies(b.measure_programs, b.measure_impacts, MEASURE_KEY)


@query("Q16_agency_overlay")
def overlay(b: Bound) -> DataFrame:
    resolved = I.resolve_programs(b.measure_programs, b.program_expenses, b.agency_aliases)
    return C.agency_overlay(resolved, b.measure_impacts, b.program_expenses, b.latest, MEASURE_KEY)
