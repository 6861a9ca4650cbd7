"""Queries on identity, measures, selections and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagebook.functions.names import canonical_portfolio
from vintagebook.operators import identity as I
from vintagebook.operators import measures as M
from vintagebook.operators.identity import MEASURE_KEY
from vintagebook.operators.lookups import distinct_union
from vintagebook.plans import comparison as C
from vintagebook.operators.series import figures_text
from vintagebook.plans.bindings import Bound
from vintagebook.plans.registry import query
from vintagebook.session import ensure_checkpoint_dir
from vintagebook.sources import versions
from vintagebook.sources.builds import build_reverse_index, refresh_reverse_index


def joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


# --- agencies and programs ----------------------------------------------------------

@query("J1_same_year_alias")
def same_year(b: Bound) -> DataFrame:
    rows = b.measure_programs.select("agency", F.substring("edition", 1, 7).alias("budget_year"), "program_number")
    return I.same_year_short_name(rows, b.agency_aliases).groupBy("budget_year", "agency", "resolved_agency").agg(F.count(F.lit(1)).alias("n"))


@query("J2_agency_spellings")
def spellings(b: Bound) -> DataFrame:
    return I.agency_spellings(b.measure_programs, b.agency_aliases)


@query("J2_agency_spellings_canonical")
def spellings_canonical(b: Bound) -> DataFrame:
    return I.agency_spellings(b.measure_programs, b.agency_aliases, canonical=True)


@query("J3_display_agency")
def display(b: Bound) -> DataFrame:
    rows = b.program_expenses.select("edition", "agency", "amount_thousands")
    return I.with_display_agency(rows, b.agency_aliases).groupBy("edition", "agency", "display_agency").agg(F.sum("amount_thousands").alias("total"))


@query("J4_resolved_programs")
def resolved(b: Bound) -> DataFrame:
    return I.resolve_programs(b.measure_programs, b.program_expenses, b.agency_aliases).select(
        "measure_id", "agency", "direction", "program_number", "is_departmental", "program_name", "outcome_number", "outcome_description"
    )


@query("J5_program_reverse_index")
def reverse_index(b: Bound) -> DataFrame:
    return I.program_reverse_index(b.measure_programs, b.program_expenses, b.agency_aliases)


@query("J5_refreshed_index")
def refreshed_index(b: Bound) -> DataFrame:
    """The index built before one edition had its measures and another its expenses, then refreshed for these two."""
    root = f"{ensure_checkpoint_dir(b.spark)}/table-{uuid.uuid4().hex}"
    late, expenses = [b.editions[0], b.editions[-1]], b.program_expenses
    before = b.measure_programs.where(F.col("edition") != late[0]), expenses.where(F.col("edition") != late[1])
    build_reverse_index(root, *before, b.agency_aliases)
    refresh_reverse_index(b.spark, root, b.measure_programs, expenses, b.agency_aliases, late)
    return versions.read_table(b.spark, root)


@query("J6_related_measures")
def related(b: Bound) -> DataFrame:
    return I.related_measures(b.related, b.measure_text, b.measure_impacts)


@query("J7_measure_by_id")
def by_id(b: Bound) -> DataFrame:
    return I.resolve_ids(b.measure_impacts, b.measure_programs, b.measure_text)


@query("J8_catalogue_keys")
def catalogue_keys(b: Bound) -> DataFrame:
    def part(table: DataFrame, name: str) -> DataFrame:
        return table.select(*MEASURE_KEY, F.lit(name).alias("source")).distinct()

    rows = part(b.measure_text, "text").unionByName(part(b.measure_impacts, "impacts")).unionByName(part(b.measure_programs, "programs"))
    return rows.groupBy(*MEASURE_KEY).agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))


@query("J10_components_of_measures")
def components(b: Bound) -> DataFrame:
    parts = b.components.join(b.measure_text.select("measure_id", "measure_name"), "measure_id")
    return parts.select("measure_id", "measure_name", "ordinal", "level", "marker", "parent_ordinal", "text")


@query("J11_tagged_programs")
def tagged(b: Bound) -> DataFrame:
    return M.program_touches(b.measure_programs.withColumn("program_name", F.col("program_number")), ["edition"])


@query("J13_source_coverage")
def coverage(b: Bound) -> DataFrame:
    return I.source_coverage(b.measure_text, b.measure_impacts)


@query("J14_agency_portfolio")
def agency_portfolio(b: Bound) -> DataFrame:
    return I.agency_portfolio(b.measure_programs, b.measure_impacts, MEASURE_KEY)


# --- measures -----------------------------------------------------------------------------

@query("A6_combined_impacts")
def impacts(b: Bound) -> DataFrame:
    return M.combine_impacts(b.measure_records)


@query("A7_programs_touched")
def touched(b: Bound) -> DataFrame:
    return M.programs_touched(b.measure_records)


@query("A8_catalogue")
def catalogue(b: Bound) -> DataFrame:
    cat = M.catalogue(b.measure_text, b.measure_impacts, b.measure_programs)
    return cat.select("measure_name", "edition", "measure_id", joined("portfolios"), joined("agencies"), "has_financial_data")


@query("A9_hierarchy")
def hierarchy(b: Bound) -> DataFrame:
    from vintagebook.plans.profiles import program_hierarchy

    return program_hierarchy(b.program_expenses, b.agency_aliases, b.latest)


@query("A10_conflicting_duplicates")
def conflicts(b: Bound) -> DataFrame:
    keys = ["source_file", "outcome_number", "program_number", "fiscal_year", "estimate_type"]
    return M.conflicting_duplicates(b.program_expenses.select(*keys, "id", "amount_thousands"), keys, ["id"])


@query("W1_first_of_duplicates")
def first_wins(b: Bound) -> DataFrame:
    keys = ["source_file", "outcome_number", "program_number", "fiscal_year", "estimate_type"]
    return M.first_of_duplicates(b.program_expenses, keys, ["id"], ["id", "amount_thousands"])


@query("A12_direction_totals")
def direction_totals(b: Bound) -> DataFrame:
    return M.direction_totals(b.measure_impacts, MEASURE_KEY)


@query("A13_impact_matrix")
def matrix(b: Bound) -> DataFrame:
    return M.impact_matrix(b.measure_impacts, ["edition"]).withColumn("figures", figures_text(F.col("figures")))


@query("A14_combined_matrix")
def combined_matrix(b: Bound) -> DataFrame:
    return M.combined_matrix(b.measure_impacts, ["edition"]).withColumn("figures", figures_text(F.col("figures")))


@query("A14_net_totals")
def net_totals(b: Bound) -> DataFrame:
    return M.net_totals(b.measure_impacts, ["measure_id", "measure_name", "edition"])


@query("A15_dominant_agency")
def dominant(b: Bound) -> DataFrame:
    return M.dominant_agency(b.measure_impacts, MEASURE_KEY)


@query("A16_merged_programs")
def merged(b: Bound) -> DataFrame:
    rows = b.measure_programs.withColumn("program_name", F.concat(F.lit("Program "), "program_number"))
    return M.merged_programs(rows, ["edition"]).select(
        "edition", "agency", "direction", "program_number", "program_name", joined("channels"), "touched_by", "portfolio"
    )


@query("A16_programs_by_agency")
def by_agency(b: Bound) -> DataFrame:
    rows = b.measure_programs.withColumn("program_name", F.concat(F.lit("Program "), "program_number"))
    listed = M.programs_by_agency(M.merged_programs(rows, ["edition"]), ["edition"])
    return listed.select("edition", "agency", "portfolio", "place", "program_name", "program_number", "direction", F.array_join("channels", "+").alias("channels"), "touched_by")


@query("A17_grouped_financials")
def financials(b: Bound) -> DataFrame:
    grouped = M.grouped_financials(b.financials)
    value = F.transform("values", lambda v: F.concat_ws(":", v["row_ordinal"].cast("string"), v["year_index"].cast("string"), v["value_kind"], v["value_raw"]))
    return grouped.select("measure_id", "impact_type", "is_related", "department_name", "first_row", F.array_join(value, ";").alias("values"))


@query("A22_reconciliation")
def reconciliation(b: Bound) -> DataFrame:
    """Program lines against the totals printed for each file, which leave out the last projected year."""
    printed = b.program_expenses.where(F.col("estimate_type") != "forward_estimate")
    return M.reconcile(b.program_expenses, printed, ["source_file"])


# --- filters ------------------------------------------------------------------------------------

@query("F1_equality_filters")
def equality(b: Bound) -> DataFrame:
    rows = b.program_expenses.where((F.col("portfolio") == "ASIA") & (F.col("budget_year") == "2016-17"))
    return rows.groupBy("agency").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_thousands").alias("total"))


@query("F2_membership")
def membership(b: Bound) -> DataFrame:
    """Facts whose agency is among the spellings of any agency with a second formal name."""
    double = b.agency_aliases.where(F.col("formal_name").endswith("Commission")).select(F.col("short_name").alias("agency")).distinct()
    return b.program_expenses.join(double, "agency", "left_semi").groupBy("agency").agg(F.count(F.lit(1)).alias("n"))


@query("F3_case_insensitive_equality")
def any_case(b: Bound) -> DataFrame:
    names = b.agency_aliases.select(F.lower("formal_name").alias("__key")).distinct()
    rows = b.measure_impacts.withColumn("__key", F.lower("agency"))
    return rows.join(names, "__key", "left_semi").groupBy("agency").agg(F.count(F.lit(1)).alias("n"))


@query("F5_agency_filters")
def agency_filters(b: Bound) -> DataFrame:
    from vintagebook.plans import trends as T

    loose = T.agency_rows(b.program_expenses, ["oct n1", "n2$"]).withColumn("how", F.lit("pattern"))
    exact = T.agency_rows_exact(b.program_expenses, ["N7", "oct n7"]).withColumn("how", F.lit("exact"))
    labels = T.agency_labels(b.program_expenses, "N3").select("agency", F.lit("label").alias("how"), F.lit(0).cast("long").alias("n"))
    rows = loose.unionByName(exact).groupBy("agency", "how").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(labels)


@query("F8_known_measures")
def known(b: Bound) -> DataFrame:
    """Write-ups that also have figures or programs."""
    return b.measure_text.select("measure_id", *MEASURE_KEY).join(I.measure_keys(b.measure_impacts, b.measure_programs), MEASURE_KEY, "left_semi")


@query("F9_not_found")
def not_found(b: Bound) -> DataFrame:
    """Requested ids (of all printed phrases) that no table knows."""
    from vintagebook.functions.ids import measure_id

    requested = b.related.select(measure_id(F.col("phrase"), F.lit("2018-19 Budget")).alias("measure_id")).distinct()
    _, missing = I.split_request(requested, I.resolve_ids(b.measure_impacts, b.measure_programs, b.measure_text))
    return missing.select("measure_id")


# --- set operations ---------------------------------------------------------------------------------

@query("U1_union_of_keys")
def union_keys(b: Bound) -> DataFrame:
    return I.measure_keys(b.measure_impacts, b.measure_programs, b.measure_text)


@query("U2_union_of_agencies")
def union_agencies(b: Bound) -> DataFrame:
    return distinct_union(b.measure_impacts.select("agency", "portfolio"), b.measure_programs.select("agency", "portfolio"), b.program_expenses.select("agency", "portfolio"))


@query("U3_stale_keys")
def stale(b: Bound) -> DataFrame:
    """Names and editions of write-ups, which are those of their ids, that no figure has."""
    return b.text_ids.select(*MEASURE_KEY).subtract(b.measure_impacts.select(*MEASURE_KEY))


def _selection(b: Bound) -> tuple[DataFrame, DataFrame]:
    selected = b.base.where("gap = 0").select(F.col("r_name").alias("portfolio"), F.col("p_brand").alias("program_name"), F.col("p_type").alias("kind")).distinct()
    items = b.base.where("gap = 3").select(F.col("r_name").alias("portfolio"), F.col("p_brand").alias("program_name"), F.col("p_name").alias("kind")).distinct()
    return selected.groupBy("portfolio", "program_name").agg(F.min("kind").alias("kind")), items.where("kind like '%ring%'").groupBy("portfolio", "program_name").agg(F.min("kind").alias("kind"))


@query("U4_add_to_selection")
def add(b: Bound) -> DataFrame:
    return C.add_to_selection(*_selection(b), ["portfolio", "program_name"])


@query("U4_remove_from_selection")
def remove(b: Bound) -> DataFrame:
    return C.remove_from_selection(*_selection(b), ["portfolio", "program_name"])


@query("U4_toggle_selection")
def toggle(b: Bound) -> DataFrame:
    return C.toggle_selection(*_selection(b), ["portfolio", "program_name"])


@query("U5_assigned_ids")
def assigned(b: Bound) -> DataFrame:
    return I.assign_measure_ids(b.measure_records.select(*MEASURE_KEY))


@query("U5_assigned_ids_seeded")
def seeded(b: Bound) -> DataFrame:
    """New measures get ids while those of the write-ups stay as they are."""
    return I.assign_measure_ids(b.measure_records.select(*MEASURE_KEY), known=b.measure_text.select(*MEASURE_KEY, "measure_id"))


@query("U5_assigned_ids_crowded")
def crowded(b: Bound) -> DataFrame:
    """An id space hardly larger than the number of keys: collisions everywhere, ids as if keys came one at a time."""
    keys = b.documents.select(*MEASURE_KEY).distinct()
    out = I.assign_measure_ids(keys, space=keys.count() * 5 // 4 + 1)
    return out.select(*MEASURE_KEY, "measure_id")


@query("P7_canonical_join")
def canonical_join(b: Bound) -> DataFrame:
    return I.resolve_programs(b.measure_programs, b.program_expenses, b.agency_aliases, canonical=True).groupBy(
        canonical_portfolio(F.col("portfolio")).alias("portfolio"), "program_name"
    ).agg(F.count(F.lit(1)).alias("n"))
