"""Queries over the program facts: series, vintages, revisions, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagebook.operators import measures as M
from vintagebook.operators import series as S
from vintagebook.plans import profiles as P
from vintagebook.plans import trends as T
from vintagebook.operators.ordered import ranked
from vintagebook.plans.bindings import Bound
from vintagebook.plans.registry import query

PROGRAM = ["program_name"]
SLICE = ("2016-17 October Budget", "2015-16")


@query("A1_stitched_series")
def stitched(b: Bound) -> DataFrame:
    return S.stitched_series(b.program_expenses, PROGRAM, b.latest)


@query("A1_stitched_series_per_agency_outcome")
def stitched_fine(b: Bound) -> DataFrame:
    return S.stitched_series(b.program_expenses, ["portfolio", "agency", "outcome_number", "program_name"], b.latest)


@query("A1_stitched_series_prefer_earliest")
def stitched_earliest(b: Bound) -> DataFrame:
    return S.stitched_series(b.program_expenses, PROGRAM, b.latest, prefer="earliest")


@query("A2_program_profile")
def program_profile(b: Bound) -> DataFrame:
    return P.program_profile(b.program_expenses, b.latest)


@query("A3_vintage_history")
def vintage_history(b: Bound) -> DataFrame:
    vintages = S.vintage_series(b.program_expenses, PROGRAM)
    point = F.transform("series", lambda p: F.concat_ws(":", p["fiscal_year"], p["estimate_type"], p["amount_thousands"].cast("string")))
    return vintages.select("program_name", "edition", "budget_year", F.array_join(point, ",").alias("series"))


@query("A3_actual_series")
def actual_series(b: Bound) -> DataFrame:
    return S.actual_series(b.program_expenses, PROGRAM)


@query("A4_portfolio_profile")
def portfolio_profile(b: Bound) -> DataFrame:
    return P.portfolio_profile(b.program_expenses, b.agency_aliases, b.latest)


@query("A5_agency_outcome_profile")
def agency_outcome_profile(b: Bound) -> DataFrame:
    requests = b.measure_records.select("agency", "portfolio", F.substring("edition", 1, 7).alias("budget_year")).distinct()
    return P.agency_outcome_profile(b.program_expenses, b.agency_aliases, b.latest, requests)


@query("W2_closest_publication")
def closest(b: Bound) -> DataFrame:
    keys = ["portfolio", "agency", "program_name", "program_number"]
    return S.closest_publication(b.program_expenses, keys, ["edition", "amount_thousands"])


@query("W4_line_segments")
def segments(b: Bound) -> DataFrame:
    return S.line_segments(S.stitched_series(b.program_expenses, PROGRAM, b.latest), PROGRAM)


@query("W5_year_window")
def year_window(b: Bound) -> DataFrame:
    sums = M.direction_totals(b.measure_impacts, ["measure_name", "edition", "agency"])
    points = sums.groupBy("measure_name", "edition", "agency", "fiscal_year").agg(
        F.sum(F.abs("amount_thousands")).alias("amount_thousands")
    )
    return S.year_window(points, ["measure_name", "edition", "agency"], ["edition"])


@query("W6_latest_meta")
def latest_meta(b: Bound) -> DataFrame:
    return S.entity_meta(b.program_expenses, ["agency", "program_name"], ["edition", "outcome_number", "outcome_description"], b.latest)


@query("W7_vintage_shade")
def vintage_shade(b: Bound) -> DataFrame:
    vintages = b.program_expenses.select("program_number", "edition", "budget_year").distinct()
    return S.vintage_shade(vintages, ["program_number"]).withColumn("shade", F.round("shade", 6))


@query("W8_orderings")
def orderings(b: Bound) -> DataFrame:
    """The rank of each program line in hierarchy order and by absolute total."""
    totals = b.program_expenses.groupBy("portfolio", "agency", "outcome_number", "program_number").agg(
        F.sum("amount_thousands").alias("total")
    )
    by_name = ["agency", "outcome_number", "program_number"]
    sized = ranked(totals, ["portfolio"], [F.desc(F.abs("total")), *by_name], "size_rank")
    return ranked(sized, ["portfolio"], by_name, "name_rank")


@query("W9_top_programs")
def top_programs(b: Bound) -> DataFrame:
    totals = b.program_expenses.groupBy("agency", "program_name").agg(F.sum("amount_thousands").alias("total"))
    return totals.orderBy(F.desc("total"), "agency", "program_name").limit(30)


@query("W10_forecast_revisions")
def revisions(b: Bound) -> DataFrame:
    return S.forecast_revisions(b.program_expenses, ["agency", "program_name"])


@query("S4_realised_scan")
def realised(b: Bound) -> DataFrame:
    return T.realised(b.program_expenses)


@query("F6_without_slice")
def without_slice(b: Bound) -> DataFrame:
    rows = S.without_slice(b.program_expenses, *SLICE)
    return rows.groupBy("edition", "fiscal_year").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_thousands").alias("total"))


@query("Q14_cleaned_actuals")
def cleaned(b: Bound) -> DataFrame:
    return T.cleaned_actuals(b.program_expenses, SLICE)


@query("A11_trend")
def trend(b: Bound) -> DataFrame:
    return T.trend(T.cleaned_actuals(b.program_expenses, SLICE))


@query("A11_trend_by_portfolio")
def trend_by_portfolio(b: Bound) -> DataFrame:
    return T.trend(T.cleaned_actuals(b.program_expenses, SLICE), ["portfolio_key"])


@query("Q14_top_portfolios_pivot")
def top_portfolios(b: Bound) -> DataFrame:
    profile = T.grouped_profile(T.realised(b.program_expenses), "portfolio", top=3)
    return S.figures_by_year(profile, ["label_group"]).withColumn("figures", S.figures_text(F.col("figures")))


@query("A18_distinct_counts")
def distinct_counts(b: Bound) -> DataFrame:
    """Distinct labels and share of missing descriptions, from one row per combination."""
    combos = b.program_expenses.groupBy("portfolio", "agency", "program_name", "outcome_description").agg(F.count(F.lit(1)).alias("n"))
    missing = F.when(F.coalesce(F.col("outcome_description"), F.lit("")) == "", F.col("n")).otherwise(0)
    return combos.groupBy("portfolio").agg(
        F.count_distinct("agency").alias("n_agencies"), F.count_distinct("program_name").alias("n_programs"),
        F.round(F.sum(missing) / F.sum("n"), 6).alias("missing_share"),
    )


@query("A19_top_groups")
def top_groups(b: Bound) -> DataFrame:
    return T.grouped_profile(T.realised(b.program_expenses), "program_name", by=["agency"], top=3)


@query("A20_backfilled_labels")
def backfilled(b: Bound) -> DataFrame:
    """Outcome labels after backfilling, counted per label; about half of the descriptions are missing."""
    from vintagebook.functions.text import outcome_label
    from vintagebook.operators.identity import backfill_labels

    missing = F.when(F.length("program_name") % 2 == 0, F.col("outcome_description"))
    rows = T.realised(b.program_expenses).withColumn("outcome_description", missing)
    keyed = rows.withColumn("outcome_label", outcome_label(F.col("outcome_description"), F.col("outcome_number")))
    by = ["agency", "budget_year", "program_name"]
    filled = backfill_labels(keyed, by, "outcome_number", "outcome_description", "outcome_label")
    return filled.groupBy("agency", "outcome_number", "outcome_label").agg(F.count(F.lit(1)).alias("n"))


@query("Q14_outcome_profile")
def outcome_profile(b: Bound) -> DataFrame:
    actuals = T.cleaned_actuals(b.program_expenses, SLICE)
    return T.grouped_profile(T.resolved_outcome_labels(actuals), "outcome_label", by=["agency"], top=4)


@query("Q14_program_profile")
def program_drill_down(b: Bound) -> DataFrame:
    actuals = T.cleaned_actuals(b.program_expenses, SLICE)
    chosen = T.outcome_filter(actuals, "promo")
    return T.grouped_profile(chosen, "program_name", by=["agency"], top=3)


@query("Q15_program_comparison")
def program_comparison(b: Bound) -> DataFrame:
    from vintagebook.plans.comparison import program_comparison as compare

    return compare(b.program_expenses, b.latest).withColumn("figures", S.figures_text(F.col("figures")))
