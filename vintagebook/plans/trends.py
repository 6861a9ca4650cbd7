"""Roll-ups of realised figures: trend, portfolio families, outcome and program profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagebook.functions.names import portfolio_family
from vintagebook.functions.text import outcome_label
from vintagebook.operators import identity as I
from vintagebook.operators import series as S

ACTUAL_COLUMNS = [
    "edition", "budget_year", "portfolio", "agency", "outcome_number", "outcome_description", "program_number",
    "program_name", "fiscal_year", "amount_thousands", "id",
]


def realised(expenses: DataFrame) -> DataFrame:
    """The estimated actuals; filter and columns reach the scan."""
    return expenses.where(F.col("estimate_type") == S.ACTUAL).select(*ACTUAL_COLUMNS)


def cleaned_actuals(expenses: DataFrame, drop_slice: tuple[str, str] | None = None) -> DataFrame:
    """One realised figure per (family, program, number, year), from the closest publication."""
    rows = realised(expenses)
    if drop_slice:
        rows = S.without_slice(rows, *drop_slice)
    rows = rows.withColumn("portfolio_key", portfolio_family(F.col("portfolio")))
    keys = ["portfolio_key", "program_name", "program_number"]
    columns = ["edition", "budget_year", "agency", "outcome_number", "outcome_description", "amount_thousands", "id"]
    best = S.closest_publication(rows, keys, columns)
    return best.withColumn("outcome_label", outcome_label(F.col("outcome_description"), F.col("outcome_number")))


def trend(actuals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return actuals.groupBy("fiscal_year", *by).agg(F.sum("amount_thousands").alias("amount_thousands"))


def agency_rows(facts: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Rows whose agency contains any of the patterns, in any case."""
    return facts.where(F.col("agency").rlike("(?i)" + "|".join(patterns)))


def agency_rows_exact(facts: DataFrame, labels: Sequence[str]) -> DataFrame:
    return facts.where(F.lower("agency").isin([label.lower() for label in labels]))


def agency_labels(facts: DataFrame, part: str) -> DataFrame:
    return facts.where(F.lower("agency").rlike(part.lower())).select("agency").distinct()


def resolved_outcome_labels(actuals: DataFrame, by: Sequence[str] = ("agency",)) -> DataFrame:
    """Labels with unambiguous descriptions filled in."""
    return I.backfill_labels(actuals, by, "outcome_number", "outcome_description", "outcome_label")


def grouped_profile(actuals: DataFrame, label: str, by: Sequence[str] = (), top: int = 8) -> DataFrame:
    """Year by group totals with the largest groups by name and the rest as "Other"."""
    marked = S.top_group_labels(actuals, label, "label_group", top, by)
    return marked.groupBy(*by, "fiscal_year", "label_group").agg(F.sum("amount_thousands").alias("amount_thousands"))


def outcome_filter(actuals: DataFrame, part: Column | str) -> DataFrame:
    return actuals.where(F.lower("outcome_label").contains(F.lower(F.lit(part) if isinstance(part, str) else part)))
