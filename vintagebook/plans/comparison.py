"""Summaries over a selection of measures or programs, and the agency overlay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagebook.operators import measures as M
from vintagebook.operators import series as S
from vintagebook.operators.lookups import distinct_union


# --- selections ---------------------------------------------------------------------------

def add_to_selection(selection: DataFrame, items: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items already selected stay as they are; new ones are added once."""
    new = items.join(selection.select(*key), list(key), "left_anti").dropDuplicates(list(key))
    return selection.unionByName(new)


def remove_from_selection(selection: DataFrame, items: DataFrame, key: Sequence[str]) -> DataFrame:
    return selection.join(items.select(*key), list(key), "left_anti")


def toggle_selection(selection: DataFrame, items: DataFrame, key: Sequence[str]) -> DataFrame:
    """Selected items are dropped, others added: the symmetric difference by key."""
    kept = remove_from_selection(selection, items, key)
    new = items.join(selection.select(*key), list(key), "left_anti").dropDuplicates(list(key))
    return kept.unionByName(new)


# --- selected measures --------------------------------------------------------------------------

def combined_summary(impacts: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Matrix by direction and year, each measure's totals, and the agency with the largest effect."""
    return {
        "matrix": M.combined_matrix(impacts, keys),
        "measures": M.net_totals(impacts, [*keys, "measure_id", "measure_name", "edition"]),
        "dominant_agency": M.dominant_agency(impacts, keys),
    }


def program_comparison(expenses: DataFrame, latest: str) -> DataFrame:
    """Program by year matrix of stitched figures, as maps; a year without a figure is absent."""
    return S.figures_by_year(S.stitched_series(expenses, ["program_name"], latest), ["program_name"])


# --- agency overlay -------------------------------------------------------------------------------

def overlay_agencies(programs: DataFrame, impacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The agencies a measure can be shown for: from its programs or its impacts; one is the default."""
    every = distinct_union(programs.select(*keys, "agency"), impacts.select(*keys, "agency"))
    best = M.dominant_agency(impacts, keys).select(*keys, F.col("agency").alias("default_agency"))
    first = every.groupBy(*keys).agg(F.min("agency").alias("first_agency"))
    chosen = first.join(best, list(keys), "left").withColumn("default_agency", F.coalesce("default_agency", "first_agency"))
    return every.join(chosen.select(*keys, "default_agency"), list(keys)).withColumn(
        "is_default", F.col("agency") == F.col("default_agency")
    ).drop("default_agency")


def agency_overlay(
    programs: DataFrame, impacts: DataFrame, expenses: DataFrame, latest: str, keys: Sequence[str]
) -> DataFrame:
    """Lines of a measure's default agency: its programs' stitched series and the measure's own by direction."""
    default = overlay_agencies(programs, impacts, keys).where("is_default").select(*keys, "agency")
    touched = programs.where(F.coalesce(F.col("program_name"), F.lit("")) != "").select(*keys, "agency", "program_name").distinct()
    series = S.line_segments(S.stitched_series(expenses, ["program_name"], latest), ["program_name"]).drop("edition")
    lines = touched.join(default, [*keys, "agency"]).join(series, "program_name").select(
        *keys, "agency", F.lit("program").alias("line_kind"), F.col("program_name").alias("label"), "fiscal_year",
        "amount_thousands", "solid", "dashed",
    )
    own = M.direction_totals(impacts, [*keys, "agency"]).join(default, [*keys, "agency"]).select(
        *keys, "agency", F.lit("measure").alias("line_kind"), F.col("direction").alias("label"), "fiscal_year",
        "amount_thousands", F.lit(True).alias("solid"), F.lit(False).alias("dashed"),
    )
    return lines.unionByName(own)
