"""Profiles of measures, programs, portfolios and agencies, for any number of them in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagebook.functions.names import canonical_portfolio
from vintagebook.operators import identity as I
from vintagebook.operators import measures as M
from vintagebook.operators import series as S
from vintagebook.operators.identity import MEASURE_KEY
from vintagebook.operators.lookups import salted_lookup

PROGRAM = ["program_name"]
PROGRAM_COLUMNS = [
    *MEASURE_KEY, "measure_id", "portfolio", "agency", "direction", "program_number", "is_departmental",
    "program_name", "outcome_number", "outcome_description",
]

_PROGRAM_PART = {
    "program_number": "string", "is_departmental": "boolean", "program_name": "string", "outcome_number": "int", "outcome_description": "string",
}


# --- measures ---------------------------------------------------------------------------

def restrict(table: DataFrame, keys: DataFrame | None, on: Sequence[str] = MEASURE_KEY) -> DataFrame:
    return table if keys is None else table.join(keys.select(*on).distinct(), list(on), "left_semi")


def measure_impacts_shown(impacts: DataFrame, aliases: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Impact rows of the wanted measures with the agency's display name."""
    shown = I.with_display_agency(restrict(impacts, keys), aliases)
    return shown.withColumn("agency", F.col("display_agency")).drop("display_agency")


def measure_programs_shown(
    programs: DataFrame, expenses: DataFrame, aliases: DataFrame, keys: DataFrame | None = None, canonical: bool = False
) -> DataFrame:
    """Touched programs of the wanted measures, resolved, with the agency's display name."""
    resolved = I.resolve_programs(restrict(programs, keys), expenses, aliases, canonical)
    shown = I.with_display_agency(resolved, aliases)
    return shown.withColumn("agency", F.col("display_agency")).select(*PROGRAM_COLUMNS)


def measure_heads(
    impacts: DataFrame, programs: DataFrame, aliases: DataFrame, keys: DataFrame | None = None, canonical: bool = False
) -> DataFrame:
    """One row per measure that has figures or programs: id, portfolios (raw unless canonical), agencies, counts."""
    def part(table: DataFrame, priority: int) -> DataFrame:
        return restrict(table, keys).groupBy(*MEASURE_KEY, "portfolio", "agency").agg(
            F.max("measure_id").alias("measure_id"), F.count(F.lit(1)).alias("n")
        ).withColumn("priority", F.lit(priority))

    rows = part(impacts, 0).unionByName(part(programs, 1))
    shown = I.with_display_agency(rows, aliases)
    portfolio = canonical_portfolio(F.col("portfolio")) if canonical else F.col("portfolio")
    return shown.groupBy(*MEASURE_KEY).agg(
        F.min_by("measure_id", "priority").alias("measure_id"),
        F.array_sort(F.collect_set(portfolio)).alias("portfolios"),
        F.array_sort(F.collect_set("display_agency")).alias("agencies"),
        F.sum(F.when(F.col("priority") == 0, F.col("n")).otherwise(0)).alias("n_impacts"),
        F.sum(F.when(F.col("priority") == 1, F.col("n")).otherwise(0)).alias("n_programs"),
    )


def requested_measures(requested: DataFrame, impacts: DataFrame, programs: DataFrame, texts: DataFrame) -> DataFrame:
    """(position, measure_id, measure_name, edition) of a request; unknown ids have no name. Tables are reduced to the ids asked for first."""
    resolved = I.resolve_ids(impacts, programs, texts, only=requested)
    return requested.select("position", "measure_id").join(resolved.drop("source"), "measure_id", "left")


def combined_measures(
    requested: DataFrame, texts: DataFrame, impacts: DataFrame, programs: DataFrame, aliases: DataFrame
) -> DataFrame:
    """Requested (position, measure_id) with their measures, a row per position; text-only measures have empty lists; unknown ids are marked not found."""
    found = requested_measures(requested, impacts, programs, texts)
    heads = measure_heads(impacts, programs, aliases, found.where("measure_name is not null"), canonical=True).drop("measure_id")
    own = restrict(texts, found).groupBy(*MEASURE_KEY).agg(F.min_by("portfolio", "id").alias("text_portfolio"))
    joined = found.join(heads, MEASURE_KEY, "left").join(own, MEASURE_KEY, "left")
    empty = F.array().cast("array<string>")
    lone = F.when(
        F.coalesce(F.col("text_portfolio"), F.lit("")) != "", F.array(canonical_portfolio(F.col("text_portfolio")))
    ).otherwise(empty)
    return joined.select(
        "position", "measure_id", *MEASURE_KEY,
        F.coalesce("portfolios", F.when(F.col("measure_name").isNotNull(), lone)).alias("portfolios"),
        F.coalesce("agencies", F.when(F.col("measure_name").isNotNull(), empty)).alias("agencies"),
        F.coalesce("n_impacts", F.lit(0)).alias("n_impacts"), F.coalesce("n_programs", F.lit(0)).alias("n_programs"),
        F.col("n_impacts").isNotNull().alias("has_financial_data"), F.col("measure_name").isNull().alias("not_found"),
    )


def combined_rows(
    requested: DataFrame, texts: DataFrame, impacts: DataFrame, programs: DataFrame, expenses: DataFrame, aliases: DataFrame
) -> DataFrame:
    """The impact and program rows of every requested measure: one long table by position, kind and place in its list.

    Facts are reduced to the request's measures first and shown once per measure; a
    measure asked for twice gets its rows at both positions.
    """
    found = requested_measures(requested, impacts, programs, texts).where("measure_name is not null")
    shown_impacts = measure_impacts_shown(impacts, aliases, found).select(
        *MEASURE_KEY, F.lit("impact").alias("kind"), "id", "portfolio", "agency", "direction", "fiscal_year", "amount_thousands",
        *[F.lit(None).cast(t).alias(c) for c, t in _PROGRAM_PART.items()],
    )
    resolved = I.with_display_agency(I.resolve_programs(restrict(programs, found), expenses, aliases), aliases)
    shown_programs = resolved.select(
        *MEASURE_KEY, F.lit("program").alias("kind"), "id", "portfolio", F.col("display_agency").alias("agency"), "direction",
        F.lit(None).cast("string").alias("fiscal_year"), F.lit(None).cast("long").alias("amount_thousands"), *_PROGRAM_PART,
    )
    listed = Window.partitionBy(*MEASURE_KEY, "kind").orderBy("id")
    rows = shown_impacts.unionByName(shown_programs).withColumn("row_no", F.row_number().over(listed)).drop("id")
    return found.select("position", "measure_id", *MEASURE_KEY).join(rows, MEASURE_KEY)


def measures_by_program(
    impacts: DataFrame, programs: DataFrame, expenses: DataFrame, aliases: DataFrame, wanted: DataFrame | None = None
) -> DataFrame:
    """(program, canonical portfolio) with every measure that touches it and that measure's head."""
    index = I.program_reverse_index(programs, expenses, aliases)
    index = restrict(index, wanted, ["program_name", "portfolio"])
    heads = measure_heads(impacts, programs, aliases, index, canonical=True)
    return salted_lookup(index, heads, MEASURE_KEY, how="inner", spread=["program_name", "portfolio"])


def write_up(
    texts: DataFrame, components: DataFrame, related: DataFrame, financials: DataFrame, impacts: DataFrame, keys: DataFrame | None = None
) -> dict[str, DataFrame]:
    """A write-up's parts: head, components by ordinal, related measures, figures by position."""
    head = restrict(texts, keys)
    ids = head.select("measure_id").distinct()
    own = related.join(ids.withColumnRenamed("measure_id", "text_id"), "text_id", "left_semi")
    return {
        "head": head,
        "components": components.join(ids, "measure_id", "left_semi"),
        "related_measures": I.related_measures(own, texts, impacts),
        "headline_financials": M.ordered_financials(M.grouped_financials(financials.join(ids, "measure_id", "left_semi"))),
    }


# --- programs ------------------------------------------------------------------------------

def program_profile(expenses: DataFrame, latest: str, programs: Sequence[str] | None = None) -> DataFrame:
    """The stitched series of each program with its current outcome."""
    facts = expenses if programs is None else expenses.where(F.col("program_name").isin(list(programs)))
    series = S.stitched_series(facts, PROGRAM, latest)
    meta = S.entity_meta(facts, PROGRAM, ["outcome_number", "outcome_description"], latest)
    return series.join(meta, PROGRAM)


def estimate_history(expenses: DataFrame, latest: str, programs: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Each edition's own series per program (with its shade), and the realised series."""
    facts = expenses if programs is None else expenses.where(F.col("program_name").isin(list(programs)))
    return {
        "vintages": S.vintage_shade(S.vintage_series(facts, PROGRAM), PROGRAM),
        "actual_series": S.actual_series(facts, PROGRAM),
        "meta": S.entity_meta(facts, PROGRAM, ["outcome_number", "outcome_description"], latest),
    }


def program_hierarchy(expenses: DataFrame, aliases: DataFrame, latest: str) -> DataFrame:
    """Portfolio > agency > outcome > program across all editions, one description per outcome.

    Facts shrink to their distinct combinations before any name is looked up.
    """
    columns = ["portfolio", "agency", "edition", "outcome_number", "outcome_description", "program_number", "program_name"]
    combos = expenses.groupBy(*columns).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    shown = I.with_display_agency(combos, aliases).withColumns(
        {"portfolio": canonical_portfolio(F.col("portfolio")), "agency": F.col("display_agency")}
    )
    current = F.col("edition") == latest
    rank = F.struct(current.cast("int"), F.when(current, F.col("last_id")).otherwise(-F.col("first_id")))
    outcome = ["portfolio", "agency", "outcome_number"]
    described = shown.groupBy(*outcome).agg(F.max_by(F.struct("outcome_description"), rank).alias("d"))
    programs = shown.select(*outcome, "program_number", "program_name").distinct()
    return programs.join(described, outcome).select(
        *outcome, F.col("d.outcome_description").alias("outcome_description"), "program_number", "program_name"
    )


# --- portfolios and agencies ---------------------------------------------------------------------

def _linked_series(expenses: DataFrame, agencies: DataFrame, aliases: DataFrame, latest: str, extra: Sequence[str] = ()) -> DataFrame:
    """Stitched series per (portfolio, agency), summed over all spellings of the agency.

    Facts are summed per spelling first; only those sums meet the spellings.
    """
    points = S.summed_points(expenses, ["portfolio", "agency", *extra]).withColumnRenamed("agency", "spelling")
    linked = I.agency_spellings(agencies, aliases).join(points, ["portfolio", "spelling"])
    return S.stitched_series(linked, ["portfolio", "agency", *extra], latest)


def portfolio_profile(expenses: DataFrame, aliases: DataFrame, latest: str, wanted: DataFrame | None = None) -> DataFrame:
    """For each (portfolio, budget_year) the agencies of that year, each with its series over all years."""
    snapshot = expenses.select("portfolio", "budget_year", "agency").distinct()
    snapshot = restrict(snapshot, wanted, ["portfolio", "budget_year"])
    series = _linked_series(expenses, snapshot, aliases, latest)
    return snapshot.join(series, ["portfolio", "agency"])


def agency_outcome_profile(expenses: DataFrame, aliases: DataFrame, latest: str, requests: DataFrame) -> DataFrame:
    """For each requested (agency, portfolio, budget_year) the year's outcomes with their series over all years."""
    resolved = I.same_year_short_name(requests.distinct(), aliases).select(
        F.col("agency").alias("requested_agency"), F.col("resolved_agency").alias("agency"), "portfolio", "budget_year"
    )
    names = I.agency_spellings(resolved, aliases)
    filed = expenses.groupBy(
        "portfolio", F.col("agency").alias("spelling"), "budget_year", "outcome_number", "outcome_description"
    ).agg(F.count(F.lit(1)).alias("n"))
    outcomes = resolved.join(names, ["agency", "portfolio"]).join(filed, ["portfolio", "spelling", "budget_year"]).select(
        "requested_agency", "agency", "portfolio", "budget_year", "outcome_number", "outcome_description"
    ).distinct()
    series = _linked_series(expenses, resolved.select("agency", "portfolio"), aliases, latest, ["outcome_number"])
    return outcomes.join(series, ["portfolio", "agency", "outcome_number"])
