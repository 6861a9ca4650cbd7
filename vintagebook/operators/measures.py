"""Measures: impacts, touched programs, the catalogue, matrices and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagebook.functions.names import canonical_portfolio
from vintagebook.operators.identity import MEASURE_KEY
from vintagebook.operators.lookups import salted_lookup
from vintagebook.operators.ordered import ranked

LINE_KEY = ["edition", "measure_name", "portfolio", "agency", "direction", "source_file"]


def combine_impacts(records: DataFrame, keys: Sequence[str] = LINE_KEY) -> DataFrame:
    """One figure per file, measure, agency, direction and fiscal year."""
    return records.groupBy(*keys, "fiscal_year").agg(F.sum("amount_thousands").alias("amount_thousands"))


def programs_touched(records: DataFrame, keys: Sequence[str] = LINE_KEY) -> DataFrame:
    """The distinct programs of each measure line; a line may name several programs at once."""
    return records.select(*keys, "is_departmental", F.explode("programs").alias("program_number")).distinct()


def catalogue(texts: DataFrame, impacts: DataFrame, programs: DataFrame) -> DataFrame:
    """Every (measure, edition) of all three sources with its portfolios, agencies and whether it has figures.

    Each source is reduced to its distinct (measure, portfolio, agency) first, so the
    collected sets hold distinct portfolios and agencies only.
    """
    def part(table: DataFrame, priority: int, has_figures: bool) -> DataFrame:
        agency = F.col("agency") if has_figures else F.lit(None).cast("string")
        shown = F.col("portfolio") if has_figures else F.nullif(F.col("portfolio"), F.lit(""))
        return table.groupBy(*MEASURE_KEY, shown.alias("portfolio"), agency.alias("agency")).agg(
            F.max("measure_id").alias("measure_id")
        ).select("*", F.lit(priority).alias("priority"), F.lit(has_figures).alias("has_figures"))

    rows = part(texts, 0, False).unionByName(part(impacts, 1, True)).unionByName(part(programs, 2, True))
    return catalogue_of_rows(rows)


def catalogue_of_rows(rows: DataFrame, keys: Sequence[str] = MEASURE_KEY) -> DataFrame:
    canonical = rows.withColumn("portfolio", canonical_portfolio(F.col("portfolio")))
    return canonical.groupBy(*keys).agg(
        F.max_by("measure_id", F.struct("priority", "measure_id")).alias("measure_id"),
        F.array_sort(F.collect_set("portfolio")).alias("portfolios"),
        F.array_sort(F.collect_set("agency")).alias("agencies"),
        F.bool_or("has_figures").alias("has_financial_data"),
    )


def direction_totals(impacts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return impacts.groupBy(*keys, "fiscal_year", "direction").agg(F.sum("amount_thousands").alias("amount_thousands"))


def _matrix(impacts: DataFrame, keys: Sequence[str], row: str | None) -> DataFrame:
    """Figures as a map by fiscal year, per (keys, direction) and, with ``row``, per row and for all rows.

    One aggregation over grouping sets gives the cells of all levels and the years that a
    matrix has; every row then gets all years of its matrix, absent cells as 0. No list of
    years is asked for, and no job looks for them first.
    """
    own, by = list(keys) or ["__all"], [*(list(keys) or ["__all"]), "direction"]
    year, extra = "fiscal_year", [row] if row else []
    sets = [[*by, *extra, year], *([[*by, year]] if row else []), [*own, year]]
    cells = impacts.withColumn("__all", F.lit(0)).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in sets[0]]).agg(
        F.sum("amount_thousands").alias("amount"), F.grouping("direction").alias("__years"),
        (F.grouping(row) if row else F.lit(0)).alias("__total"),
    )
    years = cells.where("__years = 1").groupBy(*own).agg(F.array_sort(F.collect_set(year)).alias("years"))
    rows = cells.where("__years = 0").groupBy(*by, *extra, "__total").agg(F.map_from_entries(F.collect_list(F.struct(year, "amount"))).alias("figures"))
    filled = F.map_from_entries(F.transform("years", lambda y: F.struct(y, F.coalesce(F.try_element_at("figures", y), F.lit(0).cast("long")))))
    return rows.join(years, own).withColumn("figures", filled).drop("years", *([] if keys else ["__all"]))


def impact_matrix(impacts: DataFrame, keys: Sequence[str], row: str = "agency") -> DataFrame:
    """Agency by year per direction: ``figures`` maps every year of the matrix to an amount; a "Total" row per direction."""
    out = _matrix(impacts, keys, row).withColumn("is_total", F.col("__total") == 1).drop("__total")
    return out.withColumn(row, F.when(F.col("is_total"), F.lit("Total")).otherwise(F.col(row)))


def combined_matrix(impacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Direction by year over all measures of a selection, as a map."""
    return _matrix(impacts, keys, None).drop("__total")


def net_totals(impacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Payments and receipts netted into one figure, and each direction's own."""
    return impacts.groupBy(*keys).agg(
        F.sum("amount_thousands").alias("net_total"),
        F.coalesce(F.sum(F.when(F.col("direction") == "payment", F.col("amount_thousands"))), F.lit(0)).alias("payment_total"),
        F.coalesce(F.sum(F.when(F.col("direction") == "receipt", F.col("amount_thousands"))), F.lit(0)).alias("receipt_total"),
    )


def dominant_agency(impacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The agency with the largest absolute sum; ties go to the smaller name."""
    totals = impacts.groupBy(*keys, "agency").agg(F.sum("amount_thousands").alias("total"))
    rank = F.struct(-F.abs("total"), F.col("agency"))
    grouped = totals.groupBy(*keys) if keys else totals.groupBy()
    return grouped.agg(F.min_by(F.struct("agency", "total"), rank).alias("b")).select(*keys, "b.agency", "b.total")


def merged_programs(programs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Funding channels of one program merged into one row, with the measures that touch it.

    ``channels`` holds at most two values; ``touched_by`` counts distinct measures,
    the pairs themselves are in :func:`program_touches`.
    """
    channel = F.when(F.col("is_departmental"), F.lit("Departmental")).otherwise(F.lit("Administered"))
    row = [*keys, "agency", "direction", "program_number", "program_name"]
    per_measure = programs.groupBy(*row, "measure_id").agg(
        F.collect_set(channel).alias("channels"), F.min("portfolio").alias("portfolio")
    )
    return per_measure.groupBy(*row).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("channels")))).alias("channels"),
        F.count("measure_id").alias("touched_by"),
        F.min("portfolio").alias("portfolio"),
    )


def program_touches(programs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(program row, measure) pairs, each once."""
    return programs.select(
        *keys, "agency", "direction", "program_number", "program_name", "measure_id", "measure_name"
    ).distinct()


def programs_by_agency(merged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merged program rows with their place in their agency's list, ordered by name, and the agency's portfolio.

    A row per program, so that an agency of any size is spread over tasks.
    """
    owner = merged.groupBy(*keys, "agency").agg(F.min("portfolio").alias("__portfolio"))
    placed = ranked(merged, [*keys, "agency"], ["program_name", "program_number", "direction"], "place")
    return salted_lookup(placed, owner, [*keys, "agency"], how="inner").withColumn("portfolio", F.col("__portfolio")).drop("__portfolio")


def grouped_financials(financials: DataFrame) -> DataFrame:
    """Year values nested per (measure, type, related, department), in row and year order."""
    value = F.struct("row_ordinal", "year_index", "value_kind", "value_numeric_million", "value_raw")
    grouped = financials.groupBy("measure_id", "impact_type", "is_related", "department_name").agg(
        F.min("row_ordinal").alias("first_row"), F.sort_array(F.collect_list(value)).alias("values")
    )
    return grouped


def ordered_financials(grouped: DataFrame) -> DataFrame:
    """Groups of figures with their position in the measure's table: by type, own before related, then as printed."""
    shown = Window.partitionBy("measure_id").orderBy("impact_type", "is_related", "first_row", "department_name")
    return grouped.withColumn("position", F.row_number().over(shown))


def reconcile(parsed: DataFrame, printed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parsed sums against the printed totals, with the difference; 0 means they agree."""
    sums = parsed.groupBy(*keys).agg(F.sum("amount_thousands").alias("parsed_total"))
    totals = printed.groupBy(*keys).agg(F.sum("amount_thousands").alias("printed_total"))
    joined = sums.join(totals, list(keys), "full_outer")
    return joined.withColumn(
        "difference", F.coalesce("parsed_total", F.lit(0)) - F.coalesce("printed_total", F.lit(0))
    )


def first_of_duplicates(records: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keep the first record per key in source order; an aggregate, so duplicates fold before the shuffle."""
    best = records.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("b"))
    return best.select(*keys, "b.*")


def conflicting_duplicates(records: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str = "amount_thousands") -> DataFrame:
    """Later records of a key whose amount differs from the kept one."""
    kept = records.groupBy(*keys).agg(
        F.min_by(amount, F.struct(*order)).alias("kept_amount"),
        F.min(amount).alias("__low"), F.max(amount).alias("__high"),
    ).where(F.col("__low") != F.col("__high")).drop("__low", "__high")
    return records.join(kept, list(keys)).where(F.col(amount) != F.col("kept_amount")).withColumnRenamed(
        amount, "dropped_amount"
    )
