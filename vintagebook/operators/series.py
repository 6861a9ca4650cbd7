"""Series over publications: the best known figure per year, vintages, revisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagebook.functions import fixed as V
from vintagebook.functions.years import edition_order, publication_gap
from vintagebook.operators.lookups import salted_lookup

ACTUAL = V.ESTIMATE_TYPES[0]


def summed_points(facts: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One figure per entity, year, estimate type and edition; hot entities shrink before the shuffle."""
    return facts.groupBy(*keys, "fiscal_year", "estimate_type", "edition", *extra).agg(
        F.sum("amount_thousands").alias("amount_thousands")
    )


def stitched_series(facts: DataFrame, keys: Sequence[str], latest: str, prefer: str = "latest") -> DataFrame:
    """Per entity and fiscal year the most authoritative figure.

    An estimated actual beats everything; a year without one takes the figure of
    the ``latest`` edition, budget before forward estimate. Of several actuals the
    one from the latest edition is used, or from the earliest with ``prefer="earliest"``.
    """
    points = summed_points(facts, keys)
    actual = F.col("estimate_type") == ACTUAL
    usable = points.where(actual | (F.col("edition") == latest))
    order = edition_order(F.col("edition"))
    freshness = order if prefer == "latest" else -order
    rank = F.struct(
        actual.cast("int"),
        F.when(actual, freshness).otherwise(0),
        F.when(actual, F.col("edition")).otherwise(F.lit("")),
        (F.col("estimate_type") == "budget").cast("int"),
    )
    best = usable.groupBy(*keys, "fiscal_year").agg(
        F.max_by(F.struct("estimate_type", "edition", "amount_thousands"), rank).alias("best")
    )
    return best.select(*keys, "fiscal_year", "best.*")


def entity_meta(facts: DataFrame, keys: Sequence[str], columns: Sequence[str], latest: str) -> DataFrame:
    """Descriptive columns from the first row of the latest edition, else from the last row of all."""
    current = F.col("edition") == latest
    rank = F.struct(current.cast("int"), F.when(current, -F.col("id")).otherwise(F.col("id")))
    best = facts.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("meta"))
    return best.select(*keys, "meta.*")


def vintage_points(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every edition's own figures, nothing replaced by later ones (long form)."""
    return summed_points(facts, keys, extra=["budget_year"])


def vintage_series(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per entity and edition with its ordered points; a handful of years per row."""
    points = vintage_points(facts, keys)
    point = F.struct("fiscal_year", "estimate_type", "amount_thousands")
    return points.groupBy(*keys, "edition", "budget_year").agg(F.sort_array(F.collect_list(point)).alias("series"))


def actual_series(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The realised figure per year, from the latest edition that reports one."""
    points = summed_points(facts.where(F.col("estimate_type") == ACTUAL), keys)
    order = F.struct(edition_order(F.col("edition")), F.col("edition"))
    return points.groupBy(*keys, "fiscal_year").agg(
        F.max_by(F.struct("edition", "amount_thousands"), order).alias("best")
    ).select(*keys, "fiscal_year", "best.*")


def vintage_shade(vintages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position of each edition among its entity's editions, 0 to 1; a single edition is 1.

    Input is one row per (entity, edition): the window is over editions, not facts.
    """
    order = Window.partitionBy(*keys).orderBy("budget_year", "edition")
    whole = Window.partitionBy(*keys)
    return vintages.withColumn(
        "shade", F.when(F.count(F.lit(1)).over(whole) == 1, F.lit(1.0)).otherwise(F.percent_rank().over(order))
    )


def forecast_revisions(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How each target year's figure moved from one edition to the next that states it."""
    points = facts.groupBy(*keys, "fiscal_year", "budget_year", "edition").agg(
        F.sum("amount_thousands").alias("amount_thousands")
    )
    order = Window.partitionBy(*keys, "fiscal_year").orderBy("budget_year", "edition")
    return points.withColumn("previous_amount", F.lag("amount_thousands").over(order)).withColumn(
        "revision", F.col("amount_thousands") - F.col("previous_amount")
    )


def line_segments(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which points a solid and a dashed line go through.

    The dashed line starts one point before the first projected one so that the
    two lines touch. Input is a stitched series: one row per entity and year.
    """
    order = Window.partitionBy(*keys).orderBy("fiscal_year")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    projected = F.max((F.col("estimate_type") != ACTUAL).cast("int"))
    after = order.rowsBetween(Window.unboundedPreceding, 1)
    return series.withColumn("solid", projected.over(upto) == 0).withColumn("dashed", projected.over(after) == 1)


def year_window(points: DataFrame, keys: Sequence[str], by: Sequence[str], minimum: int = V.MIN_TABLE_YEARS) -> DataFrame:
    """The years a table shows: first to last non-zero year, padded to ``minimum`` available years.

    The years available to an entity are those of all points that share its ``by`` columns:
    one list per ``by``, looked up with salt by one row per entity. The years shown are a
    slice of that list, so entities meet no years but their own.
    """
    nonzero = F.when(F.col("amount_thousands") != 0, F.col("fiscal_year"))
    span = points.groupBy(*keys).agg(
        F.coalesce(F.min(nonzero), F.min("fiscal_year")).alias("first_year"),
        F.coalesce(F.max(nonzero), F.max("fiscal_year")).alias("last_year"),
    )
    available = points.groupBy(*by).agg(F.array_sort(F.collect_set("fiscal_year")).alias("years"))
    first = F.array_position("years", F.col("first_year"))
    last = F.greatest(F.array_position("years", F.col("last_year")), first + minimum - 1)
    shown = F.slice("years", first.cast("int"), (last - first + 1).cast("int"))
    return salted_lookup(span, available, by, how="inner", spread=keys).select(*keys, F.explode(shown).alias("fiscal_year"))


def closest_publication(facts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One figure per key and fiscal year, from the publication nearest to that year.

    An aggregate, not a window: each task keeps one candidate per key before the shuffle.
    """
    gap = publication_gap(F.col("budget_year"), F.col("fiscal_year"))
    rank = F.struct(-gap, edition_order(F.col("edition")), F.col("edition"), -F.col("id"))
    best = facts.groupBy(*keys, "fiscal_year").agg(F.max_by(F.struct(*columns, gap.alias("gap")), rank).alias("best"))
    return best.select(*keys, "fiscal_year", "best.*")


def without_slice(facts: DataFrame, edition: str, fiscal_year: str) -> DataFrame:
    return facts.where(~((F.col("edition") == edition) & (F.col("fiscal_year") == fiscal_year)))


def top_group_labels(facts: DataFrame, label: str, out: str, top: int = V.TOP_GROUPS, by: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = the label if it is among the ``top`` by total (per ``by``), else "Other".

    The ranking runs on one total per label; ties go to the smaller label.
    """
    totals = facts.groupBy(*by, label).agg(F.sum("amount_thousands").alias("__total"))
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc("__total"), label)
        leaders = totals.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= top)
    else:
        leaders = totals.orderBy(F.desc("__total"), label).limit(top).withColumn("__rank", F.lit(1))
    marks = leaders.select(*by, label, "__rank")
    joined = salted_lookup(facts, marks, [*by, label])
    return joined.withColumn(out, F.when(F.col("__rank").isNotNull(), F.col(label)).otherwise(F.lit("Other"))).drop("__rank")


def figures_by_year(points: DataFrame, keys: Sequence[str], value: str = "amount_thousands") -> DataFrame:
    """One row per key, its figures as a map by fiscal year; a year without a figure is absent."""
    cells = points.groupBy(*keys, "fiscal_year").agg(F.sum(value).alias(value))
    return cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("fiscal_year", value))).alias("figures"))


def figures_text(figures: Column) -> Column:
    """A map of figures as text, in the order of years."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(figures)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
