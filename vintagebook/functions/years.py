"""Fiscal years ("2024-25") and editions ("2024-25 Budget")."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintagebook.functions import fixed as V
from vintagebook.functions.text import squash


def fiscal_year_in(text: Column, clean: bool = False) -> Column:
    """The first year span in a header cell, or null; ``clean`` if the text is squashed."""
    text = text if clean else squash(text)
    first = F.regexp_extract(text, V.YEAR_SPAN, 1)
    return F.when(first != "", F.concat_ws("-", first, F.regexp_extract(text, V.YEAR_SPAN, 2)))


def fiscal_year_label(start: Column) -> Column:
    """2024 -> "2024-25"."""
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def start_year(label: Column) -> Column:
    return F.substring(label, 1, 4).cast("int")


def publication_gap(budget_year: Column, fiscal_year: Column) -> Column:
    """How many years after the fiscal year the publication appeared."""
    return start_year(budget_year) - start_year(fiscal_year)


def budget_year_of(edition: Column, any_dash: bool = False) -> Column:
    """The edition's year; an edition without one stands for itself."""
    pattern = V.BUDGET_YEAR_ANY_DASH if any_dash else V.BUDGET_YEAR
    found = F.regexp_extract(edition, pattern, 1)
    if any_dash:
        found = F.translate(found, "–", "-")
    return F.when(found == "", edition).otherwise(found)


def edition_order(edition: Column) -> Column:
    """Sort key: the year, then Budget, then an October Budget, then the mid-year update."""
    year = F.coalesce(F.nullif(F.regexp_extract(edition, "(\\d{4})-\\d{2}", 1), F.lit("")).cast("int"), F.lit(0))
    low = F.lower(edition)
    part = F.when(low.contains("myefo"), 2).when(low.contains("october"), 1).otherwise(0)
    return year * 10 + part
