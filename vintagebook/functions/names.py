"""Names of files, sheets, agencies and portfolios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintagebook.functions import fixed as V
from vintagebook.functions.text import strip_blanks


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), "^(\\.*[^.].*)\\.[^.]*$", "$1")


def clean_agency(path: Column) -> Column:
    """The agency a workbook's file name stands for; the bare stem where nothing is left."""
    stem = file_stem(path)
    words = F.regexp_replace(F.regexp_replace(stem, V.AGENCY_NOISE, " "), "[\\-–_]+", " ")
    tidy = F.regexp_replace(F.regexp_replace(words, V.BLANKS, " "), "^[ \\-–]+|[ \\-–]+$", "")
    return F.when(tidy == "", stem).otherwise(tidy)


def clean_portfolio_folder(folder: Column) -> Column:
    return strip_blanks(F.regexp_replace(folder, V.FOLDER_YEAR_PREFIX, ""))


def strip_portfolio_prefix(raw: Column) -> Column:
    bare = F.regexp_replace(strip_blanks(raw), V.PORTFOLIO_YEAR_PREFIX, "")
    no_digit = F.regexp_replace(bare, "(?<=[A-Za-z])\\d+$", "")
    return strip_blanks(F.regexp_replace(no_digit, V.BLANKS, " "))


def canonical_portfolio(raw: Column) -> Column:
    """The portfolio's display name: prefix dropped, then an exact lookup of known variants."""
    pairs = [F.lit(x) for pair in V.PORTFOLIO_NAMES.items() for x in pair]
    bare = strip_portfolio_prefix(raw)
    known = F.coalesce(F.try_element_at(F.create_map(*pairs), bare), bare)
    return F.when(raw.isNull() | (raw == ""), raw).otherwise(known)


def portfolio_family(raw: Column) -> Column:
    """The first family with a keyword contained in the name, else the name itself."""
    low = F.lower(raw)
    chain = None
    for family, keywords in V.PORTFOLIO_FAMILIES:
        hit = low.contains(keywords[0])
        for keyword in keywords[1:]:
            hit = hit | low.contains(keyword)
        chain = F.when(hit, F.lit(family)) if chain is None else chain.when(hit, F.lit(family))
    return chain.otherwise(raw)


def formal_agency_name(title: Column) -> Column:
    """The agency named in a resource table's title row, or null."""
    plain = strip_blanks(F.translate(title, "–—­", "-- "))
    found = F.regexp_extract(plain, V.TITLE_OF_RESOURCE_TABLE, 1)
    name = strip_blanks(F.regexp_replace(strip_blanks(found), "-+$", ""))
    return F.nullif(name, F.lit(""))


def is_measure_sheet(name: Column) -> Column:
    return name.rlike(V.SHEET_TOKEN_1_2) & ~name.rlike(V.SHEET_NAME_EXCLUSIONS)


def is_resource_sheet(name: Column) -> Column:
    return name.rlike(V.SHEET_TOKEN_1_1) & ~name.rlike("(?iU)^program\\b")


def edition_from_path(path: Column) -> Column:
    """.../<edition>/<portfolio>/<workbook> -> edition."""
    return F.regexp_extract(path, "([^/]+)/[^/]+/[^/]+$", 1)


def portfolio_from_path(path: Column) -> Column:
    return clean_portfolio_folder(F.regexp_extract(path, "([^/]+)/[^/]+$", 1))
