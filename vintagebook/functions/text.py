"""Cleaning and labelling of text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintagebook.functions import fixed as V


def strip_blanks(text: Column) -> Column:
    """Remove every kind of white space at both ends (``trim`` only knows U+0020)."""
    return F.regexp_replace(text, f"^{V.BLANKS}|{V.BLANKS}$", "")


def squash(text: Column) -> Column:
    """Null becomes "", hard blanks become blanks, runs of white space one blank."""
    soft = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), V.HARD_BLANKS, " ")
    return F.trim(F.regexp_replace(soft, V.BLANKS, " "))


def plain_punctuation(text: Column) -> Column:
    """Dash lookalikes to a hyphen, curly single quotes to a straight one."""
    return F.translate(
        text, V.DASH_VARIANTS + V.QUOTE_VARIANTS, "-" * len(V.DASH_VARIANTS) + "'" * len(V.QUOTE_VARIANTS)
    )


def canonical_measure_name(name: Column, from_table: bool = True) -> Column:
    """One spelling per measure: plain punctuation, no trailing footnote marks.

    Names typed into tables may also hide a zero-width space and separate the
    footnote marks with commas; names in prose do neither.
    """
    plain = plain_punctuation(name)
    if from_table:
        plain = F.translate(plain, V.ZERO_WIDTH_SPACE, "")
    marks = V.MEASURE_FOOTNOTES_TABLE if from_table else V.MEASURE_FOOTNOTES_PROSE
    return strip_blanks(F.regexp_replace(plain, marks, ""))


def phrase_key(phrase: Column) -> Column:
    """The form in which a quoted phrase is compared with measure names."""
    return F.lower(strip_blanks(plain_punctuation(phrase)))


def clean_program_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(squash(name), V.NAME_FOOTNOTES, ""))


def rejoin_drop_caps(heading: Column) -> Column:
    """ "T REASURY" -> "TREASURY": undo the gap a drop cap leaves behind."""
    return F.regexp_replace(
        F.regexp_replace(heading, "\\s+-", "-"), "\\b([A-Z])\\s+(?=[A-Z])", "$1"
    )


def is_placeholder_name(name: Column) -> Column:
    return name.rlike(V.PLACEHOLDER_NAME)


def ends_sentence(line: Column) -> Column:
    return F.regexp_replace(line, f"{V.BLANKS}$", "").rlike(V.SENTENCE_END)


def snippet(text: Column, query: Column | str, context: int = V.SNIPPET_CONTEXT) -> Column:
    """The first hit of ``query`` (any case) with ``context`` characters either side; null without a hit."""
    needle = F.lit(query) if isinstance(query, str) else query
    hit = F.instr(F.lower(text), F.lower(needle))
    start = F.greatest(F.lit(0), hit - 1 - context)
    end = F.least(F.length(text), hit - 1 + F.length(needle) + context)
    body = strip_blanks(F.substring(text, start + 1, end - start))
    cut = F.concat(
        F.when(start > 0, F.lit(V.ELLIPSIS)).otherwise(F.lit("")),
        body,
        F.when(end < F.length(text), F.lit(V.ELLIPSIS)).otherwise(F.lit("")),
    )
    return F.when((hit > 0) & (F.length(text) > 0), cut)


def opening_excerpt(text: Column, length: int = V.EXCERPT_LENGTH) -> Column:
    return strip_blanks(F.substring(F.coalesce(text, F.lit("")), 1, length))


def short_label(text: Column, length: int = V.LABEL_LENGTH) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, length), f"{V.BLANKS}$", "")
    return F.when(F.length(text) <= length, text).otherwise(F.concat(cut, F.lit(V.ELLIPSIS)))


def outcome_label(description: Column, number: Column) -> Column:
    """The description, or a label made from the number where the source states none."""
    has_text = description.isNotNull() & (strip_blanks(description) != "")
    fallback = F.concat(F.lit("Outcome "), number.cast("string"), F.lit(" (no description in source)"))
    return F.when(has_text, description).otherwise(fallback)
