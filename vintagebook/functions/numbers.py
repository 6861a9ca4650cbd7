"""Numbers as cells hold them: commas, accounting brackets, withheld markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintagebook.functions import fixed as V
from vintagebook.functions.text import squash

_PLAIN_NUMBER = "^-?\\d+(\\.\\d+)?$"


def _parsed(value: Column, clean: bool = False) -> Column:
    digits = F.replace(value if clean else squash(value), F.lit(","), F.lit(""))
    signed = F.translate(digits, "()", "-")
    return F.when(signed.rlike(_PLAIN_NUMBER), signed.try_cast("double"))


def numeric_like(value: Column, num: Column | None = None, clean: bool = False) -> Column:
    """The number a cell holds with its decimals, or null. ``num`` is set for typed number cells, ``clean`` if the value is squashed."""
    if num is None:
        return _parsed(value, clean)
    return F.when(num.isNotNull(), F.nullif(num, F.lit(float("nan")))).otherwise(_parsed(value, clean))


def to_amount(value: Column, num: Column | None = None, clean: bool = False) -> Column:
    """The cell as a whole amount, halves to even; null where it is no number."""
    return F.rint(numeric_like(value, num, clean)).cast("long")


def money_cell(raw: Column) -> Column:
    """Three states: a number ("-" is a true nil), or a marker that is kept as written."""
    digits = F.replace(raw, F.lit(","), F.lit(""))
    number = F.when(raw == "-", F.lit(0.0)).when(digits.rlike(_PLAIN_NUMBER), digits.try_cast("double"))
    return F.struct(
        F.when(number.isNotNull(), F.lit("numeric")).otherwise(F.lit("special")).alias("value_kind"),
        number.alias("value_numeric_million"),
        raw.alias("value_raw"),
    )


def is_data_like(value: Column, num: Column | None = None, clean: bool = False) -> Column:
    """A number or a marker standing in for one; not a blank, not a bare footnote mark."""
    return numeric_like(value, num, clean).isNotNull() | is_marker(value, value if clean else squash(value))


def is_marker(value: Column, text: Column) -> Column:
    """Whether a cell that holds no number stands in for one; ``text`` is its value squashed."""
    return value.isNotNull() & (text != "") & ~text.rlike(V.FOOTNOTE_MARKER)


def canonical_direction(word: Column) -> Column:
    """Both eras' words for a measure category; null for any other word."""
    pairs = [F.lit(x) for pair in V.DIRECTION_WORDS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(word))


def is_receipt_like(label: Column) -> Column:
    low = F.lower(label)
    return low.contains("receipt") | low.contains("revenue")


def program_number_text(value: Column, num: Column | None = None) -> Column:
    """2.0 -> "2", 1.8 -> "1.8"; text that is no number is only squashed."""
    return number_text(numeric_like(value, num), squash(value))


def number_text(number: Column, text: Column) -> Column:
    """The same where the number a cell holds and its squashed text are known."""
    whole = number == F.floor(number)
    decimal_text = F.regexp_replace(F.format_string("%.6f", number), "0+$", "")
    return (
        F.when(number.isNotNull() & whole, number.cast("long").cast("string"))
        .when(number.isNotNull(), decimal_text)
        .otherwise(text)
    )


def program_list(text: Column) -> Column:
    """ "1.3, 1.5" -> [1.3, 1.5]; "All" -> []; null where the text is no program list."""
    items = F.transform(F.split(text, "[,&;]"), lambda item: F.trim(item))
    return F.when(
        text.rlike(V.PROGRAM_LIST),
        F.when(F.lower(text) == "all", F.array().cast("array<string>")).otherwise(items),
    )


def departmental_number(number: Column, is_departmental: Column) -> Column:
    """A bare outcome number on a departmental line means the whole outcome: "1" -> "1.0"."""
    bare = is_departmental & ~number.contains(".")
    return F.when(bare, F.concat(number, F.lit(".0"))).otherwise(number)


def departmental_label(number: Column) -> Column:
    return F.concat(F.lit("Departmental (Outcome "), F.element_at(F.split(number, "\\."), 1), F.lit(")"))


def leading_outcome(number: Column) -> Column:
    """The outcome a program number belongs to, null where it is no whole number."""
    return F.element_at(F.split(number, "\\."), 1).try_cast("int")


def similarity(squared_distance: Column) -> Column:
    """Squared distance of unit vectors -> cosine similarity, never below 0."""
    return F.greatest(F.lit(0.0), 1 - squared_distance / 2)


def _scaled(magnitude: Column, unit: int, decimals: int) -> Column:
    """magnitude / unit as text with a fixed number of decimals, halves up, in whole-number arithmetic."""
    step = unit // 10**decimals
    scaled = F.floor((magnitude + step // 2) / step).cast("long") if step > 1 else magnitude
    scale = 10**decimals
    head = F.floor(scaled / scale).cast("long")
    if decimals == 0:
        return head.cast("string")
    tail = F.lpad((scaled % scale).cast("string"), decimals, "0")
    return F.concat(head.cast("string"), F.lit("."), tail)


def dollars_label(thousands: Column) -> Column:
    """$'000 -> "$1.25B", "-$3.4M", "$12K"."""
    dollars = F.abs(thousands.cast("long")) * 1000
    sign = F.when(thousands < 0, F.lit("-$")).otherwise(F.lit("$"))
    return F.concat(
        sign,
        F.when(dollars >= 10**9, F.concat(_scaled(dollars, 10**9, 2), F.lit("B")))
        .when(dollars >= 10**6, F.concat(_scaled(dollars, 10**6, 1), F.lit("M")))
        .when(dollars >= 10**3, F.concat(_scaled(dollars, 10**3, 0), F.lit("K")))
        .otherwise(dollars.cast("string")),
    )


def millions_cell(thousands: Column) -> Column:
    """$'000 as $m with one decimal and thousands separators; nil is "-"."""
    tenths = F.floor((F.abs(thousands.cast("long")) + 50) / 100).cast("long")
    body = F.concat(
        F.format_number(F.floor(tenths / 10).cast("long"), 0), F.lit("."), (tenths % 10).cast("string")
    )
    signed = F.concat(F.when(thousands < 0, F.lit("-")).otherwise(F.lit("")), body)
    return F.when(F.coalesce(thousands, F.lit(0)) == 0, F.lit("-")).otherwise(signed)
