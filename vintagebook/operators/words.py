"""Positioned words of document pages to styled lines: text, style, indent and italic runs.

Words are (doc, page, text, x0, x1, top, font, size). All work is bounded by a page: words
move once, to their page, where lines start is a fold over the page's words in reading
order, and everything else is windows and islands within a line, which move nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagebook.functions import fixed as V

PAGE = ["doc", "page"]
LINE = ["doc", "page", "line"]
#: Line numbers of a document leave room for so many lines a page.
PAGE_LINES = 1 << 10


def _is_bold(font: Column) -> Column:
    return font.contains("Bold")


def _is_italic(font: Column) -> Column:
    return font.contains("Italic") | font.contains("Oblique")


def _is_bullet(font: Column, text: Column) -> Column:
    return F.replace(font, F.lit(" "), F.lit("")).contains("TimesNewRoman") & text.isin(*V.BULLET_GLYPHS)


def page_lines(words: DataFrame) -> DataFrame:
    """Visual lines (doc, page, line, words), the words of each from left to right.

    In reading order (rounded top, then x0) a word opens a line if it lies further than the
    tolerance below the word that opened the line before. Only words of the content band
    count. Lines stay where their page is.
    """
    inside = words.where(F.col("top").between(V.CONTENT_TOP, V.CONTENT_BOTTOM)).withColumn("band", F.rint("top")).repartition(*PAGE)
    order = ["band", "x0", "top", "x1", "text"]
    others = [c for c in words.columns if c not in [*PAGE, *order]]
    pages = inside.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*order, *others))).alias("w"))

    def state(i: Column, top: Column, opens: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), top.cast("double").alias("top"), opens.cast("array<int>").alias("opens"))

    def read(at: Column, word: Column) -> Column:
        new = at["top"].isNull() | (word["top"] - at["top"] > V.LINE_TOLERANCE)
        return F.when(new, state(at["i"] + 1, word["top"], F.concat(at["opens"], F.array(at["i"])))).otherwise(state(at["i"] + 1, at["top"], at["opens"]))

    opens = F.aggregate("w", state(F.lit(0), F.lit(None), F.array()), read, lambda at: at["opens"])

    def across(word: Column, i: Column) -> Column:
        return F.struct(word["x0"].alias("x0"), i.alias("place"), word["x1"].alias("x1"), word["text"].alias("text"), word["font"].alias("font"), word["size"].alias("size"))

    def line(start: Column, i: Column) -> Column:
        length = F.coalesce(F.get("opens", i + 1), F.size("w")) - start
        return F.struct((i + 1).alias("line"), F.slice("w", start + 1, length).alias("words"))

    placed = pages.select(*PAGE, "w", F.explode(F.array(opens)).alias("opens"))
    lines = placed.select(*PAGE, F.explode(F.transform("opens", line)).alias("l"))
    # words of one left edge stay in reading order
    return lines.select(*PAGE, "l.line", F.explode(F.array(F.array_sort(F.transform("l.words", across)))).alias("words"))


def _spaced(words: Column) -> Column:
    """Words run together where the gap between two is too small for a blank."""

    def joined(all_words: Column) -> Column:
        def piece(word: Column, i: Column) -> Column:
            gap = word["x0"] - F.get(all_words, i - 1)["x1"]
            return F.concat(F.when((i > 0) & (gap > V.WORD_GAP), F.lit(" ")).otherwise(F.lit("")), word["text"])

        return F.array_join(F.transform(all_words, piece), "")

    # as the element of an array, the words are made once and not again for every word
    return F.transform(F.array(words), joined)[0]


def _look(font: Column, size: Column, text: Column, x0: Column) -> Column:
    """What the first word says of its line; ``large`` may still turn out to be a divider."""
    bold, close = _is_bold(font), lambda to: F.abs(size - to) < V.SIZE_TOLERANCE
    return (
        F.when(bold & close(V.PORTFOLIO_SIZE), "portfolio")
        .when(bold & close(V.HEADING_SIZE), "heading")
        .when(_is_bullet(font, text), F.when(x0 < V.BULLET_INDENT, "bullet").otherwise("dash"))
        .when((font.contains("Arial") | font.contains("Helvetica")) & ~bold, "table")
        .when(bold & (size > V.DIVIDER_SIZE), "large")
        .otherwise("body")
    )


def _italic_runs(words: str, slanted: str) -> Column:
    """The runs of italic words of a line, in order; ``slanted`` are the places of such words."""
    at = lambda i: F.get(slanted, i)
    starts = F.filter(slanted, lambda p, i: (i == 0) | (at(i - 1) != p - 1))
    ends = F.filter(slanted, lambda p, i: (i == F.size(slanted) - 1) | (at(i + 1) != p + 1))
    return F.zip_with(starts, ends, lambda first, last: F.struct(
        (first == 0).alias("starts_first"), (last == F.size(words) - 1).alias("ends_last"),
        _spaced(F.slice(words, first + 1, last - first + 1)).alias("phrase"),
    ))


def lines_of_words(words: DataFrame) -> DataFrame:
    """Styled lines (doc, page, line_no, text, style, indent, italic_runs); ``line_no`` ascends over the pages of a document.

    The first word decides the style: bold at the size of portfolios or of measure headings,
    a bullet glyph in its own font (by indent a bullet or a dash), plain sans for tables, a
    large bold appendix title as divider, else body. A bullet's text leaves out its glyph.
    """
    first = F.get("words", F.lit(0))
    looked = page_lines(words).select(
        *LINE, "words", first["x0"].alias("indent"), F.explode(F.array(_look(first["font"], first["size"], first["text"], first["x0"]))).alias("look"),
        (_is_bold(first["font"]) & (first["size"] > V.DIVIDER_SIZE)).alias("large"),
    )
    shown = F.when(F.col("look").isin("bullet", "dash"), F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))).otherwise(F.col("words"))
    cut = looked.select(*LINE, "indent", "look", "large", F.explode(F.array(shown)).alias("w"))
    places = F.filter(F.transform("w", lambda w, i: F.when(_is_italic(w["font"]), i)), lambda i: i.isNotNull())
    lines = cut.select(*LINE, "indent", "look", "large", "w", F.explode(F.array(_spaced(F.col("w")))).alias("text"), places.alias("slanted"))
    divider = F.col("large") & F.col("text").rlike(V.NEXT_APPENDIX)
    style = F.when(divider, "divider").when(F.col("look") == "large", "body").otherwise(F.col("look"))
    return lines.select(
        "doc", "page", (F.col("page") * PAGE_LINES + F.col("line")).alias("line_no"), "text", style.alias("style"), "indent",
        _italic_runs("w", "slanted").alias("italic_runs"),
    )
