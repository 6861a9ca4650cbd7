"""Positioned words to styled lines, and whole write-ups read from words."""

import random

import pytest
from pyspark.sql import functions as F

from vintagebook.operators import writeups as W
from vintagebook.operators.ordered import RANGE, ordered_state, with_ranges
from vintagebook.operators.words import PAGE_LINES, lines_of_words
from vintagebook.schemas import WORDS

SANS, BOLD, SERIF, SLANT, GLYPH = "ABCDEE+Arial", "Arial-BoldMT", "BookAntiqua", "BookAntiqua-Italic", "Times New Roman"


def printed(spec, doc="d", page=1, top=120.0):
    """Words of lines (pieces (text, font), size, x0), 14 points apart; a piece that starts with + touches the one before."""
    words = []
    for pieces, size, x in spec:
        for text, font in pieces:
            touching = text.startswith("+")
            for i, word in enumerate(text.lstrip("+").split(" ")):
                x += 0.0 if touching and i == 0 else 4.0
                words.append((doc, page, word, x, x + 8.0, top, font, size))
                x += 8.0
        top += 14.0
    return words


def lines_of(spark, words):
    return {r["line_no"] - r["page"] * PAGE_LINES: r for r in lines_of_words(spark.createDataFrame(words, WORDS)).collect()}


def test_styles_come_from_the_first_word(spark):
    spec = [
        ([("I NFRASTRUCTURE", BOLD)], 13.2, 86.0), ([("Supporting News", BOLD), ("and more", SERIF)], 10.2, 86.0), ([("Payments ($m)", SANS)], 8.0, 86.0),
        ([("Related receipts ($m)", "Helvetica-Oblique")], 8.0, 86.0), ([("•", GLYPH), ("a fund", SERIF)], 10.0, 100.0), ([("–", "TimesNewRomanPSMT"), ("a part", SERIF)], 10.0, 110.0),
        ([("– not a glyph", SERIF)], 10.0, 86.0), ([("Bold of another size", BOLD)], 11.0, 86.0), ([("Appendix B: Risks", BOLD)], 15.0, 86.0), ([("Large", BOLD)], 15.0, 86.0),
        ([("Appendix C has more", BOLD)], 11.0, 86.0), ([("•", GLYPH)], 10.0, 90.0), ([("Appendix D: Taxes", BOLD)], 13.3, 86.0),
    ]
    found = lines_of(spark, printed(spec))
    assert [(found[i]["style"], found[i]["text"]) for i in sorted(found)] == [
        ("portfolio", "I NFRASTRUCTURE"), ("heading", "Supporting News and more"), ("table", "Payments ($m)"), ("table", "Related receipts ($m)"), ("bullet", "a fund"),
        ("dash", "a part"), ("body", "– not a glyph"), ("body", "Bold of another size"), ("divider", "Appendix B: Risks"), ("body", "Large"), ("body", "Appendix C has more"),
        ("bullet", ""), ("divider", "Appendix D: Taxes"),
    ]
    assert found[5]["indent"] == 104.0


def test_touching_words_and_italic_runs(spark):
    spec = [
        ([("The", SERIF), ("Indigenous Broadcasting", SLANT)], 10.0, 86.0), ([("Program", SLANT), ("and Australia", SERIF), ("+’", GLYPH), ("+s", SERIF), ("+–", SLANT), ("Act", SLANT), ("end", SERIF)], 10.0, 86.0),
        ([("all of it", SLANT)], 10.0, 86.0), ([("•", GLYPH), ("News", SLANT), ("Fund", SERIF)], 10.0, 90.0), ([("none", SERIF)], 10.0, 86.0),
    ]
    found = lines_of(spark, printed(spec))
    runs = [[tuple(r) for r in found[i]["italic_runs"]] for i in sorted(found)]
    assert runs == [
        [(False, True, "Indigenous Broadcasting")], [(True, False, "Program"), (False, False, "– Act")], [(True, True, "all of it")], [(True, False, "News")], [],
    ]
    assert found[2]["text"] == "Program and Australia’s– Act end"


def folded(words):
    """Lines by a plain walk over the words."""
    out = {}
    for doc, page in {(w[0], w[1]) for w in words}:
        inside = sorted((w for w in words if (w[0], w[1]) == (doc, page) and 110 <= w[5] <= 730), key=lambda w: (round(w[5]), w[3], w[5], w[4], w[2]))
        lines, anchor = [], None
        for w in inside:
            if anchor is None or abs(w[5] - anchor) > 2.5:
                lines.append([])
                anchor = w[5]
            lines[-1].append(w)
        for n, line in enumerate(lines, 1):
            line.sort(key=lambda w: w[3])
            out[doc, page, page * PAGE_LINES + n] = sorted(w[2] for w in line)
    return out


@pytest.mark.parametrize("dense", [False, True])
def test_lines_equal_a_walk_over_the_words(spark, dense):
    """Baselines at random, also where every word is a little lower than the one before and on exact tolerances."""
    rng = random.Random(6)
    words = []
    for page in range(1, 9):
        tops = [rng.choice([rng.uniform(100, 740), rng.randrange(110, 731) + rng.choice([0, 0.5, 0.7, 1.4])]) for _ in range(150)]
        if dense:
            tops = [110 + i * rng.choice([0.1, 0.5, 1.25, 2.5]) for i in range(240)]
        words += [("d", page, f"w{i}", rng.uniform(70, 500), 505.0, float(top), SERIF, 10.0) for i, top in enumerate(tops)]
    found = lines_of_words(spark.createDataFrame(words, WORDS)).collect()
    assert {(r["doc"], r["page"], r["line_no"]): sorted(r["text"].replace("w", " w").split()) for r in found} == folded(words)


def test_a_page_of_100_000_words(spark):
    words = spark.range(100_000).select(
        F.lit("d").alias("doc"), F.lit(1).alias("page"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), (F.floor(F.col("id") / 40) * 10.0).alias("x0"),
        (F.floor(F.col("id") / 40) * 10.0 + 7).alias("x1"), (F.lit(120.0) + (F.col("id") % 40) * 14 + F.rand(3)).alias("top"), F.lit(SERIF).alias("font"), F.lit(10.0).alias("size"),
    )
    found = lines_of_words(words).select("line_no", F.size(F.split("text", " ")).alias("n"), F.substring("text", 1, 4).alias("t")).collect()
    assert sorted((r["line_no"], r["n"]) for r in found) == [(PAGE_LINES + i, 2500) for i in range(1, 41)]


def long_document(n, doc):
    """A document of n measures: every kind of line, runs of headings and portfolios over page breaks."""
    rng, words, rows = random.Random(n), [], [([("Part 2: Payment Measures", SERIF)], 10.0, 86.0)]
    for m in range(n):
        if m % 7 == 0:
            rows += [([(f"P ORTFOLIO {m}", BOLD)], 12.96, 86.0)] * (1 + m % 3)
        rows += [([(f"Measure {m}", BOLD)], 9.96, 86.0)] * (1 + m % 2)
        rows += [([("Payments ($m)", SANS)], 8.0, 86.0), ([("2015-16 2016-17", SANS)], 8.0, 86.0), ([("Department 1.5 -", SANS)], 8.0, 86.0), ([("of Things", SANS)], 8.0, 86.0)]
        rows += [([("Total – Payments 1.5 -", SANS)], 8.0, 86.0)] if m % 2 else []
        rows += [([("The Program", SERIF), (f"Number {m % 5}", SLANT)], 10.0, 86.0), ([("Extension", SLANT), ("ends.", SERIF)], 10.0, 86.0)]
        for _ in range(rng.randrange(4)):
            rows += [([(rng.choice("•–"), GLYPH), (f"part {m}", SERIF)], 10.0, rng.choice([90.0, 120.0])), ([("goes on.", SERIF)], 10.0, 120.0)]
        rows += [([("Text after it.", SERIF)], 10.0, 86.0)]
    for at in range(0, len(rows), 40):
        words += printed(rows[at : at + 40], doc, 1 + at // 40)
    return words


def read(lines, spread):
    segmented = W.segmented_lines(W.gated_lines(lines, spread), spread)
    prose = W.prose_lines(segmented, spread)
    parts = W.components(prose, spread)
    return [W.page_sections(lines, spread), W.measures_of(segmented), W.financial_rows(segmented, spread), parts, W.related_phrases(prose, spread), W.full_texts(parts)]


def test_a_document_with_most_of_the_lines_is_read_in_ranges(spark):
    words = long_document(150, "long") + long_document(4, "short") + long_document(3, "tiny")
    lines = lines_of_words(spark.createDataFrame(words, WORDS)).cache()
    assert lines.where("doc = 'long'").count() > 0.9 * lines.count()
    for plain, cut in zip(read(lines, False), read(lines, True)):
        assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
    sizes = [r["count"] for r in W.gated_lines(lines, True).groupBy(RANGE).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)


def test_runs_over_cuts(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [(k, i, rng.choice(["h", "h", "h", "p", None])) for k, n in (("a", 400), ("b", 30), ("c", 1)) for i in range(n)]
        frame = spark.createDataFrame(rows, "k string, i int, v string").repartition(5)
        runs = {"h": (F.col("v"), "h"), "p": (F.col("v"), "p")}
        want, counts, before = [], {}, {}
        for k, i, v in rows:
            if v is not None:
                counts[k, v] = counts.get((k, v), 0) + (before.get(k) != v)
                before[k] = v
            want.append((k, i, v, counts.get((k, "h"), 0), counts.get((k, "p"), 0)))
        for made in (ordered_state(frame, ["k"], "i", runs=runs), ordered_state(frame, ["k"], "i", runs=runs, spread=True), ordered_state(with_ranges(frame, ["k"], "i"), ["k"], "i", runs=runs, spread=True).drop(RANGE)):
            assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)


def test_words_move_once(spark):
    """Lines are read where the words of their page are: one exchange, and no job before the rows are asked for."""
    spec = [([("one two", SERIF)], 10.0, 86.0), ([("three", SLANT)], 10.0, 86.0)]
    made = lines_of_words(spark.createDataFrame(printed(spec), WORDS))
    assert [r["text"] for r in made.orderBy("line_no").collect()] == ["one two", "three"]
    assert str(made._jdf.queryExecution().sparkPlan()).count("Exchange") <= 1
    assert made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_words_of_a_page_move_once_and_stay_with_their_line(spark):
    words = spark.createDataFrame([("a", 1, "Budget", 90.0, 120.0, 200.0, "BookAntiqua", 10.02)], WORDS)
    plan = lines_of_words(words)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.count("Aggregate") == 1 and "Window" not in plan
    assert [(r["text"], r["style"]) for r in lines_of_words(words).collect()] == [("Budget", "body")]
