"""Queries that run each column function over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagebook.functions import ids
from vintagebook.functions import names as N
from vintagebook.functions import numbers as U
from vintagebook.functions import text as T
from vintagebook.functions import years as Y
from vintagebook.operators import measure_tables, program_tables
from vintagebook.plans.bindings import Bound
from vintagebook.plans.registry import query


def counted(df: DataFrame, *columns: Column) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def items(b: Bound, *columns: str) -> DataFrame:
    return b.table("lineitem").select(*columns)


@query("C1_squash")
def squash(b: Bound) -> DataFrame:
    messy = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" ­\t")), F.lit("_x000D_"))
    return b.table("documents").select("doc_id", F.md5(T.squash(messy)).alias("digest"), F.length(T.squash(messy)).alias("n"))


@query("C2_clean_agency")
def clean_agency(b: Bound) -> DataFrame:
    year = F.concat(Y.fiscal_year_label(F.year("l_shipdate") + 20), F.lit(" PBS "))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Tables", "cleaned", "Portfolio Budget Statements", "PAES", "excel tables", "Statement")]), F.col("l_linenumber") % 6 + 1)
    stem = F.concat(year, F.lit("Agency_"), (F.col("l_suppkey") % 50).cast("string"), F.lit(" - "), kind)
    path = F.concat(F.lit("data/x/"), F.when(F.col("l_linenumber") == 7, F.concat(year, F.lit("tables"))).otherwise(stem), F.lit(".xlsx"))
    return counted(items(b, "l_shipdate", "l_linenumber", "l_suppkey"), path.alias("path"), N.clean_agency(path).alias("agency"))


@query("C3_clean_portfolio_folder")
def portfolio_folder(b: Bound) -> DataFrame:
    folder = F.concat(F.element_at(F.array(F.lit("2021-22 PBS "), F.lit("2022–23 pbs "), F.lit("")), F.col("l_linenumber") % 3 + 1), F.col("l_shipmode_like"))
    rows = items(b, "l_linenumber", "l_returnflag", "l_linestatus").withColumn("l_shipmode_like", F.concat_ws(" & ", "l_returnflag", "l_linestatus"))
    return counted(rows, folder.alias("folder"), N.clean_portfolio_folder(folder).alias("portfolio"))


@query("C4_strip_portfolio_prefix")
def strip_prefix(b: Bound) -> DataFrame:
    raw = F.concat(
        F.element_at(F.array(F.lit("2021-22 PBS "), F.lit(" 2020-21 paes  "), F.lit("2023-24 MYEFO "), F.lit("")), F.col("l_linenumber") % 4 + 1),
        F.lit("Brand  "), F.col("l_returnflag"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise(F.lit(" ")),
    )
    return counted(items(b, "l_linenumber", "l_returnflag"), raw.alias("raw"), N.strip_portfolio_prefix(raw).alias("portfolio"))


@query("C5_canonical_portfolio")
def canonical_portfolio(b: Bound) -> DataFrame:
    return counted(b.documents, F.col("portfolio").alias("raw"), N.canonical_portfolio(F.col("portfolio")).alias("portfolio"))


@query("C6_portfolio_family")
def portfolio_family(b: Bound) -> DataFrame:
    return counted(b.documents, F.col("portfolio").alias("raw"), N.portfolio_family(F.col("portfolio")).alias("family"))


@query("C7_budget_year")
def budget_year(b: Bound) -> DataFrame:
    day = F.year("o_orderdate") + 20
    edition = F.when(F.month("o_orderdate") == 1, F.lit("Mini update")).otherwise(F.concat(F.lit("Draft "), Y.fiscal_year_label(day), F.lit(" Budget")))
    dashed = F.translate(edition, "-", "–")
    return counted(b.table("orders"), edition.alias("edition"), Y.budget_year_of(edition).alias("year"), Y.budget_year_of(dashed, any_dash=True).alias("built_year"))


@query("C8_fiscal_year")
def fiscal_year(b: Bound) -> DataFrame:
    year = F.year("l_shipdate") + 20
    cell = F.concat(F.lit("FY "), year.cast("string"), F.element_at(F.array(F.lit("-"), F.lit(" to "), F.lit("/\n")), F.col("l_linenumber") % 3 + 1), ((year + 1) % 100).cast("string"), F.lit(" $'000"))
    shown = F.when(F.col("l_returnflag") == "R", F.lit("no year here")).otherwise(cell)
    return counted(items(b, "l_shipdate", "l_linenumber", "l_returnflag"), shown.alias("cell"), Y.fiscal_year_in(shown).alias("fiscal_year"))


@query("C9_year_arithmetic")
def year_arithmetic(b: Bound) -> DataFrame:
    label = Y.fiscal_year_label(F.year("o_orderdate") + 20)
    other = Y.fiscal_year_label(F.year("o_orderdate") + 22)
    return counted(b.table("orders"), label.alias("label"), Y.start_year(label).alias("start"), Y.publication_gap(other, label).alias("gap"))


def amount_text(column: str = "l_extendedprice") -> Column:
    number = F.format_number(F.col(column), 2)
    turn = F.col("l_linenumber")
    return (
        F.when(turn == 1, F.concat(F.lit("("), number, F.lit(")"))).when(turn == 2, F.lit("nfp")).when(turn == 3, F.lit(".."))
        .when(turn == 4, F.concat(F.lit(" "), number, F.lit(" "))).otherwise(F.col(column).cast("decimal(18,2)").cast("string"))
    )


@query("C10_to_amount")
def to_amount(b: Bound) -> DataFrame:
    rows = items(b, "l_extendedprice", "l_quantity", "l_linenumber", "l_returnflag")
    half = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") + 0.5)
    amount = U.to_amount(amount_text(), half)
    return rows.groupBy("l_linenumber", "l_returnflag").agg(F.sum(amount).alias("total"), F.count(amount).alias("n_numbers"), F.count(F.lit(1)).alias("n"))


@query("C11_numeric_like")
def numeric_like(b: Bound) -> DataFrame:
    rows = items(b, "l_extendedprice", "l_linenumber", "l_orderkey", "l_partkey")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.round(U.numeric_like(amount_text()), 2).alias("number"))


@query("C12_money_cell")
def money_cell(b: Bound) -> DataFrame:
    raw = F.when(F.col("l_linenumber") == 5, F.lit("-")).otherwise(F.translate(amount_text(), "()", "-"))
    return items(b, "l_extendedprice", "l_linenumber", "l_orderkey", "l_partkey").select(
        "l_orderkey", "l_partkey", "l_linenumber", U.money_cell(raw).alias("v")
    ).select("l_orderkey", "l_partkey", "l_linenumber", "v.*")


@query("C13_is_data_like")
def data_like(b: Bound) -> DataFrame:
    turn = F.col("l_linenumber")
    raw = F.when(turn == 1, F.lit("(a)")).when(turn == 2, F.lit(" ")).when(turn == 3, F.lit(None)).when(turn == 6, F.lit("(Bc)")).otherwise(amount_text())
    return items(b, "l_extendedprice", "l_linenumber").groupBy("l_linenumber").agg(
        F.sum(U.is_data_like(raw).cast("long")).alias("n_data"), F.count(F.lit(1)).alias("n")
    )


def printed_name() -> Column:
    dash = F.element_at(F.array(*[F.lit(d) for d in " – | — | ‑ | ─ | ‐ ".split("|")]), F.col("p_size") % 5 + 1)
    marks = F.element_at(F.array(F.lit(""), F.lit(" (a)"), F.lit(" (b),(d)"), F.lit("​ (abc) (d)")), F.col("p_size") % 4 + 1)
    return F.concat(F.col("p_type"), F.lit("’s"), dash, F.col("p_name"), marks)


@query("C14_canonical_measure_name")
def canonical_name(b: Bound) -> DataFrame:
    name = printed_name()
    return counted(
        b.table("part"), name.alias("printed"), T.canonical_measure_name(name).alias("from_table"),
        T.canonical_measure_name(name, from_table=False).alias("from_prose"),
    )


@query("C15_phrase_key")
def phrase_key(b: Bound) -> DataFrame:
    phrase = F.concat(F.lit(" \t"), printed_name())
    return counted(b.table("part"), T.phrase_key(phrase).alias("key"))


@query("C16_clean_program_name")
def program_name(b: Bound) -> DataFrame:
    name = F.concat(F.col("p_name"), F.element_at(F.array(F.lit(" (a)"), F.lit("  (a) (b) "), F.lit(" (ab)"), F.lit("")), F.col("p_size") % 4 + 1))
    return counted(b.table("part"), name.alias("printed"), T.clean_program_name(name).alias("name"))


@query("C17_direction_words")
def direction_words(b: Bound) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in ("Receipts", "REVENUE", "payment", "Expenses", "Capital", "Equity", "Expense")]), F.col("l_linenumber"))
    return counted(items(b, "l_linenumber"), word.alias("word"), U.canonical_direction(word).alias("direction"), U.is_receipt_like(word).alias("receipt_like"))


@query("C18_rejoin_drop_caps")
def drop_caps(b: Bound) -> DataFrame:
    word = F.upper("p_name")
    broken = F.regexp_replace(word, "\\b([A-Z])", "$1 ")
    heading = F.concat(broken, F.lit(" -"), broken)
    return counted(b.table("part"), heading.alias("heading"), T.rejoin_drop_caps(heading).alias("joined"))


@query("C19_measure_id")
def measure_id(b: Bound) -> DataFrame:
    return b.documents.select("doc_id", ids.measure_id(F.col("measure_name"), F.col("edition")).alias("measure_id"), ids.measure_id(F.col("measure_name"), F.col("edition"), 1).alias("salted_id"))


@query("C20_snippet")
def snippet(b: Bound) -> DataFrame:
    return b.table("documents").select("doc_id", T.snippet(F.col("text"), "The And").alias("snippet"))


@query("C21_opening_excerpt")
def excerpt(b: Bound) -> DataFrame:
    return b.table("documents").select("doc_id", T.opening_excerpt(F.col("text")).alias("excerpt"))


@query("C22_edition_order")
def edition_order(b: Bound) -> DataFrame:
    return counted(b.base, F.col("edition"), Y.edition_order(F.col("edition")).alias("sort_key"))


@query("C23_program_list")
def program_list(b: Bound) -> DataFrame:
    a, c = (F.col("l_partkey") % 9 + 1).cast("string"), (F.col("l_suppkey") % 5 + 1).cast("string")
    turn = F.col("l_linenumber")
    text = (
        F.when(turn == 1, F.concat(a, F.lit("."), c, F.lit(" & 2.3"))).when(turn == 2, F.concat(a, F.lit("; "), c)).when(turn == 3, F.lit("All"))
        .when(turn == 4, F.concat(a, F.lit(".0"))).when(turn == 5, F.concat(a, F.lit("."), c, F.lit(", 3.1"))).otherwise(F.lit("various"))
    )
    shown = U.program_number_text(text)
    return counted(items(b, "l_partkey", "l_suppkey", "l_linenumber"), text.alias("cell"), F.array_join(U.program_list(shown), "|").alias("programs"), U.program_list(shown).isNull().alias("is_label"))


@query("C24_departmental")
def departmental(b: Bound) -> DataFrame:
    number = F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_suppkey") % 7).cast("string")).otherwise(F.concat((F.col("l_suppkey") % 7).cast("string"), F.lit(".1")))
    dep = F.col("l_linestatus") == "O"
    return counted(items(b, "l_linenumber", "l_suppkey", "l_linestatus"), number.alias("stated"), dep.alias("is_departmental"), U.departmental_number(number, dep).alias("number"), U.departmental_label(number).alias("label"))


@query("C25_formal_agency_name")
def formal_name(b: Bound) -> DataFrame:
    title = F.concat(F.lit(" Table 1.1"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(": ")).otherwise(F.lit("  ")), F.col("s_name"), F.lit(" – "),
                     F.when(F.col("s_suppkey") % 3 == 0, F.lit("measures")).otherwise(F.lit(" Resource  statement 2016")))
    return counted(b.table("supplier"), title.alias("title"), N.formal_agency_name(title).alias("formal_name"))


@query("C26_sheet_classes")
def sheet_classes(b: Bound) -> DataFrame:
    names = ("Table 1.2", "T_1.2", "2.1.2 Prog 1.2", "Program 1.2", "old 1.2", "1.1 Resources", "Table 1.2 Footnotes", "1.2.1", "program 1.1", "Prog Exp 1.2", "1.2 levies", "11.2")
    name = F.concat(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("l_partkey") % len(names) + 1).cast("int")), F.lit(" "), F.col("l_returnflag"))
    return counted(items(b, "l_partkey", "l_returnflag"), name.alias("sheet"), N.is_measure_sheet(name).alias("is_measures"), N.is_resource_sheet(name).alias("is_resources"))


@query("C27_labels_of_money")
def money_labels(b: Bound) -> DataFrame:
    power = F.element_at(F.array(*[F.lit(p) for p in (1, 100, 10_000, 1)]), F.col("l_linenumber") % 4 + 1)
    amount = F.when(F.col("l_linenumber") == 7, 0).otherwise((F.round("l_extendedprice").cast("long") * power - 50_000))
    return items(b, "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").select(
        "l_orderkey", "l_partkey", "l_linenumber", U.dollars_label(amount).alias("dollars"), U.millions_cell(amount).alias("millions")
    )


@query("C27_short_label")
def short_label(b: Bound) -> DataFrame:
    return b.table("documents").select("doc_id", T.short_label(F.col("text")).alias("label"), T.short_label(F.col("source"), 4).alias("source_label"))


@query("C28_outcome_label")
def outcome_label(b: Bound) -> DataFrame:
    text = F.when(F.col("p_size") % 3 == 0, F.lit(None)).when(F.col("p_size") % 3 == 1, F.lit("  ")).otherwise(F.col("p_type"))
    return counted(b.table("part"), F.col("p_size"), T.outcome_label(text, F.col("p_size")).alias("label"))


@query("C29_placeholder_names")
def placeholders(b: Bound) -> DataFrame:
    name = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("<Enter measure name here> "), F.col("p_name"))).when(F.col("p_size") % 4 == 1, F.lit("<insert Measure name here>")).otherwise(F.col("p_name"))
    return counted(b.table("part"), T.is_placeholder_name(name).alias("is_placeholder"))


@query("C30_resolved_titles")
def titles(b: Bound) -> DataFrame:
    """Order lines as titles: some are dash bullets under the heading before them."""
    rows = b.table("events").select("user_id", "event_id", "event_type")
    turn = F.col("event_id") % 4
    label = F.when(turn == 0, F.concat(F.lit("– "), F.col("event_type"))).when(turn == 1, F.concat(F.col("event_type"), F.lit(": - first"))).when(turn == 2, F.lit("- second")).otherwise(F.col("event_type"))
    starts = F.col("event_type") != "error"
    titled = measure_tables.resolved_titles(rows.withColumns({"label": label, "starts": starts}), ["user_id"], "event_id", "label", "starts", spread=True)
    return titled.select("user_id", "event_id", "label", "title")


@query("C31_similarity")
def similarity(b: Bound) -> DataFrame:
    return items(b, "l_orderkey", "l_partkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_partkey", "l_linenumber", F.round(U.similarity(F.col("l_quantity") / 16), 6).alias("score"))


@query("T1_typed_header_cells")
def header_cells(b: Bound) -> DataFrame:
    year = Y.fiscal_year_label(F.year("l_shipdate") + 20)
    kinds = ("Estimated\nactual", "Budget $'000", "Forward estimate", "Revised budget", "Actual", "factual", "estimate " + "x" * 60)
    cell = F.concat_ws(" ", year, F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("l_linenumber")))
    h = program_tables.header_cell(cell)
    return counted(items(b, "l_shipdate", "l_linenumber"), cell.alias("cell"), h["fiscal_year"].alias("fiscal_year"), h["estimate_type"].alias("estimate_type"))
