import hashlib

import pytest
from pyspark.sql import functions as F

from vintagebook.functions import ids, names, numbers, text, years


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, joined", [
    ("T REASURY", "TREASURY"),
    ("S OCIAL S ERVICES", "SOCIAL SERVICES"),
    ("E DUCATION AND T RAINING", "EDUCATION AND TRAINING"),
    ("A TTORNEY -G ENERAL’S", "ATTORNEY-GENERAL’S"),
    ("Health and Aged Care", "Health and Aged Care"),
])
def test_drop_caps(spark, raw, joined):
    assert one(spark, text.rejoin_drop_caps(F.col("a")), a=raw) == joined


@pytest.mark.parametrize("raw, amount", [("1,234", 1234), ("(12)", -12), ("2.5", 2), ("3.5", 4), ("nfp", None), ("", None), ("-7", -7), ("1.2.3", None)])
def test_amounts(spark, raw, amount):
    assert one(spark, numbers.to_amount(F.col("a")), a=raw) == amount


@pytest.mark.parametrize("raw, kind, value", [("-", "numeric", 0.0), ("..", "special", None), ("nfp", "special", None), ("-1,000.5", "numeric", -1000.5)])
def test_money_cells(spark, raw, kind, value):
    cell = one(spark, numbers.money_cell(F.col("a")), a=raw)
    assert (cell["value_kind"], cell["value_numeric_million"], cell["value_raw"]) == (kind, value, raw)


@pytest.mark.parametrize("raw, parts", [("1.3,1.5", ["1.3", "1.5"]), ("2.2 & 3.3", ["2.2", "3.3"]), ("1.1; 1.2", ["1.1", "1.2"]), ("All", []), ("2.0", ["2"]), ("various", None)])
def test_program_lists(spark, raw, parts):
    assert one(spark, numbers.program_list(numbers.program_number_text(F.col("a"))), a=raw) == parts


@pytest.mark.parametrize("path, agency", [
    ("x/2024-25 PBS Services Australia Tables.xlsx", "Services Australia"), ("x/Health - PAES 2024-25.xlsx", "Health"), ("x/2025-26 tables.xlsx", "2025-26 tables"),
])
def test_agency_of_file(spark, path, agency):
    assert one(spark, names.clean_agency(F.col("a")), a=path) == agency


@pytest.mark.parametrize("raw, shown", [
    ("2021-22 PBS PM&C1", "Prime Minister and Cabinet"), ("2020-21 PAES AGs", "Attorney-General's"), ("", ""), ("Health and Aged Care", "Health and Aged Care"),
])
def test_portfolios(spark, raw, shown):
    assert one(spark, names.canonical_portfolio(F.col("a")), a=raw) == shown


def test_measure_names(spark):
    raw = "Attorney‑General’s – Package (b),(d)"
    assert one(spark, text.canonical_measure_name(F.col("a")), a=raw) == "Attorney-General's - Package"
    assert one(spark, text.canonical_measure_name(F.col("a"), from_table=False), a="Reform (a)(b)") == "Reform"


def test_measure_id_is_the_documented_hash(spark):
    digest = hashlib.sha256("Child Care\x1f2024-25 Budget\x1f3".encode()).hexdigest()
    assert one(spark, ids.measure_id(F.col("a"), F.col("b"), 3), a="Child Care", b="2024-25 Budget") == str(int(digest[:12], 16) % 10**8).zfill(8)


def test_snippet(spark):
    body = "x" * 100 + " Needle " + "y" * 100
    found = one(spark, text.snippet(F.col("a"), "needle"), a=body)
    assert found == "…" + "x" * 59 + " Needle " + "y" * 59 + "…"
    assert one(spark, text.snippet(F.col("a"), "absent"), a=body) is None
    assert one(spark, text.snippet(F.col("a"), "x", 3), a="axb") == "axb"


def test_years(spark):
    assert one(spark, years.fiscal_year_in(F.col("a")), a="2024–25\nEstimated actual") == "2024-25"
    assert one(spark, years.budget_year_of(F.col("a"), any_dash=True), a="2024–25 Budget") == "2024-25"
    order = [one(spark, years.edition_order(F.col("a")), a=e) for e in ("2022-23 March Budget", "2022-23 October Budget", "2022-23 MYEFO", "2023-24 Budget")]
    assert order == sorted(order) and len(set(order)) == 4


def test_money_labels(spark):
    frame = spark.createDataFrame([(1_250_000,), (-3_400,), (12,), (0,), (None,)], "a bigint")
    rows = frame.select(numbers.dollars_label(F.col("a")).alias("d"), numbers.millions_cell(F.col("a")).alias("m")).collect()
    assert [r["d"] for r in rows[:4]] == ["$1.25B", "-$3.4M", "$12K", "$0"]
    assert [r["m"] for r in rows] == ["1,250.0", "-3.4", "0.0", "-", "-"]
