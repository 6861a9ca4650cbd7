"""No list of years or editions: tables of other years lose nothing, and changed files are seen."""

import os
import re
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vintagebook.operators import measures as M
from vintagebook.operators.series import figures_by_year, figures_text
from vintagebook.plans.bindings import Bound

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture()
def shifted(spark, tmp_path):
    """The test tables with all dates 20 years later."""
    if not Path(DIRECTORY).exists():
        pytest.skip("no test tables here")
    for file in os.listdir(DIRECTORY):
        if file not in ("orders.parquet", "lineitem.parquet"):
            shutil.copy(f"{DIRECTORY}/{file}", tmp_path / file)
    for name, date in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        table = spark.read.parquet(f"{DIRECTORY}/{name}.parquet")
        table.withColumn(date, F.add_months(date, 240).cast("timestamp")).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def later(text):
    """Years and editions in a text, 20 years on."""
    return re.sub(r"\b20(\d\d)-(\d\d)\b", lambda m: f"20{int(m[1]) + 20:02d}-{(int(m[2]) + 20) % 100:02d}", text)


def test_other_years_lose_nothing(spark, shifted):
    """2016 alone has two budgets, so the figures are compared without the name of the edition."""
    pivot = entry.queries()["Q14_top_portfolios_pivot"]
    then, now = ([str(tuple(r)) for r in pivot(spark, directory).select("figures").collect()] for directory in (DIRECTORY, shifted))
    assert sorted(map(later, then)) == sorted(now)
    for directory, back in ((DIRECTORY, 0), (shifted, 20)):
        bound = Bound(spark, directory)
        matrix = M.impact_matrix(bound.measure_impacts, ["edition"]).where("is_total").select(F.explode("figures").alias("year", "amount"))
        total = matrix.agg(F.sum("amount")).first()[0]
        assert total == bound.measure_records.agg(F.sum("amount_thousands")).first()[0]
        assert {int(e[:4]) - back for e in bound.editions} == set(range(2015, 2022))
        assert bound.agency_aliases.select("edition").distinct().count() == len(bound.editions)


def test_maps_of_years(spark):
    rows = [("e", "payment", "a", "2001-02", 5), ("e", "payment", "b", "2003-04", 7), ("e", "receipt", "a", "1999-00", 1), ("f", "payment", "a", "2050-51", 2)]
    impacts = spark.createDataFrame(rows, "edition string, direction string, agency string, fiscal_year string, amount_thousands long")
    found = {(r["edition"], r["direction"], r["agency"]): r["figures"] for r in M.impact_matrix(impacts, ["edition"]).collect()}
    assert found["e", "payment", "a"] == {"1999-00": 0, "2001-02": 5, "2003-04": 0} and found["e", "payment", "Total"] == {"1999-00": 0, "2001-02": 5, "2003-04": 7}
    assert found["f", "payment", "Total"] == {"2050-51": 2} and len(found) == 7
    whole = {r["direction"]: r["figures"] for r in M.combined_matrix(impacts, []).collect()}
    assert whole == {"payment": {"1999-00": 0, "2001-02": 5, "2003-04": 7, "2050-51": 2}, "receipt": {"1999-00": 1, "2001-02": 0, "2003-04": 0, "2050-51": 0}}
    shown = {r["agency"]: r["t"] for r in figures_by_year(impacts, ["agency"]).select("agency", figures_text(F.col("figures")).alias("t")).collect()}
    assert shown == {"a": "1999-00:1,2001-02:5,2050-51:2", "b": "2003-04:7"}


def test_changed_files_are_read_again(spark, tmp_path):
    for file in os.listdir(DIRECTORY):
        shutil.copy(f"{DIRECTORY}/{file}", tmp_path / file)
    count = lambda: entry.queries()["A12_direction_totals"](spark, str(tmp_path)).agg(F.sum("amount_thousands")).first()[0]
    before = count()
    items = spark.read.parquet(f"{DIRECTORY}/lineitem.parquet")
    shutil.rmtree(tmp_path / "lineitem.parquet", ignore_errors=True)
    (tmp_path / "lineitem.parquet").unlink(missing_ok=True)
    items.withColumn("l_extendedprice", F.col("l_extendedprice") * 2).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert before > 0 and abs(count() / before - 2) < 0.01


def test_facts_are_stored_once_and_narrow(spark):
    """Expenses and measure lines are read from stored numbers, not stored again with the words that follow from them."""
    bound = Bound(spark, DIRECTORY)
    words = {"edition", "source_file", "sheet_name", "measure_name", "fiscal_year", "program_number"}
    for rows in (bound.program_expenses, bound.measure_records):
        folder, = {f.rsplit("/", 1)[0] for f in rows.inputFiles() if "stored-" in f}
        stored = spark.read.parquet(folder)
        assert not words & set(stored.columns)
        assert rows.count() == stored.count() == bound.table("lineitem").count()


def test_stale_keys_read_no_texts(spark):
    """Keys of write-ups come from their ids; no table with texts is built for them."""
    found = entry.queries()["U3_stale_keys"](spark, DIRECTORY)
    bound = Bound(spark, DIRECTORY)
    wanted = bound.measure_text.select("measure_name", "edition").subtract(bound.measure_impacts.select("measure_name", "edition"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    folders = {f.split("/edition=")[0] for f in found.inputFiles()}
    assert folders and all("lines" not in spark.read.parquet(f).columns for f in folders)
