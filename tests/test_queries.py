"""A few registered queries beside their SQL at the smallest scale; tools/check.py runs all of them."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

DIRECTORY = "/root/testdata/sf0.001"
SAMPLE = ["A1_stitched_series", "A8_catalogue", "C19_measure_id", "J4_resolved_programs", "Q10_combined_measures", "V2_text_search", "S7_rebuilt_subset", "T20_components"]


@pytest.fixture(scope="module")
def con():
    if not Path(DIRECTORY).exists():
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{DIRECTORY}/{table}.parquet'")
    return connection


def test_every_query_has_sql_and_the_other_way_round():
    statements = set(entry.oracle_sql())
    assert statements <= set(entry.queries())
    # those of the optional subpackage that SQL can't express are tested against brute force in tests/llm
    assert {n for n in set(entry.queries()) - statements if not n.startswith("op") and n != "pipeline"} == set()


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    found = entry.queries()[name](spark, DIRECTORY)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, result.fetchall())


def test_measures_alone_store_no_facts(spark, tmp_path):
    import shutil

    from vintagebook.plans.bindings import Bound

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "t")
    bound = Bound(spark, str(tmp_path / "t"))
    made = {tuple(r) for r in bound.measure_records.select("edition", "measure_name", "fiscal_year", "amount_thousands").collect()}
    assert made and not bound.is_built("facts")
