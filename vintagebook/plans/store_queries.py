"""Queries for discovery, writing, rebuilding and auditing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagebook.functions.names import clean_agency
from vintagebook.operators.identity import MEASURE_KEY
from vintagebook.operators import measures as M
from vintagebook.plans.bindings import Bound
from vintagebook.plans.registry import query
from vintagebook.sources import cells as C
from vintagebook.sources import discovery as D
from vintagebook.sources import store as S
from vintagebook.sources import versions as V
from vintagebook.session import ensure_checkpoint_dir, stored

REBUILT_EDITIONS = ["2016-17 MYEFO", "2018-19 Budget"]


def _folder(b: Bound) -> str:
    """A new folder in the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(b.spark)}/table-{uuid.uuid4().hex}"


def _paths(b: Bound) -> DataFrame:
    """One workbook per (edition, supplier), as laid out on disk, with temporary files among them."""
    name = F.concat(F.when(F.col("l_suppkey") % 9 == 0, F.lit("~$")).otherwise(F.lit("")), F.col("budget_year"), F.lit(" PBS "), F.col("short_name"), F.lit("-S"), F.col("l_suppkey").cast("string"), F.lit(" tables.xlsx"))
    folder = F.when(F.col("order_year") == 2017, F.concat(F.lit("2017-18 PBS "), F.col("r_name"))).otherwise(F.col("r_name"))
    return b.base.select(F.concat_ws("/", F.lit("data"), "edition", folder, name).alias("path")).distinct()


@query("S1_discovered_workbooks")
def discovered(b: Bound) -> DataFrame:
    """Files on disk, other files and temporary ones among them, found by their names."""
    root = _folder(b)
    workbooks = _paths(b).withColumn("content", F.col("path").cast("binary"))
    D.write_files(workbooks.unionByName(workbooks.withColumn("path", F.concat("path", F.lit(".txt")))), root)
    found = D.below(D.listed_workbooks(b.spark, root), root)
    return D.with_context(found).select("path", "edition", "portfolio", "agency", "budget_year")


@query("S3_borrowed_portfolios")
def borrowed(b: Bound) -> DataFrame:
    """Mid-year files without a portfolio folder take the portfolio of the year's Budget."""
    files = D.with_context(_paths(b))
    flat = files.where(F.col("edition").endswith("MYEFO")).select("path", "budget_year", clean_agency(F.col("path")).alias("agency"))
    return D.borrowed_portfolios(flat, files.where(F.col("edition").endswith("Budget")))


@query("S5_written_table")
def written(b: Bound) -> DataFrame:
    """Full rebuild to disk and back."""
    path = _folder(b)
    S.write_table(b.program_expenses, path)
    return b.spark.read.parquet(path).groupBy("edition", "agency").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_thousands").alias("total"))


def _nested(b: Bound) -> DataFrame:
    """Write-ups as nested records."""
    line = lambda t: F.struct(F.lit(1).alias("level"), F.lit("dot").alias("marker"), t.alias("text"))
    value = lambda t: F.struct(F.lit("numeric").alias("value_kind"), F.length(t).cast("double").alias("value_numeric_million"), F.length(t).cast("string").alias("value_raw"))
    row = lambda t: F.struct(F.lit("Payment").alias("impact_type"), F.lit(False).alias("is_related"), F.substring(t, 1, 5).alias("department_name"), F.array(value(t), value(F.lit("x"))).alias("values"))
    return b.write_ups.select(
        "measure_id", *MEASURE_KEY, F.transform("lines", row).alias("headline_financials"), F.transform("lines", line).alias("components"),
        F.array(F.col("source_file"), F.col("portfolio")).alias("related"),
    )


@query("S6_child_tables")
def children(b: Bound) -> DataFrame:
    """All three child tables in one list."""
    tables = S.records_to_tables(_nested(b))
    figures = tables["financials"].select("measure_id", F.lit("figure").alias("child"), "row_ordinal", "year_index", F.col("value_raw").alias("content"))
    parts = tables["components"].select("measure_id", F.lit("component").alias("child"), F.col("ordinal").alias("row_ordinal"), F.lit(0).alias("year_index"), F.md5("text").alias("content"))
    phrases = tables["related"].select("measure_id", F.lit("phrase").alias("child"), F.col("ordinal").alias("row_ordinal"), F.lit(0).alias("year_index"), F.col("phrase").alias("content"))
    return figures.unionByName(parts).unionByName(phrases)


def _rebuild_input(b: Bound) -> tuple[DataFrame, DataFrame, DataFrame]:
    current = b.program_expenses.select("edition", "source_file", "program_number", "amount_thousands")
    fresh = current.withColumn("amount_thousands", F.col("amount_thousands") + 1)
    files = b.agency_aliases.where(F.col("formal_name").endswith("Commission")).select("edition", "source_file")
    return current, fresh, S.covered_files(files, REBUILT_EDITIONS)


@query("S7_rebuilt_subset")
def rebuilt(b: Bound) -> DataFrame:
    """Two editions and some single files replaced by figures that are one higher."""
    current, fresh, files = _rebuild_input(b)
    S.check_editions(REBUILT_EDITIONS, ["2016-17 MYEFO", "2018-19 Budget", "2018-19 MYEFO"])
    rows = S.rebuilt_rows(current, fresh, REBUILT_EDITIONS, files)
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_thousands").alias("total"))


@query("S7_rebuilt_table")
def rebuilt_table(b: Bound) -> DataFrame:
    """The same on disk: only the affected editions are written, into a generation of their own."""
    current, fresh, files = _rebuild_input(b)
    path = _folder(b)
    V.create_table(current, path)
    V.rebuild(b.spark, path, fresh, REBUILT_EDITIONS, files)
    return V.read_table(b.spark, path).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_thousands").alias("total"))


def _collections(b: Bound) -> tuple[DataFrame, DataFrame]:
    wanted = S.assembled_documents(b.measure_text, b.components)
    turn = F.col("id").cast("long") % 5
    current = wanted.where(turn != 0).withColumn("document", F.when(turn == 1, F.lit("old")).otherwise(F.col("document")))
    stale = wanted.where(turn == 2).withColumn("id", F.concat(F.lit("old-"), F.col("id")))
    return current.unionByName(stale), wanted


@query("S8_collection_actions")
def actions(b: Bound) -> DataFrame:
    return S.reconcile_collection(*_collections(b))


@query("S8_reconciled_collection")
def reconciled(b: Bound) -> DataFrame:
    current, wanted = _collections(b)
    rows = S.reconciled_collection(current, wanted, S.reconcile_collection(current, wanted))
    return rows.select("id", F.md5("document").alias("digest"))


@query("S9_assembled_documents")
def documents(b: Bound) -> DataFrame:
    rows = S.assembled_documents(b.measure_text, b.components)
    return rows.select("id", F.md5("document").alias("digest"), F.length("document").alias("n_chars"), "measure_name", "edition", "portfolio")


@query("S10_ingest_audit")
def audit(b: Bound) -> DataFrame:
    keys = ["source_file", "outcome_number", "program_number", "fiscal_year", "estimate_type"]
    files = b.agency_aliases.select("source_file")
    records = b.program_expenses
    conflicts = M.conflicting_duplicates(records.select(*keys, "id", "amount_thousands"), keys, ["id"])
    return S.ingest_audit(files, records, conflicts)


@query("S10_files_without_records")
def without_records(b: Bound) -> DataFrame:
    return S.files_without_records(b.agency_aliases, b.program_expenses)


@query("S11_isolated_errors")
def errors(b: Bound) -> DataFrame:
    """Documents written as files and decoded from disk: a file on which the decoder fails becomes an error row, the others cells."""
    root = _folder(b)
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".xlsx"))
    D.write_files(b.table("documents").select(path.alias("path"), F.col("text").cast("binary").alias("content")), root)

    def line_cells(content: bytes) -> Iterator[C.Cell]:
        """A caller's decoder: one cell per line; a file of a single line is damaged."""
        lines = content.decode("utf-8").split("\n")
        if len(lines) < 2:
            raise ValueError("a single line")
        for i, line in enumerate(lines):
            yield "Sheet", 0, i, 0, line, None

    cells, failed = C.split_decoded(stored(C.decoded_workbooks(b.spark, root, line_cells)))
    read = cells.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_cells")).withColumn("error", F.lit(None).cast("string"))
    every = read.unionByName(failed.select("source_file", F.lit(0).cast("long").alias("n_cells"), "error"))
    return D.below(every.withColumnRenamed("source_file", "path"), root).withColumnRenamed("path", "source_file")


@query("S12_append_and_count")
def appended(b: Bound) -> DataFrame:
    """The catalogue appended to itself twice: each append reports its rows, the table has all."""
    path = _folder(b)
    rows = b.measure_text.select("measure_id", *MEASURE_KEY)
    S.write_table(rows, path)
    first, second = S.append_table(rows, path), S.append_table(rows, path)
    return b.spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(first).cast("long").alias("first_append"), F.lit(second).cast("long").alias("second_append")
    )
