"""Writing, rebuilding and auditing the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vintagebook.operators.identity import MEASURE_KEY, assign_measure_ids

PARTITION = "edition"


# --- full and append writes -----------------------------------------------------------

def write_table(df: DataFrame, path: str, partition: str = PARTITION) -> None:
    """Full rebuild. Rebalancing by edition gives files of even size, also for a very large edition."""
    df.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        partition
    ).parquet(path)


def append_table(df: DataFrame, path: str, partition: str = PARTITION) -> int:
    """Append to a table of ``write_table``, in its layout, and return how many rows were written, counted while writing."""
    seen = Observation("appended")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)
    return int(seen.get["rows"])


def records_to_tables(records: DataFrame, key: str = "measure_id") -> dict[str, DataFrame]:
    """Nested measure records to a parent table and three ordered child tables.

    ``records`` has arrays ``headline_financials`` (rows with an array ``values``),
    ``components`` and ``related``. Children carry the record's key; order is list position.
    """
    parent = records.drop("headline_financials", "components", "related")
    rows = records.select(key, F.posexplode("headline_financials").alias("row_ordinal", "row"))
    values = rows.select(
        key, "row_ordinal", "row.impact_type", "row.is_related", "row.department_name",
        F.posexplode("row.values").alias("year_index", "v"),
    ).select(key, "row_ordinal", "impact_type", "is_related", "department_name", "year_index", "v.*")
    parts = records.select(key, F.posexplode("components").alias("ordinal", "c")).select(key, "ordinal", "c.*")
    phrases = records.select(key, F.posexplode("related").alias("ordinal", "phrase"))
    return {"measure_text": parent, "financials": values, "components": parts, "related": phrases}


# --- documents for the vector collection -------------------------------------------------

def assembled_documents(texts: DataFrame, components: DataFrame) -> DataFrame:
    """Name, prose and components of each measure as one document, a line each, empty parts dropped."""
    pieces = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    parts = components.where(F.col("text") != "").groupBy("measure_id").agg(
        F.transform(pieces, lambda p: p["text"]).alias("parts")
    )
    joined = texts.join(parts, "measure_id", "left")
    document = F.concat_ws(
        "\n", F.nullif(F.col("measure_name"), F.lit("")), F.nullif(F.col("full_measure_text"), F.lit("")), F.col("parts")
    )
    return joined.select(
        F.col("measure_id").alias("id"), document.alias("document"), "measure_name", "edition",
        F.coalesce("portfolio", F.lit("")).alias("portfolio"),
    )


def reconcile_collection(current: DataFrame, wanted: DataFrame, key: str = "id", content: Sequence[str] = ("document",)) -> DataFrame:
    """What has to happen to each id so that ``current`` becomes ``wanted``: insert, update, delete or keep.

    Contents are compared by hash, so documents themselves are not shuffled.
    """
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.xxhash64(*content).alias(name))

    both = digest(current, "old").join(digest(wanted, "new"), key, "full_outer")
    action = (
        F.when(F.col("old").isNull(), F.lit("insert")).when(F.col("new").isNull(), F.lit("delete"))
        .when(F.col("old") != F.col("new"), F.lit("update")).otherwise(F.lit("keep"))
    )
    return both.select(key, action.alias("action"))


def reconciled_collection(current: DataFrame, wanted: DataFrame, actions: DataFrame, key: str = "id") -> DataFrame:
    """The collection after the actions: kept rows as they are, inserted and updated rows as wanted.

    Running it on its own result changes nothing.
    """
    kept = current.join(actions.where(F.col("action") == "keep"), key, "left_semi")
    written = wanted.join(actions.where(F.col("action").isin("insert", "update")), key, "left_semi")
    return kept.unionByName(written.select(*current.columns))


# --- subset rebuild ----------------------------------------------------------------------------

def covered_files(files: DataFrame, editions: Sequence[str]) -> DataFrame:
    """Files given one by one whose edition is rebuilt anyway are left to the edition."""
    return files.where(~F.col("edition").isin(list(editions))) if editions else files


def check_editions(editions: Sequence[str], known: Sequence[str]) -> None:
    unknown = sorted(set(editions) - set(known))
    if unknown:
        raise ValueError(f"unknown editions: {unknown}; known: {sorted(known)}")


def rebuilt_rows(
    current: DataFrame, fresh: DataFrame, editions: Sequence[str] = (), files: DataFrame | None = None
) -> DataFrame:
    """``current`` with the rows of the given editions and files replaced by those of ``fresh``.

    A file alone replaces its own rows and nothing else of its edition. ``files`` is a
    table with source_file, so that any number of files can be named.
    """
    listed = F.col("edition").isin(list(editions)) if editions else F.lit(False)
    kept, new = current.where(~listed), fresh.where(listed)
    if files is not None:
        names = files.select("source_file").distinct()
        kept = kept.join(names, "source_file", "left_anti")
        new = new.unionByName(fresh.where(~listed).join(names, "source_file", "left_semi"))
    return kept.select(*current.columns).unionByName(new.select(*current.columns))


def with_stable_ids(fresh: DataFrame, current: DataFrame) -> DataFrame:
    """Give ``fresh`` rows their measure ids; measures already in ``current`` keep theirs."""
    known = current.select(*MEASURE_KEY, "measure_id").distinct()
    assigned = assign_measure_ids(fresh.select(*MEASURE_KEY), known=known).select(*MEASURE_KEY, "measure_id")
    return fresh.drop("measure_id").join(assigned, MEASURE_KEY)


# --- audit --------------------------------------------------------------------------------------

def ingest_audit(files: DataFrame, records: DataFrame, conflicts: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One row: files scanned, with records, empty, failed; rows; conflicting duplicates."""
    per_file = records.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))
    counted = files.select("source_file").distinct().join(per_file, "source_file", "left")
    out = counted.agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count("n_rows").alias("files_with_records"),
        F.coalesce(F.sum(F.col("n_rows").isNull().cast("long")), F.lit(0)).alias("files_without_records"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"),
    )
    for name, part in (("conflicting_duplicates", conflicts), ("files_with_errors", errors)):
        if part is not None:
            count = part.agg(F.count(F.lit(1)).alias(name))
            out = out.withColumn(name, count.scalar())
    return out


def files_without_records(files: DataFrame, records: DataFrame) -> DataFrame:
    return files.select("source_file").distinct().join(records.select("source_file").distinct(), "source_file", "left_anti")
