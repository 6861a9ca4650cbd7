from collections import Counter

import corpus_pipeline as P
import pytest
from tests.llm.conftest import documents

import __spark_entry__ as entry
from vintagebook.llm.exactdedup import deduplicated
from vintagebook.llm.nearcopies import near_copies

DIRECTORY = "/root/testdata/sf0.001"
WITH_SQL = ["op7_mixing", "op8_top_k", "op10_warc", "op11_exact_dedup", "op13_filter_audit"]


def test_registered():
    names = {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}
    assert len(names) == 14 and {n for n in entry.oracle_sql() if n in names} == set(WITH_SQL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        connection.execute(f"create view {table} as select * from '{DIRECTORY}/{table}.parquet'")
    result = connection.execute(entry.oracle_sql()[name])
    order = [c[0] for c in result.description]
    found = entry.queries()[name](spark, DIRECTORY).select(order).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, result.fetchall()))


def test_stages(spark):
    """Every stage equals what its operator decides, on all that the stage before kept."""
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    toxic_free = P.drop_toxic(spark, docs, DIRECTORY).cache()
    assert toxic_free.columns == docs.columns and 0 < toxic_free.count() <= docs.count()
    single = P.drop_near_duplicates(spark, toxic_free, DIRECTORY).cache()
    groups = {r["component_id"] for r in near_copies(toxic_free).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(groups)
    assert len(groups) < deduplicated(toxic_free).count() < toxic_free.count()
    cut = P.drop_repeats(spark, single, DIRECTORY).cache()
    assert cut.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    mix = P.mix_sources(spark, cut, DIRECTORY).cache()
    assert mix.columns == docs.columns and set(Counter(r["doc_id"] for r in mix.collect()).values()) <= {1, 2}
    packed = P.pack(spark, mix, DIRECTORY).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mix.collect()}
    assert max(Counter({s: sum(r["length"] for r in packed if r["sequence_id"] == s) for s in {r["sequence_id"] for r in packed}}).values()) <= 1024


def test_run_keeps_going_on_rows_without_ids(spark):
    docs = documents(spark, [(None, "a b c", "en", None), (1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, "", None, None), (3, None, None, None)])
    kept = P.drop_near_duplicates(spark, docs, DIRECTORY)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2"]
    assert P.drop_repeats(spark, kept, DIRECTORY).count() == 2
    assert P.pack(spark, P.mix_sources(spark, kept, DIRECTORY), DIRECTORY).columns[0] == "doc_id"


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, tmp_path, n):
    """No documents, or no labels, with columns named like the stages' own."""
    docs = documents(spark, [(1, "a b c", "en", "s")][:n])
    for column in ("component_id", "copies", "k", "kept", "size", "text_sha256", "own"):
        docs = docs.withColumn(column, docs["key"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns and made.count() <= 2 * n
    assert P.run(spark, str(tmp_path)).count() <= 2 * n
