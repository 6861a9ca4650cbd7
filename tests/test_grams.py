"""The index of trigrams finds what a scan of all texts finds, and reads less."""

import random

import pytest

from vintagebook.operators.grams import GramIndex, gram_counts, postings, sharded
from vintagebook.operators.search import text_matches


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["care", "health", "Straße", "naïve", "ab", "a", "%_", "the", "İstanbul", "funding\tnow", "日本語"]
    texts, parts = [], []
    for i in range(400):
        lines = [" ".join(["the", *rng.choices(words, k=rng.randint(0, 6))]) for _ in range(rng.randint(0, 4))]
        lines += ["needle in it"] if i % 97 == 0 else []
        texts.append((f"{i:08d}", f"m{i}", "e", "p", "\n\n".join(lines[::2])))
        parts += [(f"{i:08d}", n, line) for n, line in enumerate(lines)]
    text_table = spark.createDataFrame(texts, "measure_id string, measure_name string, edition string, portfolio string, full_measure_text string")
    part_table = spark.createDataFrame(parts, "measure_id string, ordinal int, text string")
    root = tmp_path_factory.mktemp("index")

    def stored(df, name, by=None):
        (df.write.partitionBy(by) if by else df.write).parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    posted = stored(postings(text_table, part_table), "postings", "bucket")
    return text_table, part_table, GramIndex(posted, stored(gram_counts(posted), "counts"), stored(sharded(text_table), "texts", "shard"), stored(sharded(part_table), "parts", "shard"))


@pytest.mark.parametrize("query", ["needle", "  NEEDLE in ", "the", "straße", "naïve", "a", "ab", "%_", "ing\tno", "nothing of it", "needle out", "日本語", "t\n\nthe", "the the", ""])
def test_index_equals_scan(tables, query):
    texts, parts, index = tables
    want, found = (sorted(map(str, df.select("measure_id", "measure_name", "edition", "portfolio", "snippet").collect())) for df in (text_matches(texts, parts, query), index.matches(query)))
    assert found == want


def test_a_rare_query_reads_few_folders(tables):
    _, _, index = tables
    assert index.candidates("needle").count() == 5
    read = index.matches("needle")
    files = read.inputFiles()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(shard") + plan.count("PartitionFilters: [shard") >= 2 and files


def test_trigrams_are_made_distinct_where_the_texts_of_a_measure_meet(spark):
    texts = spark.createDataFrame([("m", "abca"), ("n", "ab"), (None, "xyz")], "measure_id string, full_measure_text string")
    parts = spark.createDataFrame([("m", "BCAB"), ("n", None)], "measure_id string, text string")
    made = postings(texts, parts)
    assert sorted((r["measure_id"] or "", r["gram"]) for r in made.collect()) == [("", "xyz"), ("m", "abc"), ("m", "bca"), ("m", "cab")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Generate") < plan.index("Aggregate")
