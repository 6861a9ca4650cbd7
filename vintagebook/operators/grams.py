"""Substring search by an index of character trigrams.

The postings say which measures have a trigram in their body or a component; a text that
contains a query has all trigrams of the query. A search looks up how frequent those are,
takes the measures that the rarest of them share, and checks these on their texts. Postings
are rows, so a frequent trigram is many rows in several files and never one cell. Postings
are stored by a hash of the trigram and texts by a hash of the measure, so that a search
reads a few of their folders. A query shorter than a trigram reads all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagebook.operators.search import text_matches

SIZE, RAREST = 3, 3
#: Folders of postings and of texts.
BUCKETS = 64


def _bucket(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(BUCKETS)).cast("int")


def postings(texts: DataFrame, components: DataFrame) -> DataFrame:
    """(gram, measure_id, bucket), each once.

    The pieces of a measure meet as texts, and its trigrams are made distinct there: they are many times the texts.
    """
    pieces = texts.select("measure_id", F.col("full_measure_text").alias("text")).unionByName(components.select("measure_id", "text"))
    gathered = pieces.groupBy("measure_id").agg(F.collect_list(F.lower("text")).alias("pieces"))
    letters = F.transform("pieces", lambda text: F.split(text, ""))
    three = F.transform(letters, lambda own: F.transform(own, lambda c, i: F.concat(c, F.get(own, i + 1), F.get(own, i + 2))))
    grams = F.array_distinct(F.filter(F.flatten(three), lambda g: g.isNotNull()))
    return gathered.select("measure_id", F.explode(grams).alias("gram")).withColumn("bucket", _bucket("gram"))


def gram_counts(posted: DataFrame) -> DataFrame:
    """(gram, n): how many measures have a trigram; one row per trigram that occurs."""
    return posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def sharded(table: DataFrame) -> DataFrame:
    return table.withColumn("shard", _bucket("measure_id"))


@dataclass
class GramIndex:
    """Stored tables: postings by bucket, counts, texts and components by shard."""

    posted: DataFrame
    counts: DataFrame
    texts: DataFrame
    components: DataFrame

    def candidates(self, query: str) -> DataFrame | None:
        """(measure_id, shard) of the measures that have the query's rarest trigrams; None if the query has no trigram."""
        low = query.strip().lower()
        grams = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
        if not grams:
            return None
        # one row per trigram of the query
        known = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(grams)).collect()}
        chosen = sorted(grams, key=lambda g: known.get(g, 0))[:RAREST]
        spark = self.posted.sparkSession
        buckets = [r["b"] for r in spark.createDataFrame([(g,) for g in chosen], "gram string").select(_bucket("gram").alias("b")).distinct().collect()]
        near = self.posted.where(F.col("bucket").isin(buckets) & F.col("gram").isin(chosen))
        shared = near.groupBy("measure_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen))
        return shared.select("measure_id", _bucket("measure_id").alias("shard"))

    def matches(self, query: str) -> DataFrame:
        """What ``search.text_matches`` gives, from the texts of the candidates."""
        found = self.candidates(query)
        if found is None:
            return text_matches(self.texts, self.components, query)
        shards = [r["shard"] for r in found.select("shard").distinct().collect()]
        part = lambda table: table.where(F.col("shard").isin(shards)).join(found.select("measure_id"), "measure_id", "left_semi")
        return text_matches(part(self.texts), part(self.components), query)
