"""Text, name and topic search over the catalogue."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagebook.functions import fixed as V
from vintagebook.functions.numbers import similarity
from vintagebook.functions.text import opening_excerpt, snippet
from vintagebook.functions.years import edition_order
from vintagebook.operators.identity import MEASURE_KEY
from vintagebook.operators.measures import catalogue_of_rows


def contains_text(text: Column, query: str) -> Column:
    return F.lower(text).contains(query.strip().lower())


def text_matches(texts: DataFrame, components: DataFrame, query: str) -> DataFrame:
    """Write-ups whose body or any component contains ``query``, with a snippet.

    The snippet comes from the body, else from the first component with a hit. Both
    scans filter before anything is shuffled, and a component only moves if it matches.
    """
    query = query.strip()
    columns = ["measure_id", "measure_name", "edition", "portfolio"]
    body = texts.where(contains_text(F.col("full_measure_text"), query)).select(
        *columns, snippet(F.col("full_measure_text"), query).alias("snippet"), F.lit(-1).alias("ordinal")
    )
    hits = components.where(contains_text(F.col("text"), query)).groupBy("measure_id").agg(
        F.min_by(snippet(F.col("text"), query), "ordinal").alias("snippet"), F.min("ordinal").alias("ordinal")
    )
    by_component = texts.select(*columns).join(hits, "measure_id").select(*columns, "snippet", "ordinal")
    both = body.unionByName(by_component)
    return both.groupBy(*columns).agg(F.min_by("snippet", "ordinal").alias("snippet"))


def with_catalogue_fields(hits: DataFrame, impacts: DataFrame, programs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Add portfolios, agencies and the figures flag to search hits.

    The fact tables are reduced by a semi-join on the hits' keys and to distinct
    (measure, portfolio, agency) before the sets are collected.
    """
    keys = hits.select(*MEASURE_KEY).distinct()

    def part(table: DataFrame, priority: int) -> DataFrame:
        near = table.join(keys, MEASURE_KEY, "left_semi")
        return near.groupBy(*MEASURE_KEY, "portfolio", "agency").agg(F.max("measure_id").alias("measure_id")).select(
            "*", F.lit(priority).alias("priority"), F.lit(True).alias("has_figures")
        )

    own = hits.select(
        *MEASURE_KEY, F.nullif(F.col("portfolio"), F.lit("")).alias("portfolio"),
        F.lit(None).cast("string").alias("agency"), "measure_id", F.lit(0).alias("priority"), F.lit(False).alias("has_figures"),
    )
    rows = own.unionByName(part(impacts, 1)).unionByName(part(programs, 2))
    found = catalogue_of_rows(rows)
    if not carry:
        return found
    extra = hits.groupBy(*MEASURE_KEY).agg(F.min(F.struct(*carry)).alias("__c"))
    return found.join(extra, MEASURE_KEY).select(*found.columns, "__c.*")


def name_search(cat: DataFrame, query: str = "", portfolios: Sequence[str] = (), editions: Sequence[str] = ()) -> DataFrame:
    """Name contains ``query``; any listed portfolio; any listed edition. Empty lists do not filter."""
    out = cat
    if query.strip():
        out = out.where(contains_text(F.col("measure_name"), query))
    if portfolios:
        out = out.where(F.arrays_overlap("portfolios", F.array(*[F.lit(p) for p in portfolios])))
    if editions:
        out = out.where(F.col("edition").isin(list(editions)))
    return out


def portfolio_facets(cat: DataFrame) -> DataFrame:
    return cat.select(F.explode("portfolios").alias("portfolio")).where(F.col("portfolio") != "").distinct()


def edition_facets(cat: DataFrame) -> DataFrame:
    return cat.select("edition").distinct().withColumn("sort_key", edition_order(F.col("edition")))


def nearest_vectors(vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], n: int, id_column: str = "id") -> DataFrame:
    """Exact nearest neighbours of each query by squared distance: (query_id, id, distance).

    Queries are request parameters. Every Arrow batch of vectors is multiplied with
    the query matrix once and passes on at most ``n`` candidates per query, so what
    is shuffled does not grow with the corpus beyond (tasks x queries x n) rows.
    """
    ids = [q for q, _ in queries]
    matrix = np.asarray([v for _, v in queries], dtype=np.float64)
    squares = (matrix**2).sum(axis=1)
    id_type = vectors.schema[id_column].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            points = flat.reshape(batch.num_rows, -1)
            distance = (points**2).sum(axis=1)[:, None] - 2.0 * points @ matrix.T + squares[None, :]
            keep = min(n, batch.num_rows)
            rows, cols = [], []
            for q in range(len(ids)):
                border = np.partition(distance[:, q], keep - 1)[keep - 1]
                chosen = np.flatnonzero(distance[:, q] <= border + 1e-8)
                rows.append(chosen)
                cols.append(np.full(chosen.size, q))
            row, col = np.concatenate(rows), np.concatenate(cols)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(ids, dtype=np.int64)[col]), batch.column(0).take(pa.array(row)),
                 pa.array(np.maximum(distance[row, col], 0.0))],
                names=["query_id", "id", "distance"],
            )

    schema = f"query_id long, id {id_type.simpleString()}, distance double"
    candidates = vectors.select(id_column, "embedding").mapInArrow(scan, schema)
    best = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def topic_search(
    vectors: DataFrame, meta: DataFrame, texts: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], n: int = V.TOPIC_DEFAULT, most: int = V.TOPIC_CAP
) -> DataFrame:
    """Write-ups nearest to each query, with score and opening excerpt; asking for more than ``most`` of them raises."""
    if n > most:
        raise ValueError(f"at most {most} write-ups can be asked for")
    hits = nearest_vectors(vectors, queries, n)
    body = texts.select(F.col("measure_id").alias("id"), "full_measure_text")
    # vectors are scanned alone; names and texts are joined to the few hits
    joined = hits.join(meta, "id", "left").join(body, "id", "left")
    return joined.select(
        "query_id", "rank", F.col("id").alias("measure_id"), "measure_name", "edition", "portfolio",
        F.round(similarity(F.col("distance")), 6).alias("score"),
        opening_excerpt(F.col("full_measure_text")).alias("snippet"),
    )


def picker_level(hierarchy: DataFrame, level: str, **chosen) -> DataFrame:
    """The options at one level of portfolio > agency > outcome_number > program_name given the choices above."""
    out = hierarchy
    for column, value in chosen.items():
        out = out.where(F.col(column) == value)
    if level == "outcome_number":
        rank = F.struct("program_number", "program_name")
        return out.groupBy("outcome_number").agg(F.max_by("outcome_description", rank).alias("outcome_description"))
    if level == "program_name":
        return out.select("program_number", "program_name").distinct()
    return out.select(level).distinct()
