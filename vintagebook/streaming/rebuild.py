"""Rebuild a table file by file as decoded publications arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vintagebook.sources.versions import rebuild


def rebuild_stream(
    spark: SparkSession,
    incoming: str,
    schema: str,
    table: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Watch a folder of Parquet files; each micro-batch replaces the rows of the source files it contains.

    Replacing by source file is idempotent, so a batch that is replayed after a
    failure leaves the same table. ``table`` is one of ``versions.create_table``.
    """
    def replace(batch: DataFrame, _: int) -> None:
        rebuild(spark, table, transform(batch), files=batch.select("source_file"))

    arriving = spark.readStream.schema(schema).parquet(incoming)
    return arriving.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(replace).start()
