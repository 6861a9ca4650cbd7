"""From raw documents to packed training sequences, in five stages over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagebook.llm.common import table
from vintagebook.llm.mixing import mixed
from vintagebook.llm.nearcopies import without_near_copies
from vintagebook.llm.packing import packing_report
from vintagebook.llm.repeats import without_repeats
from vintagebook.llm.toxicity import toxicity, trained
from vintagebook.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, learned from all labels, doesn't reject."""
    scored = toxicity(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the smallest id stays. See ``nearcopies``, which also says what happens to nulls and repeated rows."""
    return without_near_copies(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those of which nothing is left go."""
    cut = without_repeats(docs, with_text=True).where("kept <> '' or n_removed = 0")
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing_report(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("repeats", drop_repeats), ("mixing", mix_sources), ("packing", pack),
]

#: The first stage learns a model and the last packs by search, so SQL can't express run().
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
