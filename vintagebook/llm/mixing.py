"""Mixing sources to target weights, all in DataFrame operations.

Words are summed per source first; targets fill up like water: a source stops at
its cap and what it leaves goes to the others by weight, so every uncapped source
gets one common level times its weight. That level follows from running sums over
sources in the order in which they reach their caps. A document is emitted
floor(rate) times, once more if its hash falls below the fraction.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; a source of size 0 has target 0; rows repeat the same draw on every run,
and repeated rows (same id and source) draw alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagebook.llm.common import WORD

WEIGHTS, SHARE, CAP, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix-1"


def sizes(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(summed: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size), one row per source.

    Windows here see one row per source and never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = summed.withColumn("place", (F.row_number().over(order) - 1) % len(weights))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place").cast("int") + 1))
    weighted = weighted.withColumn("most", F.col("source_size") * F.lit(cap))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # level at which this source would stand if those that cap earlier are capped and it is not
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(filling), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
    )
    leveled = weighted.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    common = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("full") | common.isNull(), F.col("most")).otherwise(F.least(F.col("most"), common * F.col("weight")))
    out = leveled.withColumn("target", target)
    return out.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def drawn(doc_id: Column, source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id, the source and the seed alone: 52 bits of a digest."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(source, F.lit("-")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """Rows of ``docs`` with size, source_size, target, rate and copies; columns of these names in ``docs`` are replaced."""
    made = ["size", "source_size", "target", "rate", "copies"]
    own = docs.drop(*made).withColumn("size", sizes(F.col("text")))
    summed = docs.select("source", sizes(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(summed, weights, share, cap).select(F.col("source").alias("its_source"), "source_size", "target", "rate")
    joined = own.join(targets, own["source"].eqNullSafe(targets["its_source"])).drop("its_source")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (drawn(F.col("doc_id"), F.col("source"), seed) < F.col("rate") - whole).cast("long")).cast("int"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    return mixture(docs, **options).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("one of the copies")).drop("one of the copies")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document."""
    out = mixture(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
