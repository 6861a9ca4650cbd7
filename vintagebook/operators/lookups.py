"""Enriching big tables from dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_lookup(
    big: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS, spread: Sequence[str] | None = None
) -> DataFrame:
    """Equi-join ``big`` with ``dim`` so that one hot key is shared by ``salts`` tasks.

    Each dimension row is repeated once per salt and each big row takes one salt
    from a hash of its ``spread`` columns (all columns by default), so the result
    is exactly the unsalted join. Catalyst still broadcasts ``dim`` where its
    measured size is below the session's threshold; nothing is hinted.
    """
    by = list(spread or big.columns)
    salted_big = big.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    salted_dim = dim.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted_big.join(salted_dim, [*on, "__salt"], how).drop("__salt")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_union(*parts: DataFrame) -> DataFrame:
    """SQL UNION of parts with the same columns: each side is made distinct before the shuffle."""
    return union_all(parts).distinct()


def first_by(df: DataFrame, keys: Sequence[str], order, columns: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row per key as an aggregate, so that it is combined before the shuffle."""
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*columns), order).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in columns])
