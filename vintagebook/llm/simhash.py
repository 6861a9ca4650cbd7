"""SimHash near-duplicates: exact links within a radius by comparing tiles of fingerprints.

Fingerprints are laid out in tiles by the population counts of their four
quarters. Changing one bit changes one of those counts by one, so tiles whose
counts differ by more than the radius in sum cannot hold a link and are never
paired. Paired tiles are compared whole: numpy exclusive-or and bit counts. A tile
pair passes on a spanning forest of its links, at most one edge per fingerprint;
equal texts have become one fingerprint before that.

Defined cases: null and blank texts have fingerprint zero; texts of any length are read
whole, one row at a time; a null id never becomes a component id unless the whole component
has none; repeated rows stay as they are; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vintagebook.llm.common import bounded_batches
from vintagebook.llm.graph import components
from vintagebook.session import stored

SHINGLE, SEED, RADIUS = 3, 42, 2
QUARTERS, QUARTER_BITS = 4, 16
#: Fingerprints of a tile, about.
TILE = 4096
STRIP = 256


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's word shingles in their order, repeats included; of a shorter text the whole is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > hashes.size).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint_of(text: str | None) -> int:
    """64-bit SimHash of the text's word shingles as a signed long."""
    return majority_bits(shingle_hashes(text))


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row."""
    return bounded_batches(docs).select("doc_id", _fingerprints(F.col("text")).alias("fp"))


def merged(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` after joining the nodes a[i] and b[i]; every entry points at the smallest node of its set."""
    while a.size:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for left, right in zip(batch["left"], batch["right"]):
            x, y = np.asarray(left, np.int64), np.asarray(right, np.int64)
            nodes = parent = None
            for s in range(0, x.size, STRIP):
                apart = np.bitwise_count(x[s : s + STRIP, None].view(np.uint64) ^ y[None, :].view(np.uint64))
                i, j = np.nonzero((apart <= RADIUS) & (apart > 0))
                if not i.size:
                    continue
                if nodes is None:
                    nodes = np.unique(np.concatenate([x, y]))
                    parent = np.arange(nodes.size)
                parent = merged(parent, np.searchsorted(nodes, x[s + i]), np.searchsorted(nodes, y[j]))
            if nodes is not None:
                moved = np.flatnonzero(parent != np.arange(nodes.size))
                found.append((nodes[moved], nodes[parent[moved]]))
        yield pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})


def _quarter(fp: F.Column, i: int) -> F.Column:
    return F.bit_count(F.shiftrightunsigned(fp, QUARTER_BITS * i).bitwiseAND(F.lit((1 << QUARTER_BITS) - 1)))


def _tile_key(counts: list[F.Column]) -> F.Column:
    key = F.lit(0)
    for c in counts:
        key = key * (QUARTER_BITS + 1) + c
    return key.cast("int")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that join every two fingerprints ``fp`` within the radius, directly or through others that are."""
    quarters = [f"q{i}" for i in range(QUARTERS)]
    keyed = distinct.select("fp", *[_quarter(F.col("fp"), i).cast("int").alias(q) for i, q in enumerate(quarters)])
    keyed = keyed.withColumn("tile", _tile_key([F.col(q) for q in quarters]))
    # at most 17**4 rows, whatever the corpus
    parts = keyed.groupBy("tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    tiles = stored(
        keyed.join(F.broadcast(parts), "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("tile", "part", *quarters).agg(F.collect_list("fp").alias("fps"))
    )
    steps = [s for s in product(range(-RADIUS, RADIUS + 1), repeat=QUARTERS) if sum(map(abs, s)) <= RADIUS and s >= (0,) * QUARTERS]
    near = tiles.select("tile", "part", *quarters, F.col("fps").alias("left"), F.explode(F.array(*[F.struct(*[F.lit(d).alias(q) for d, q in zip(s, quarters)]) for s in steps])).alias("step"))
    moved = [F.col(q) + F.col(f"step.{q}") for q in quarters]
    inside = F.lit(True)
    for m in moved:
        inside = inside & m.between(0, QUARTER_BITS)
    near = near.where(inside).select(F.col("tile").alias("own"), F.col("part").alias("own_part"), "left", _tile_key(moved).alias("tile"))
    near = near.join(F.broadcast(parts), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    near = near.where((F.col("tile") != F.col("own")) | (F.col("part") >= F.col("own_part")))
    pairs = near.join(tiles.select("tile", "part", F.col("fps").alias("right")), ["tile", "part"])
    # a number of its own: few bytes make much work here, so partitions must not be merged by their size
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(spread, "own", "own_part", "tile", "part").select("left", "right")
    return bounded_batches(pairs).mapInPandas(_compared, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: 16 hex digits, and the smallest id among all documents reached by links."""
    marked = stored(fingerprints(docs))
    smallest = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(smallest.select("fp")))
    rooted = smallest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    table = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
