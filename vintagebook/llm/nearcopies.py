"""Near copies: groups of texts linked by a Jaccard similarity of five-word shingles of 0.8 or more.

Texts of one set of shingles are one node. A node goes on only if it shares one of ``BANDS``
bands of ``BAND_ROWS`` minimal hashes with another; a pair of similarity 0.8 misses all of
them once in 2.5 million. Nodes that go on are compared by prefixes: with shingles ordered
from rare to frequent, two sets that are near share one among the first fifth of each, and
at places that leave room for the overlap they need. Few texts that are not near do.

Candidates come from SimHash first (nodes of one group of fingerprints within its radius):
they go on whether or not they share a band, and those found near are one component before
prefixes are looked at. Then every node is compared with one star of each of its prefix
shingles, the one whose place there is first, unless both are in one component already. Then members of a prefix shingle that are still in
different components are compared with each other, all of them. Every link is an exact
comparison of the two sets.

Defined cases: null and blank texts are equal; texts shorter than a shingle are one
shingle; texts of any length are read whole; a null id is larger than any other; rows that
repeat both id and text are one in choosing which stays; rows of one id and different texts
are different documents; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from vintagebook.llm import exactdedup, simhash
from vintagebook.llm.common import bounded_batches, union_all
from vintagebook.llm.graph import components
from vintagebook.session import stored

#: Similarity at least NEAR[0] / NEAR[1].
SHINGLE, SEED, NEAR = 5, 42, (4, 5)
BANDS, BAND_ROWS = 28, 4
#: Hashes that a worker holds before it hands sets on, about.
SETS_AT_ONCE = 1 << 17
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_PART, _WHOLE = NEAR


def buckets(hashes: np.ndarray) -> list[int]:
    """One key per band, signed."""
    if not hashes.size:
        return []
    least = np.full(_FACTORS.size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, hashes.size, 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * _FACTORS).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


@F.pandas_udf(StructType().add("s", LongType()).add("fp", LongType()).add("keys", ArrayType(LongType())))
def _marks(texts: pd.Series) -> pd.DataFrame:
    hashes = [simhash.shingle_hashes(t, SHINGLE) for t in texts]
    sets = [np.unique(h) for h in hashes]
    named = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
    return pd.DataFrame({"s": named, "fp": [simhash.majority_bits(h) for h in hashes], "keys": [buckets(h) for h in sets]})


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, text) to (s, size, hashes), a few hashes at a time; sets of no shingles are left out."""
    names: list[int] = []
    sets: list[np.ndarray] = []

    def made() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.diff(ends)), hashes], ["s", "size", "hashes"])

    for batch in batches:
        held = 0
        for name, text in zip(batch.column("s"), batch.column("text")):
            found = np.unique(simhash.shingle_hashes(text.as_py(), SHINGLE)).view(np.int64)
            if found.size:
                names.append(name.as_py())
                sets.append(found)
                held += found.size
            if held >= SETS_AT_ONCE:
                yield made()
                names.clear()
                sets.clear()
                held = 0
        yield made()
        names.clear()
        sets.clear()


def row_key(doc_id: Column, text: Column) -> Column:
    """A digest of the id and the text."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))).cast("binary"))


def _chosen_sets(docs: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(s, size, hashes) of the nodes that share a bucket with another, or are in one of the ``linked`` pairs."""
    spread = nodes.select("s", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    chosen = spread.join(shared, "key", "left_semi").select("s")
    chosen = chosen.unionByName(linked.select(F.explode(F.array("a", "b")).alias("s"))).distinct()
    chosen = stored(chosen.join(nodes, "s").select("s", F.col("low.k").alias("k")))
    # only texts that a filter of the chosen keys lets through are moved
    digest = F.unhex(F.col("k")).alias(exactdedup._SHA)
    slices, width = exactdedup.shape(chosen.count())
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("k"), "text").withColumn(exactdedup._SHA, F.unhex("k"))
    kept = []
    for i in range(slices):
        own = exactdedup._slice_of(slices) == i
        cells = stored(exactdedup.hit_cells(chosen.select(digest).where(own), width, 1))
        kept.append(exactdedup.tested(texts.where(own), cells, width, "maybe").where("maybe").select("k", "text"))
    found = union_all(kept).join(chosen, "k").groupBy("s").agg(F.first("text").alias("text"))
    return stored(bounded_batches(found).mapInArrow(_set_rows, "s long, size int, hashes array<long>"))


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, s, size, pos): the first shingles of every set, from rare to frequent, that another set has too."""
    tokens = sets.select("s", "size", F.explode("hashes").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("s")
    ranked = tokens.join(common, "token").withColumn("m", F.count("*").over(own))
    ranked = ranked.withColumn("pos", F.col("size") - F.col("m") + F.row_number().over(own.orderBy("n", "token")) - 1)
    least = F.ceil(F.col("size") * _PART / _WHOLE)
    return ranked.where(F.col("pos") <= F.col("size") - least).select("token", "s", "size", F.col("pos").cast("int").alias("pos"))


def _roomy(size: Column, pos: Column, other_size: Column, other_pos: Column) -> Column:
    """Whether what follows both places is enough for the overlap that near sets need."""
    return F.least(size - pos, other_size - other_pos) * (_PART + _WHOLE) >= (size + other_size) * _PART


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that are near."""
    both = pairs.join(sets.selectExpr("s AS a", "size AS size_a", "hashes AS left"), "a").join(sets.selectExpr("s AS b", "size AS size_b", "hashes AS right"), "b")
    common = F.size(F.array_intersect("left", "right"))
    return both.where(common * (_PART + _WHOLE) >= (F.col("size_a") + F.col("size_b")) * _PART).select("a", "b")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Nodes that SimHash links: those of one fingerprint beside the smallest of them, and these along the links of fingerprints."""
    stars = stored(nodes.groupBy("fp").agg(F.min("s").alias("star")))
    same = nodes.select("s", "fp").join(stars, "fp").where("s <> star").select(*_pairs(F.col("s"), F.col("star")))
    links = simhash.links(stars.select("fp")).select(F.col("a").alias("fp"), "b").join(stars, "fp").select(F.col("star").alias("x"), F.col("b").alias("fp"))
    return same.unionByName(links.join(stars, "fp").select(*_pairs(F.col("x"), F.col("star"))))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, k, component_id, kept_k) per row: keys of the row and of the row that stays, and that one's id.

    Of all documents reached by links the one of the smallest id stays; of those of one id, the one of the smallest key.
    """
    marked = bounded_batches(docs).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("k"), _marks(F.col("text")).alias("m"))
    marked = stored(marked.select("doc_id", "k", "m.s", "m.fp", "m.keys"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("low")
    nodes = stored(marked.groupBy("s").agg(F.first("keys").alias("keys"), F.min("fp").alias("fp"), first))
    linked = stored(_fingerprint_pairs(nodes).distinct())
    sets = _chosen_sets(docs, nodes, linked)
    edges = stored(_checked(linked, sets))
    entries = prefixes(sets).join(components(edges).withColumnRenamed("node", "s"), "s", "left")
    entries = stored(entries.withColumn("root", F.coalesce("root", "s")))
    stars = entries.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("pos", "s", "size", "root")).alias("star")).where("n > 1").drop("n")
    beside = entries.join(stars, "token").where("root <> star.root").where(_roomy(F.col("size"), F.col("pos"), F.col("star.size"), F.col("star.pos")))
    tried = stored(beside.select(*_pairs(F.col("s"), F.col("star.s"))).distinct())
    edges = stored(edges.unionByName(_checked(tried, sets)))

    roots = stored(components(edges).withColumnRenamed("node", "s"))
    placed = stored(entries.drop("root").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")))
    apart = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    apart = placed.join(apart, "token", "left_semi")
    others = apart.selectExpr("token", "s AS other", "size AS other_size", "pos AS other_pos", "root AS other_root")
    rest = apart.join(others, "token").where("s < other AND root <> other_root").where(_roomy(F.col("size"), F.col("pos"), F.col("other_size"), F.col("other_pos")))
    rest = rest.select(F.col("s").alias("a"), F.col("other").alias("b")).distinct().join(tried.unionByName(linked), ["a", "b"], "left_anti")
    more = _checked(rest, sets)

    known = roots.select(F.col("root").alias("a"), F.col("s").alias("b"))
    roots = components(known.unionByName(more)).withColumnRenamed("node", "s")
    rooted = nodes.select("s", "low").join(roots, "s", "left").select("s", F.coalesce("root", "s").alias("root"), "low")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("stays"))
    known = rooted.join(lowest, "root").select("s", F.col("stays.doc_id").alias("component_id"), F.col("stays.k").alias("kept_k"))
    return marked.select("doc_id", "k", "s").join(known, "s").select("doc_id", "k", "component_id", "kept_k")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    key = "key of the row"
    stay = near_copies(docs).where("k = kept_k").select(F.col("k").alias(key)).distinct()
    return docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
