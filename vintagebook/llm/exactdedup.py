"""Exact dedup of whole texts by two-pass Bloom filtering, all in DataFrame operations.

The first pass counts the cells that text digests fall on and keeps the cells hit at
least twice, as bitmaps: a Bloom filter of digests that may be repeated. The second pass
tests every row against it. Rows that miss a cell are alone and pass straight through;
only the others are shuffled and grouped by their whole digest, so that a false alarm
costs a shuffled row and never a wrong result.

The filter takes ``BITS_PER_ROW`` bits a row. It is broadcast, so digests are dealt to as
many slices as keep each slice's filter within ``MOST_BUCKETS`` bitmaps of 4 KB, and each
slice is filtered by itself. All probes of a digest lie in one bitmap.

Defined cases: a null text is an empty one, and equal to it; texts are compared by SHA-256
of their UTF-8 bytes, of any length; the row of the largest id stays, a null id being the
smallest; of rows that repeat both id and text exactly one stays; no rows give no rows;
columns other than the id and the text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagebook.llm.common import looked_up, union_all
from vintagebook.session import stored, stored_folder

#: Bits of one bitmap (fixed by Spark's bitmap functions), bits a row, probes a digest, bitmaps of a slice at most (64 MB).
CELLS, BITS_PER_ROW, PROBES, MOST_BUCKETS = 1 << 15, 16, 3, 1 << 14
_SHA, _SLICE = "sha of the text", "slice of the sha"


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def shape(n_rows: int, most: int = MOST_BUCKETS) -> tuple[int, int]:
    """(slices, bitmaps of a slice) for so many rows."""
    needed = max(1, -(-n_rows * BITS_PER_ROW // CELLS))
    slices = -(-needed // most)
    return slices, -(-needed // slices)


def _slice_of(slices: int) -> Column:
    return F.pmod(F.xxhash64(_SHA), F.lit(slices)).cast("int")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(_SHA, F.lit("bucket")), F.lit(buckets)).cast("int")


def _cell(probe: int) -> Column:
    return F.pmod(F.xxhash64(_SHA, F.lit(probe)), F.lit(CELLS)).cast("int")


def hit_cells(digests: DataFrame, buckets: int, times: int = 2) -> DataFrame:
    """(bucket, bitmap): the cells that at least so many probes of the digests fall on."""
    cells = digests.select(_bucket(buckets).alias("bucket"), F.explode(F.array(*[_cell(i) for i in range(PROBES)])).alias("cell"))
    often = cells.groupBy("bucket", "cell").agg(F.count("*").alias("n")).where(F.col("n") >= times)
    return often.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("cell").cast("long")).alias("bitmap"))


def _is_set(bitmap: Column, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(cell, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, cell.bitwiseAND(7)) == 1


def tested(rows: DataFrame, cells: DataFrame, buckets: int, mark: str) -> DataFrame:
    """``rows`` with a column that is false where the digest is surely alone."""
    probed = cells.select(F.col("bucket").alias("bucket of the filter"), F.col("bitmap").alias("bitmap of the filter"))
    # at most MOST_BUCKETS bitmaps of 4 KB
    joined = rows.withColumn("bucket of the row", _bucket(buckets)).join(F.broadcast(probed), F.col("bucket of the row") == F.col("bucket of the filter"), "left")
    hit = F.col("bitmap of the filter").isNotNull()
    for i in range(PROBES):
        hit = hit & _is_set(F.col("bitmap of the filter"), _cell(i))
    return joined.withColumn(mark, F.coalesce(hit, F.lit(False))).drop("bucket of the row", "bucket of the filter", "bitmap of the filter")


def _filtered(digests: DataFrame, slices: int, buckets: int) -> Iterator[tuple[int, DataFrame]]:
    for i in range(slices):
        yield i, stored(hit_cells(digests.where(F.col(_SLICE) == i), buckets))


def _digests(docs: DataFrame, slices: int, *columns: Column) -> DataFrame:
    """Digests of all rows as a stored table, a folder per slice; texts are read once for it."""
    path = stored_folder(docs.sparkSession)
    named = docs.select(*columns, text_digest(F.col("text")).alias(_SHA))
    named.withColumn(_SLICE, _slice_of(slices)).write.partitionBy(_SLICE).parquet(path)
    schema = named.withColumn(_SLICE, F.lit(0)).schema
    return docs.sparkSession.read.schema(schema).parquet(path)


def duplicates(docs: DataFrame, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, shuffled) per row; ``shuffled`` tells the rows that the filter could not clear.

    The rows of ``docs`` are counted first, so give a table, not a costly plan.
    """
    n_rows = docs.count()
    slices, buckets = shape(n_rows, most_buckets)
    digests = _digests(docs, slices, F.col("doc_id"), F.monotonically_increasing_id().alias("row"))
    alone, maybe = [], []
    for i, cells in _filtered(digests, slices, buckets):
        marked = tested(digests.where(F.col(_SLICE) == i), cells, buckets, "maybe").select("doc_id", "row", _SHA, "maybe")
        alone.append(marked.where("not maybe").drop("maybe"))
        maybe.append(marked.where("maybe").drop("maybe"))
    flagged = stored(union_all(maybe))
    chosen = F.max(F.struct("doc_id", "row")).alias("keep")
    groups = stored(flagged.groupBy(_SHA).agg(chosen, F.count("*").alias("group_size")))
    grouped = looked_up(flagged, groups, _SHA, "group_size", n_rows)
    grouped = grouped.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), _SHA, F.lit(True).alias("shuffled"))
    straight = union_all(alone).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), _SHA, F.lit(False).alias("shuffled"))
    out = straight.unionByName(grouped)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex(_SHA)).alias("text_sha256"), "shuffled")


def deduplicated(docs: DataFrame, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: rows the filter clears never leave their partition."""
    slices, buckets = shape(docs.count(), most_buckets)
    digests = _digests(docs, slices)
    whole = docs.withColumn(_SHA, text_digest(F.col("text"))).withColumn(_SLICE, _slice_of(slices))
    straight, maybe = [], []
    for i, cells in _filtered(digests, slices, buckets):
        marked = tested(whole.where(F.col(_SLICE) == i), cells, buckets, "maybe repeated")
        straight.append(marked.where("not `maybe repeated`"))
        maybe.append(marked.where("`maybe repeated`"))
    flagged = union_all(maybe)
    keep = flagged.groupBy(F.col(_SHA).alias("sha of the group")).agg(F.max("doc_id").alias("id that stays"))
    # with the id in the key, a large group is dealt over all tasks
    same = (F.col(_SHA) == F.col("sha of the group")) & F.col("doc_id").eqNullSafe(F.col("id that stays"))
    stay = flagged.join(keep, same, "left_semi").dropDuplicates([_SHA, "doc_id"])
    return union_all(straight).unionByName(stay).select(*docs.columns)


def exact_dedup_report(docs: DataFrame) -> DataFrame:
    return duplicates(docs.select("doc_id", "text")).drop("shuffled")
