"""Best-fit packing with certified bin counts.

Short pieces are dealt over partitions, alike in their lengths, and packed best fit decreasing. The dual-feasible
function that bounds the whole best gives every partition a lower bound for its number of
sequences; these add up to the bound of the whole. A partition with a gap keeps the
sequences that meet their bound and exchanges the pieces of the others, and some of
sequences of many small pieces to fill gaps with, with the other partitions; they are
dealt anew and packed again, until one partition is left or nothing is left to exchange.

Defined cases: a null text is an empty one and gives one piece of the end token;
repeated rows are packed each; a null id stays null; no rows give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagebook.llm.common import bounded_batches, union_all
from vintagebook.llm.tokens import encoder, read_vocabulary, vocabulary_path
from vintagebook.session import stored

CAPACITY, END = 1024, 2
#: Pieces of a partition, about; a partition is packed by one task.
PARTITION = 1 << 15
ROUNDS = 12
#: A sequence short of its bound by more than this is exchanged, and so is this share of the sequences with most pieces.
SLACK, STOCK = 0.01, 0.02
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's tokens and end token; only the first piece of a cut one is shorter."""
    path = path or vocabulary_path()
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _ENCODERS:
            _ENCODERS[path] = encoder(*shared.value)
        encode = _ENCODERS[path].encode_to_numpy
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode(text, allowed_special="all"), end).astype("<u4")
                bounds = [0, *range(ids.size % capacity or capacity, ids.size + 1, capacity)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for column, value in zip(rows, (doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        rows[column].append(value)
            # ids travel as text, so that a null among them doesn't make numbers of floats
            yield pd.DataFrame(rows)

    texts = bounded_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = texts.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every length and the fill of every bin, by best fit decreasing."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fills = np.zeros(lengths.size, np.int64), np.zeros(lengths.size, np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = bytearray(capacity + 1)
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        room = some.find(1, length)
        if room < 0:
            chosen, room = len(fills), capacity
            fills.append(0)
        else:
            chosen = open_bins[room].pop()
            some[room] = bool(open_bins[room])
        bins[i], offsets[i] = chosen, capacity - room
        fills[chosen] += length
        open_bins[room - length].append(chosen)
        some[room - length] = room > length
    return bins, offsets, np.asarray(fills, np.int64)


def best_dual(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Weights of the lengths 0 .. capacity under the dual-feasible function with the largest sum for these counts.

    No sequence's weights exceed 1 in sum, so the sum over any pieces bounds their sequences
    from below, and the bounds of partitions add up to that of the whole. Tried are the
    functions that drop lengths below a limit and round up those above its complement, and
    those that round to multiples of 1/k, for small k.
    """
    size = np.arange(capacity + 1)
    found, best = size / capacity, float((counts * size).sum()) / capacity
    for limit in range(1, capacity // 2 + 1):
        weights = np.where(size > capacity - limit, 1.0, np.where(size < limit, 0.0, size / capacity))
        if (total := float((counts * weights).sum())) > best:
            found, best = weights, total
    for k in range(1, 21):
        weights = np.where((k + 1) * size % capacity == 0, size / capacity, (k + 1) * size // capacity / k)
        if (total := float((counts * weights).sum())) > best:
            found, best = weights, total
    return found


def lower_bound(lengths: np.ndarray, capacity: int) -> float:
    """A bound on the number of sequences, not rounded up."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    return float((counts * best_dual(counts, capacity)).sum())


def _packed(capacity: int, dual: np.ndarray, round_no: int, last: bool):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit(lengths, capacity)
        certified = np.bincount(bins, weights=dual[lengths])
        gap = fills.size - certified.sum()
        done = np.ones(fills.size, bool)
        if gap > 1e-9 and not last:
            done[certified < 1 - SLACK] = False
            done[np.argsort(certified, kind="stable")[: 4 * math.ceil(gap)]] = False
        if not last:
            # sequences of many small pieces, which fit in where others' gaps are
            done[np.argsort(-np.bincount(bins), kind="stable")[: math.ceil(STOCK * fills.size)]] = False
        sequence = ((np.int64(round_no) << 20 | np.int64(key[0])) << 32 | bins) * 2 + 1
        return rows.assign(sequence_id=sequence, offset=offsets, done=done[bins])

    return pack


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``cut`` (with a length up to the capacity) and sequence_id, offset."""
    shuffles = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(cut).withColumn("row", F.monotonically_increasing_id())
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.col("row") * 2).withColumn("offset", F.lit(0).cast("long"))
    out, rest, before = [full], cut.where(F.col("length") < capacity), None
    schema = rest.schema.simpleString()[7:-1].replace(":", " ") + ", part int, sequence_id long, offset long, done boolean"
    for round_no in range(ROUNDS):
        # one row per length, so never more than the capacity
        counts = np.zeros(capacity + 1, np.int64)
        for row in rest.groupBy("length").count().collect():
            counts[row["length"]] = row["count"]
        n = int(counts.sum())
        if not n:
            break
        dual = best_dual(counts, capacity)
        parts = math.ceil(n / PARTITION)
        last = parts == 1 or n == before or round_no == ROUNDS - 1
        # dealt in order of length, as cards are, so that partitions are alike in their lengths
        ordered = rest.repartitionByRange(shuffles, "length", "row").sortWithinPartitions("length", "row")
        dealt = ordered.withColumn("part", F.pmod(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + F.spark_partition_id(), F.lit(parts)).cast("int"))
        placed = stored(bounded_batches(dealt).groupBy("part").applyInPandas(_packed(capacity, dual, round_no, last), schema))
        out.append(placed.where("done").select(full.columns))
        if last:
            break
        rest, before = placed.where("not done").select(cut.columns), n
    return union_all(out).drop("row")


def packing_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    return packed(pieces(docs, path))
