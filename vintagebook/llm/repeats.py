"""Repeated passages by prefix-free parsing: what occurs twice, over all texts and byte by byte.

Every window of ``length`` bytes has one trigger, the leftmost smallest of the rolling
hashes inside it, which depends on the window's own bytes alone. Neighbouring windows
with the same trigger form a phrase; phrases overlap by ``length - 1`` bytes, so every
window lies in exactly one phrase, and equal windows lie in phrases of equal triggers at
equal distances from it. The corpus becomes a parse (places of phrases) and a dictionary
(distinct phrases, by trigger). Hence

* a trigger that occurs once holds no repeat;
* a trigger all of whose phrases are equal holds only repeats;
* otherwise the suffixes of the trigger's distinct phrases are sorted, to ``length`` bytes,
  by prefix doubling: windows of equal rank are repeats, and so are all windows of a phrase
  that the parse has twice.

Because phrases overlap by a whole window, comparisons never run past a phrase's end, and
all that is needed of the parse's own order is how often a phrase occurs. Only dictionary
phrases of the third kind travel as bytes. Triggers with more distinct phrases than a task
should sort are resolved by counting hashes of their windows instead, with the same result.

Defined cases: null and empty texts have no bytes; texts shorter than a window keep all
theirs; equal rows repeat each other; matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagebook.llm.common import bounded_batches
from vintagebook.session import stored

LENGTH, CONTEXT = 200, 48
#: Windows handled at a time, so that a very long text needs no more memory.
CHUNK = 1 << 21
#: Bytes of dictionary sorted at a time, and distinct phrases of a trigger that one task sorts.
SORT_BYTES, SORTED_PHRASES = 2 << 20, 20_000
_BASE = 0x9E3779B97F4A7C15
_POSITION_BITS = 22
_POWERS: list[np.ndarray] = []


def tidy_shuffles(spark: SparkSession) -> None:
    """Let shuffle files go when the query that made them ends; results between steps are stored tables."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or _POWERS[0].size < n:
        size = max(n, 1 << 17)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS.append(np.cumprod(row))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_LETTERS = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(data.size + 1)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_LETTERS[data] * power[:-1], out=sums[1:])
    return sums, inverse


def phrases_of(data: np.ndarray, length: int = LENGTH, context: int = CONTEXT) -> tuple[np.ndarray, ...]:
    """(first window, windows, trigger hash, phrase hash) of every phrase of a text's bytes."""
    parts = []
    for at in range(0, max(data.size - length + 1, 0), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        sums, inverse = _prefix_sums(part)
        grams = part.size - context + 1
        hashes = _mixed((sums[context:] - sums[:-context]) * inverse[:grams])
        # smallest (hash, position) of every window, in two running minima over blocks
        span = length - context + 1
        ranked = hashes >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS) | np.arange(grams, dtype=np.uint64)
        blocks = np.full(-(-grams // span) * span, np.iinfo(np.uint64).max, np.uint64)
        blocks[:grams] = ranked
        blocks = blocks.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = part.size - length + 1
        trigger = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        n = np.diff(np.append(first, windows))
        end = first + n + length - 1
        whole = _mixed((sums[end] - sums[first]) * inverse[first] + n.astype(np.uint64) * np.uint64(_BASE))
        parts.append((first + at, n, hashes[trigger[first]].view(np.int64), whole.view(np.int64)))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 200):
            part = batch.iloc[at : at + 200]
            rows = [phrases_of(np.frombuffer(text, np.uint8)) for text in part["data"]]
            sizes = [r[0].size for r in rows]
            first, n, key, phrase = (np.concatenate(x) for x in zip(*rows))
            yield pd.DataFrame({"no": np.repeat(part["no"].to_numpy(), sizes), "copies": np.repeat(part["copies"].to_numpy(), sizes), "first": first, "n": n, "key": key, "phrase": phrase})


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the wanted phrases of each text."""
    names = ["key", "phrase", "copies", "big", "bytes"]
    for batch in batches:
        rows: list[tuple] = []
        for text, wanted in zip(batch["data"], batch["wanted"]):
            rows += [(w["key"], w["phrase"], w["copies"], w["big"], text[w["first"] : w["first"] + w["n"] + LENGTH - 1]) for w in wanted]
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def _dense(values: np.ndarray) -> np.ndarray:
    """The place of every value among the different ones."""
    order = np.argsort(values)
    ranked = values[order]
    steps = ranked[1:] != ranked[:-1]
    del ranked
    places = np.zeros(values.size, np.int32)
    places[order[1:]] = np.cumsum(steps, dtype=np.int32)
    return places


def window_ranks(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Order of the ``length`` bytes from every start (equal ones alike), by doubling the length of what is ranked."""
    size = data.size - 7
    packed = np.zeros(size, np.uint64)
    for i in range(8):
        packed <<= np.uint64(8)
        packed |= data[i : i + size]
    rank, known = _dense(packed), 8
    del packed

    def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        both = left.astype(np.int64)
        both *= rank.size + 1
        both += right
        return both

    while known * 2 < length:
        rank, known = _dense(pairs(rank[: rank.size - known], rank[known:])), known * 2
    return _dense(pairs(rank[starts], rank[starts + length - known]))


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"o": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]


_RUNS = "key long, phrase long, runs array<struct<o:int,n:int>>"


def _ranked(rows: pd.DataFrame) -> pd.DataFrame:
    data = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
    sizes = rows["bytes"].map(len).to_numpy(np.int64)
    windows = sizes - LENGTH + 1
    bounds = np.concatenate([[0], np.cumsum(windows)])
    starts = np.arange(bounds[-1]) + np.repeat(np.cumsum(sizes) - sizes - bounds[:-1], windows)
    rank = window_ranks(data, starts)
    again = (np.bincount(rank)[rank] > 1) | np.repeat(rows["copies"].to_numpy() > 1, windows)
    runs = [_runs(again[a:b]) for a, b in zip(bounds, bounds[1:])]
    return pd.DataFrame({"key": rows["key"].to_numpy(), "phrase": rows["phrase"].to_numpy(), "runs": runs})


def _sorted_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated windows of dictionary phrases; rows of a key come together, many keys are sorted at a time.

    Batches are taken in parts, as sorting takes about thirty times the bytes that are sorted.
    """
    held: list[pd.DataFrame] = []
    size = 0
    for part in (p for b in batches if len(b) for _, p in b.groupby(b["bytes"].map(len).cumsum() // SORT_BYTES)):
        held.append(part)
        size += int(part["bytes"].map(len).sum())
        if size < SORT_BYTES:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = rows["key"] == rows["key"].iloc[-1]
        if not last.all():
            yield _ranked(rows[~last])
        held = [rows[last]]
        size = int(held[0]["bytes"].map(len).sum())
    if held:
        yield _ranked(pd.concat(held, ignore_index=True))


def _hashed_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for key, phrase, copies, data in zip(batch["key"], batch["phrase"], batch["copies"], batch["bytes"]):
            sums, inverse = _prefix_sums(np.frombuffer(data, np.uint8))
            window = (sums[LENGTH:] - sums[:-LENGTH]) * inverse[: sums.size - LENGTH]
            yield pd.DataFrame({"key": key, "phrase": phrase, "o": np.arange(window.size), "copies": copies, "window": window.view(np.int64)})


def _counted_runs(slices: DataFrame) -> DataFrame:
    """The same for triggers with very many phrases: windows are counted by hash, spread over all tasks."""
    windows = slices.mapInPandas(_hashed_windows, "key long, phrase long, o int, copies long, window long")
    again = windows.groupBy("key", "window").agg(F.sum("copies").alias("times")).where("times > 1").select("key", "window")
    found = windows.join(again, ["key", "window"]).groupBy("key", "phrase").agg(F.collect_list(F.struct("o", F.lit(1).alias("n"))).alias("runs"))
    return found.select("key", "phrase", "runs")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(hash, no, copies, data) of every different text as bytes; ``no`` numbers them."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    once = docs.select(F.md5(text).alias("hash"), text.alias("data")).groupBy("hash").agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    return stored(once.withColumn("no", F.monotonically_increasing_id()))


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(no, spans array<struct<first, n>>): first windows and numbers of windows that occur elsewhere too."""
    tidy_shuffles(texts.sparkSession)
    long_ones = texts.where(F.octet_length("data") >= LENGTH)
    parse = stored(bounded_batches(long_ones.select("no", "copies", "data")).mapInPandas(_parsed, "no long, copies long, first int, n int, key long, phrase long"))
    keys = parse.groupBy("key").agg(F.sum("copies").alias("times"), F.min("phrase").alias("low"), F.max("phrase").alias("high")).where("times > 1")
    # stored, so that the join below reads plain shuffles on both sides, of which a very frequent trigger's can be split
    keys = stored(keys.select("key", (F.col("low") == F.col("high")).alias("alike")))
    several = stored(parse.join(keys, "key"))
    alike = several.where("alike").select("no", "first", "n")

    apart = several.where("not alike")
    dictionary = stored(apart.groupBy("key", "phrase").agg(F.sum("copies").alias("copies"), F.first("no").alias("no"), F.first("first").alias("first"), F.first("n").alias("n")))
    kinds = dictionary.groupBy("key").agg(F.count("*").alias("kinds")).select("key", (F.col("kinds") > SORTED_PHRASES).alias("big"))
    wanted = dictionary.join(kinds, "key").groupBy("no").agg(F.collect_list(F.struct("key", "phrase", "copies", "big", "first", "n")).alias("wanted"))
    slices = bounded_batches(texts.select("no", "data").join(wanted, "no").select("data", "wanted"))
    slices = stored(slices.mapInPandas(_slices, "key long, phrase long, copies long, big boolean, bytes binary"))
    sort = slices.where("not big").drop("big").repartition("key").sortWithinPartitions("key")
    runs = sort.mapInPandas(_sorted_runs, _RUNS).where(F.size("runs") > 0).unionByName(_counted_runs(slices.where("big")))
    placed = apart.join(runs, ["key", "phrase"]).select("no", "first", F.explode("runs").alias("run"))
    placed = placed.select("no", (F.col("first") + F.col("run.o")).alias("first"), F.col("run.n").alias("n"))
    spans = alike.unionByName(placed).groupBy("no").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    return stored(spans)


def _cut(text: bytes, spans, length: int = LENGTH) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs (start, end)."""
    removed: list[tuple[int, int]] = []
    for first, n in sorted((s["first"], s["n"]) for s in spans if s is not None):
        if removed and first <= removed[-1][1]:
            removed[-1] = (removed[-1][0], max(removed[-1][1], first + n + length - 1))
        else:
            removed.append((first, first + n + length - 1))
    kept, at = [], 0
    for a, b in removed:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), removed


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` its columns and n_bytes, n_removed, n_spans, kept_sha256, and kept (the text left over) on demand.

    Kept text drops the bytes of characters that a removed passage cuts in two; counts and digests are of bytes.
    """
    texts = distinct_texts(docs)
    schema = "hash string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")

    def reported(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(batch["hash"], batch["data"], batch["spans"]):
                kept, removed = _cut(text, () if spans is None else spans)
                row = (key, len(text), len(text) - len(kept), len(removed), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    spans = repeated_windows(texts)
    found = bounded_batches(texts.select("no", "hash", "data").join(spans, "no", "left").select("hash", "data", "spans")).mapInPandas(reported, schema)
    made = [c.split()[0] for c in schema.split(", ")[1:]]
    own = docs.drop(*made).withColumn("hash of the text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    found = found.withColumnRenamed("hash", "hash of the text")
    return own.join(found, "hash of the text").select(*[c for c in docs.columns if c not in made], *made)


def repeats_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    return without_repeats(docs.select("doc_id", "text")).drop("text")
