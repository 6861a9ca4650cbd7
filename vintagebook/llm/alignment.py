"""Aligning the tokens of two tokenizers by merging their end offsets along a merge path.

The ends of A's and B's tokens over a batch of texts are two ascending lists. Diagonals of
their merge at equal distances are placed by binary search, which cuts the merge into
pieces of equal work that know nothing of each other: a very long text is many pieces, and
short texts share one. All pieces advance together, a step at a time. A step at which both
current tokens are open is a link; a step at which B ends where A just ended closes a
group, and closings added up over the pieces before number the groups that pieces share.

How many documents link a pair of ids is summed over blocks of documents: within a block
every pair is named once, so that counts are joined to the pairs of blocks and not to those
of documents, and a block meets its own counts again to score its documents.

Defined cases: a null or empty text, or one that either tokenizer doesn't keep byte for
byte behind a space, has no tokens; special tokens' strings are plain text; a text of any
length is one row in one task; repeated rows are scored each and count each; a null id
stays null; no rows give no rows; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagebook.llm.common import bounded_batches
from vintagebook.llm.tokens import encoder, read_vocabulary, vocabulary_path
from vintagebook.session import stored

PIECES = "piece_bpe_32k.model"
#: Ends that one piece of the merge path takes.
WORK = 64
_BITS = 32
_PAIRS: dict[tuple[str, str], "Tokenizers"] = {}


def split_points(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d merged ends are of ``a``, for every diagonal d; of equal ends ``a``'s is first."""
    low, high = np.maximum(0, diagonals - b.size), np.minimum(diagonals, a.size)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        more = a[np.minimum(middle, a.size - 1)] <= b[np.clip(diagonals - 1 - middle, 0, b.size - 1)]
        low = np.where(open_ & more, middle + 1, low)
        high = np.where(open_ & ~more, middle, high)
    return low


@dataclass
class Alignment:
    """Links as token indices (a, b) in order, and where each group ends in either list of tokens."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray


def aligned(a: np.ndarray, b: np.ndarray, work: int = WORK) -> Alignment:
    """The alignment of two ascending lists of end offsets, the last of which are equal."""
    total = a.size + b.size
    starts = np.arange(0, total, work)
    i = split_points(a, b, starts)
    j = starts - i
    beyond = max(a[-1], b[-1]) + 1 if total else 0
    # index -1, before the first end, is the last element
    end_a, end_b = np.append(a, [beyond, -1]), np.append(b, [beyond, -1])
    at_a, at_b = np.empty((starts.size, work), np.int32), np.empty((starts.size, work), np.int32)
    closing = np.empty((starts.size, work), bool)
    for step in range(work):
        y = end_b[j]
        at_a[:, step], at_b[:, step] = i, j
        closing[:, step] = end_a[i - 1] == y
        forward = end_a[i] <= y
        i = np.minimum(i + forward, a.size)
        j = np.minimum(j + ~forward, b.size)
    at_a, at_b, closing = at_a.ravel()[:total], at_b.ravel()[:total], closing.ravel()[:total]
    linked = ~closing
    return Alignment(at_a[linked], at_b[linked], at_a[closing].astype(np.int64), at_b[closing].astype(np.int64) + 1)


class Tokenizers:
    """Both tokenizers with the bytes of their tokens; lives in a worker for as long as the worker does."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int], pieces: str):
        self.first: tiktoken.Encoding = encoder(ranks, special)
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        size = self.second.get_piece_size()
        names = [self.second.id_to_piece(i) for i in range(size)]
        self.second_bytes = [bytes([int(n[3:5], 16)]) if self.second.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.second_sizes = np.array([len(t) for t in self.second_bytes], np.int64)
        most = max(self.first.n_vocab, size)
        self.first_sizes = np.zeros(self.first.n_vocab, np.int64)
        for token, i in ranks.items():
            self.first_sizes[i] = len(token)
        self.written = [f"{i}{mark}" for i in range(most) for mark in ",|;"]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of either tokenizer per text, none where the bytes differ from those of a space and the text."""
        none = np.zeros(0, np.int64)
        for text, pieces in zip(texts, self.second.encode(texts, num_threads=1)):
            spaced = " " + text
            whole = spaced.encode()
            if not text or b"".join(map(self.second_bytes.__getitem__, pieces)) != whole:
                yield none, none
                continue
            ids = self.first.encode_to_numpy(spaced, disallowed_special=())
            yield (ids.astype(np.int64), np.array(pieces, np.int64)) if int(self.first_sizes[ids].sum()) == len(whole) else (none, none)

    def groups_of(self, ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment) -> np.ndarray:
        """Codes of the written groups: token ids in order, each with the mark behind it."""
        count_a, count_b = np.diff(found.ends_a, prepend=0), np.diff(found.ends_b, prepend=0)
        marks_a, marks_b = np.zeros(ids_a.size, np.int64), np.zeros(ids_b.size, np.int64)
        marks_a[found.ends_a - 1], marks_b[found.ends_b - 1] = 1, 2
        out = np.empty(ids_a.size + ids_b.size, np.int64)
        out[np.arange(ids_a.size) + np.repeat(found.ends_b - count_b, count_a)] = ids_a * 3 + marks_a
        out[np.arange(ids_b.size) + np.repeat(found.ends_a, count_b)] = ids_b * 3 + marks_b
        return out


_COLUMNS = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def block_rows(tokenizers: Tokenizers, block: int, doc_ids: list, texts: list[str]) -> pd.DataFrame:
    """A row per document, with the places of its pairs among the block's and how often each occurs, and one row with the block's pairs and their numbers of documents."""
    encoded = list(tokenizers.encode(texts))
    sizes_a, sizes_b = (np.array([ids[side].size for ids in encoded], np.int64) for side in (0, 1))
    ids_a, ids_b = (np.concatenate([ids[side] for ids in encoded]) for side in (0, 1))
    found = aligned(np.cumsum(tokenizers.first_sizes[ids_a]), np.cumsum(tokenizers.second_sizes[ids_b]))
    upto_a, upto_b = np.append(0, np.cumsum(sizes_a)), np.append(0, np.cumsum(sizes_b))
    n_groups = np.diff(np.searchsorted(found.ends_a, upto_a, "right"))
    of_link = np.repeat(np.arange(sizes_a.size), sizes_a)[found.a]
    n_links = np.bincount(of_link, minlength=sizes_a.size)
    codes = tokenizers.groups_of(ids_a, ids_b, found)
    digests = []
    for start, end in zip((upto_a + upto_b)[:-1].tolist(), (upto_a + upto_b)[1:].tolist()):
        written = "".join(map(tokenizers.written.__getitem__, codes[start:end].tolist()))
        digests.append(hashlib.sha256(written[:-1].encode()).hexdigest() if written else "")
    pairs, place = np.unique(ids_a[found.a] << _BITS | ids_b[found.b], return_inverse=True)
    keys, times = np.unique(of_link * max(pairs.size, 1) + place, return_counts=True)
    of_key, at = np.divmod(keys, max(pairs.size, 1))
    cuts = np.searchsorted(of_key, np.arange(1, sizes_a.size))
    rows = {
        "doc_id": [*doc_ids, None], "n_a": [*sizes_a, 0], "n_b": [*sizes_b, 0], "n_groups": [*n_groups, 0], "n_links": [*n_links, 0],
        "groups_sha256": [*digests, None], "block": block,
        "at": [*np.split(at.astype(np.int32), cuts), None], "times": [*np.split(times.astype(np.int32), cuts), None],
        "pairs": [None] * len(texts) + [pairs], "docs": [None] * len(texts) + [np.bincount(at, minlength=pairs.size).astype(np.int32)],
    }
    return pd.DataFrame(rows)


def blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``block_rows`` of every batch of ``docs``, as a stored table: a block's number holds for one run of its task only."""
    path_a, path_b = path_a or vocabulary_path(), path_b or vocabulary_path(PIECES)
    # the vocabulary's size is the file's, not the corpus'
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path_a))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (path_a, path_b) not in _PAIRS:
            _PAIRS[path_a, path_b] = Tokenizers(*shared.value, path_b)
        task = TaskContext.get().partitionId() << _BITS
        for n, batch in enumerate(batches):
            if len(batch):
                yield block_rows(_PAIRS[path_a, path_b], task | n, batch["doc_id"].tolist(), batch["text"].tolist())

    texts = bounded_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(texts.mapInPandas(read, f"{_COLUMNS}, block long, at array<int>, times array<int>, pairs array<long>, docs array<int>"))


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n_docs, best) over the corpus: best where no pair of the same A id has more documents."""
    named = made.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    counted = named.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n_docs"))
    # an A id has at most as many pairs as B's vocabulary has ids
    of_id = Window.partitionBy(F.shiftright("pair", _BITS))
    return counted.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_id))


def _score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    right = right.sort_values("pos")
    counts, best = right["n_docs"].to_numpy(np.int64), right["best"].to_numpy(bool)
    ends = np.cumsum([len(a) for a in left["at"]])
    at, times = (np.concatenate([np.asarray(a, np.int64) for a in left[c]]) if len(left) else np.zeros(0, np.int64) for c in ("at", "times"))

    def per_document(values: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(values))[np.append(0, ends)])

    out = left.drop(columns=["block", "at", "times"])
    return out.assign(n_best=per_document(times * best[at]), count_sum=per_document(times * counts[at]))


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) per row of ``docs``."""
    made = blocks(docs, path_a, path_b)
    counts = pair_counts(made)
    named = made.where("pairs is not null").select("block", F.posexplode("pairs").alias("pos", "pair"))
    known = named.join(counts, "pair").select(F.col("block").alias("of_block"), "pos", "n_docs", "best")
    rows = made.where("pairs is null").drop("pairs", "docs")
    scored = rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInPandas(_score, f"{_COLUMNS}, n_best long, count_sum long")
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def alignment_report(docs: DataFrame) -> DataFrame:
    out = alignments(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
