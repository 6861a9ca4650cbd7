"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and their beginnings, hashed. The machine adds a weight per
term and, for every two terms of a text, the product of their factor vectors, so an
insult beside the mention of a group can count for more than both alone.

The machine is fitted on at most about ``sample`` labelled rows, chosen by the hash of
their ids, in one task; scoring runs over all documents. Its size is bounded by
``BUCKETS`` and ``FACTORS``.

A term is learned if it stands out by itself or in a pair. Thousands of neutral terms of a
long text would otherwise drown a few insults.

Defined cases: null and empty texts score what no terms score; very long texts are read whole; with no labelled rows
every score is 0 and so is every prediction; rows with a null label teach nothing;
repeated rows stay.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from vintagebook.llm.common import bounded_batches, held_out

BUCKETS, FACTORS = 1 << 21, 4
#: Bound on the labelled rows the machine is fitted on.
SAMPLE = 16_000
EPOCHS, STEP, DECAY, LEAST_TEXTS, TELLING = 6, 0.08, 1e-4, 4, 4.0
#: So many of the most frequent terms are also looked at in pairs; a pair has to stand out further, as there are many.
PAIR_TERMS, PAIR_TELLING = 2048, 13.0
BEGINNINGS = (3, 5)
_WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 300_000
_KNOWN: dict[str, tuple[int, ...]] = {}


def _hashed(word: str) -> tuple[int, ...]:
    terms = ["w" + word] + [f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n]
    return tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms)


def terms_of(text: str | None) -> np.ndarray:
    """Sorted buckets of a text's terms, each once."""
    found: set[int] = set()
    if len(_KNOWN) > REMEMBERED:
        _KNOWN.clear()
    for word in set(_WORD.findall((text or "").lower())):
        hashed = _KNOWN.get(word)
        if hashed is None:
            hashed = _KNOWN[word] = _hashed(word)
        found.update(hashed)
    return np.sort(np.fromiter(found, np.int64, len(found)))


class Machine:
    """logit(x) = bias + sum of weights + sum over pairs of <factors, factors>."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors

    def rows(self, terms: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, terms)
        at[at == self.terms.size] = 0
        return at[self.terms[at] == terms] if self.terms.size else at[:0]

    def logit(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.rows(terms_of(text))), -40, 40))))


def telling_terms(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Sorted terms that are in enough texts and whose share among toxic ones stands out by ``TELLING`` deviations."""
    counts, toxic = (np.zeros(BUCKETS, np.float64) for _ in range(2))
    for text, label in zip(texts, labels):
        counts[text] += 1
        toxic[text] += label
    terms = np.flatnonzero(counts >= LEAST_TEXTS)
    counts, toxic = counts[terms], toxic[terms]
    some, none = max(labels.sum(), 1.0), max((1 - labels).sum(), 1.0)
    share = counts / max(labels.size, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / some + 1 / none))
    return terms[np.abs(toxic / some - (counts - toxic) / none) >= TELLING * spread]


def telling_pairs(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Sorted terms of pairs that tell more together than both do alone.

    Among texts with both terms the share of toxic ones stands out from what the two single
    shares add up to. Two words neither of which says anything by itself can be such a pair.
    """
    counts = np.zeros(BUCKETS, np.int64)
    for text in texts:
        counts[text] += 1
    often = np.sort(np.argsort(-counts, kind="stable")[:PAIR_TERMS])
    often = often[counts[often] >= LEAST_TEXTS]
    both, toxic = (np.zeros((often.size, often.size), np.float32) for _ in range(2))
    for at in range(0, len(texts), 512):
        held = np.zeros((len(texts[at : at + 512]), often.size), np.float32)
        for row, text in zip(held, texts[at : at + 512]):
            row[np.isin(often, text, assume_unique=True)] = 1
        both += held.T @ held
        held = held[labels[at : at + 512] > 0]
        toxic += held.T @ held
    base, n = labels.mean() if labels.size else 0.0, np.maximum(both, 1)
    alone = np.diag(toxic) / np.diag(n)
    expected = alone[:, None] + alone[None, :] - base
    apart = np.abs(toxic / n - np.clip(expected, 0, 1)) * np.sqrt(n) >= PAIR_TELLING * np.sqrt(max(base * (1 - base), 1e-9))
    # always met together: one term in two disguises
    differ = (both < 0.9 * np.diag(both)[:, None]) & (both < 0.9 * np.diag(both)[None, :])
    return often[(apart & differ & (both >= LEAST_TEXTS)).any(axis=1)]


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine for term lists and 0/1 labels, by adaptive gradient steps, one text at a time in a seeded order."""
    terms = np.union1d(telling_terms(texts, labels), telling_pairs(texts, labels))
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    m = Machine(terms, float(np.log(share / (1 - share))), np.zeros(terms.size), rng.normal(0, 0.01, (terms.size, FACTORS)))
    rows = [m.rows(t) for t in texts]
    past_w, past_v = np.full(terms.size, 1e-2), np.full((terms.size, FACTORS), 1e-2)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = m.factors[r]
            total = v.sum(axis=0)
            logit = m.bias + m.weights[r].sum() + 0.5 * (total @ total - (v * v).sum())
            g = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[i]
            if abs(g) < 1e-3:
                continue
            m.bias -= 0.01 * g
            gw, gv = g + DECAY * m.weights[r], g * (total - v) + DECAY * v
            past_w[r] += gw * gw
            past_v[r] += gv * gv
            m.weights[r] -= STEP * gw / np.sqrt(past_w[r])
            m.factors[r] -= STEP * np.clip(gv, -1, 1) / np.sqrt(past_v[r])
    return m


@F.pandas_udf(ArrayType(LongType()))
def _terms(texts: pd.Series) -> pd.Series:
    return pd.Series([terms_of(t) for t in texts])


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    texts, labels = [], []
    for batch in batches:
        texts += [np.asarray(t, np.int32) for t in batch["terms"]]
        labels += batch["toxic"].tolist()
    if labels:
        m = fit(texts, np.asarray(labels, np.float64))
        packed = (m.terms.astype(np.int32), m.bias, m.weights.astype(np.float32), m.factors.astype(np.float32))
        yield pd.DataFrame({"machine": [pickle.dumps(packed)]})


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """The machine learned from the labelled rows of ``docs``, or None if there are none."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select(_terms(F.col("text")).alias("terms"), "toxic", F.xxhash64("doc_id").alias("place"))
    found = bounded_batches(rows).repartition(1).sortWithinPartitions("place").select("terms", "toxic").mapInPandas(_fitted, "machine binary").collect()
    return Machine(*pickle.loads(found[0]["machine"])) if found else None


def toxicity(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """All columns of ``docs`` and score, predicted; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([0.0 if shared.value is None else shared.value.score(t) for t in texts], dtype="float64")

    out = bounded_batches(docs).withColumn("score", scored(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels are learned only from rows that are not held out."""
    machine = trained(docs, labels.where(~held_out(F.col("doc_id"))))
    out = toxicity(docs.select("doc_id", "text"), machine)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
