"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rotated) by its place; a text's vector bundles
(adds) those of its n-grams, and a language's prototype those of its training texts.

Because bundling is a sum, the product of a text with a prototype is the sum over
its n-grams of one number per n-gram and language. Spark counts the n-grams of the
training texts per language, multiplies every possible n-gram vector with the
prototypes once, in slices, and hands the table of products (letters**3 x languages)
to the scoring tasks; no text's vector has to be built to get its exact cosines up
to the text's own length, which is the same for all languages.

Defined cases: null or letterless texts give ``und`` and score 0, as does every text
where nothing could be learned; ties go to the first language by code point; rows
with a null language teach nothing; repeated rows stay and teach each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagebook.llm.common import bounded_batches, held_out

LETTERS, N, DIMENSIONS, SEED = 64, 3, 4096, 20
GRAMS = LETTERS**N
UNKNOWN = "und"
SLICE = 4096
#: Languages are few: a table of products of more than this many raises instead of growing.
MOST_LANGUAGES = 2000


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code of every code point: 0 for what is no letter, a to z one each, other letters spread over the rest."""
    codes = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            codes[point] = 1 + point - 97 if 97 <= point <= 122 else 27 + (point * 2654435761 >> 7) % (LETTERS - 27)
    return codes


def grams_of(text: str | None) -> np.ndarray:
    """Codes of the n-grams of a text, lower-cased, every run of other characters as one blank."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_codes()[points].astype(np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])]
    if codes.size < N:
        return np.zeros(0, np.int64)
    return (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of n-gram codes, one row each."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))
    first, second, third = codes // LETTERS**2, codes // LETTERS % LETTERS, codes % LETTERS
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            grams = grams_of(text)
            if grams.size:
                if lang not in sums:
                    if len(sums) == 32:
                        yield from _rows(sums)
                        sums = {}
                    sums[lang] = np.zeros(GRAMS, np.int64)
                sums[lang] += np.bincount(grams, minlength=GRAMS) if grams.size > 20_000 else 0
                if grams.size <= 20_000:
                    np.add.at(sums[lang], grams, 1)
    yield from _rows(sums)


def _rows(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for lang, counts in sums.items():
        gram = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "gram": gram, "n": counts[gram]})


def _bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial prototypes: sums of n-gram vectors, weighted by the logarithm of their counts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            gram, weight = part["gram"].to_numpy(), np.log1p(part["n"].to_numpy(np.float64))
            total = sums.setdefault(lang, np.zeros(DIMENSIONS))
            for at in range(0, gram.size, SLICE):
                total += weight[at : at + SLICE] @ gram_vectors(gram[at : at + SLICE])
    for lang, total in sums.items():
        yield pd.DataFrame({"lang": [lang], "vector": [total.tobytes()]})


def prototypes(training: DataFrame) -> dict[str, np.ndarray]:
    """Language -> prototype of unit length, centred on the mean of all, from rows (lang, text)."""
    counts = bounded_batches(training.select("lang", "text")).mapInPandas(_counted, "lang string, gram int, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for row in counts.mapInPandas(_bundled, "lang string, vector binary").toLocalIterator():
        found[row["lang"]] = found.get(row["lang"], 0) + np.frombuffer(row["vector"])
        if len(found) > MOST_LANGUAGES:
            raise ValueError("more languages than a profile table is meant for")
    unit = {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items())}
    if len(unit) > 1:
        mean = sum(unit.values()) / len(unit)
        unit = {lang: (v - mean) / np.linalg.norm(v - mean) for lang, v in unit.items()}
    return unit


def products(spark, profiles: dict[str, np.ndarray]) -> np.ndarray:
    """n-gram x language: products of n-gram vectors with prototypes, computed in slices by Spark."""
    matrix = np.stack(list(profiles.values()), axis=1).astype(np.float32)

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["id"]:
                part = gram_vectors(np.arange(at * SLICE, (at + 1) * SLICE)).astype(np.float32) @ matrix
                yield pd.DataFrame({"id": [at], "part": [part.tobytes()]})

    parts = spark.range(GRAMS // SLICE).mapInPandas(sliced, "id long, part binary").collect()
    return np.concatenate([np.frombuffer(r["part"], np.float32).reshape(SLICE, -1) for r in sorted(parts, key=lambda r: r["id"])])


def languages(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``; the score is the best cosine's share of all languages' (0 to 1)."""
    spark = docs.sparkSession
    profiles = prototypes(training.where(F.col("lang").isNotNull()))
    names = list(profiles)
    shared = spark.sparkContext.broadcast(products(spark, profiles)) if names else None

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        labels, scores = [], []
        for text in texts:
            grams = grams_of(text) if shared else np.zeros(0, np.int64)
            if not grams.size or not (grams % LETTERS).any() and not (grams // LETTERS % LETTERS).any():
                labels.append(UNKNOWN)
                scores.append(0.0)
                continue
            sums = shared.value[grams].sum(axis=0, dtype=np.float64)
            best = int(sums.argmax())
            size = np.sqrt(DIMENSIONS * grams.size)
            shares = np.exp((sums - sums[best]) / size)
            labels.append(names[best])
            scores.append(float(1 / shares.sum()))
        return pd.DataFrame({"lang_pred": labels, "score": scores})

    return bounded_batches(docs).select("doc_id", scored(F.col("text")).alias("found")).select("doc_id", "found.lang_pred", "found.score")


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents that are not held out."""
    found = languages(docs, docs.where(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
