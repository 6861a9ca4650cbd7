import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.conftest import documents

from vintagebook.llm.packing import best_fit, lower_bound, packed, packing_report
from vintagebook.llm.tokens import read_vocabulary, token_counts, vocabulary_path, whole_tokens

tokenizers = pytest.importorskip("tokenizers")


def texts():
    rng = random.Random(5)
    odd = [" ", " ", "　", "\x1c", "\x85", "᠎", "​", "﻿", "\r\n", "\t", "  ", "\n\n", "'s", "'re", "'T", "''ll", "x'd", "12½", "٣", "été", "é", "\U0001f600", "中文", "<|endoftext|>", "<|endoftext", " the", "Hello", "!!", "_", "\x00"]
    return [None, "", " ", "a" * 5000, " " * 3000, *odd, *["".join(rng.choices(odd, k=rng.randint(1, 40))) for _ in range(150)], "the word " * 3000]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


def test_counts_equal_the_library(spark, library):
    rows = list(enumerate(texts()))
    found = {r["doc_id"]: r for r in token_counts(documents(spark, [(i, t, None, None) for i, t in rows])).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((t or "").encode()), n > 1024), repr(t)[:80]


def test_whole_tokens_are_those_that_encode_alone(library):
    whole = whole_tokens(vocabulary_path())
    ranks, special = read_vocabulary(vocabulary_path())
    assert len(ranks) + len(special) == library.get_vocab_size() and len(whole) > 40_000
    for token in random.Random(1).sample(sorted(whole), 2000):
        if len(token.split()) < 2:
            assert len(library.encode(token, add_special_tokens=False).ids) == 1, token


def test_pieces_and_places(spark, library):
    rows = [*enumerate(texts()), (7, "a row of its id again"), (7, "a row of its id again"), (None, "no id")]
    found = packing_report(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        while at < len(ids):
            n = (len(ids) - at) % 1024 or 1024
            want.append((str(i), at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) == -(-sum(w[2] for w in want) // 1024) or len(sequences) <= 1.02 * sum(w[2] for w in want) / 1024 + 1


def test_bounds_and_exchange(spark, monkeypatch):
    monkeypatch.setattr("vintagebook.llm.packing.PARTITION", 4096)
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 30_000)
    bins, offsets, fills = best_fit(lengths, 1024)
    assert fills.max() <= 1024 and (np.bincount(bins, weights=lengths) == fills).all()
    assert lower_bound(lengths, 1024) <= fills.size
    assert lower_bound(np.array([600, 600, 600, 1]), 1024) >= 3 and lower_bound(np.array([400, 400, 400, 400]), 1000) >= 2
    assert lower_bound(np.array([342] * 9), 1024) > 4
    rows = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    found = packed(rows).toPandas()
    used = found.groupby("sequence_id")["length"].sum()
    assert len(found) == len(lengths) and used.max() <= 1024
    assert used.size <= fills.size + 3 and used.size >= lower_bound(lengths, 1024)


def test_empty_tables(spark):
    assert token_counts(documents(spark, [])).count() == 0
    assert packing_report(documents(spark, [])).count() == 0
