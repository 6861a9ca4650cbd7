import random
import re

import numpy as np
import xxhash
from tests.llm.conftest import documents

from vintagebook.llm.simhash import links, merged, near_duplicates


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            low[g] = min(low.get(g, doc_id), doc_id)
    return sorted((str(d), f"{p:016x}", str(low.get(g))) for (d, _), p, g in zip(rows, prints, group))


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 8, 300]))) for _ in range(60)]
    texts = base + [" ".join([*t.split(), "Tail"]) for t in base for _ in range(2)] + base[:20] + [None, "", "   ", "ÉTÉ a b c d", "a" * 50_000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, base[5]), (3, "same id"), (3, "same id")]
    found = near_duplicates(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == brute(rows)


def test_links_of_dense_fingerprints_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    center = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    prints = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for c in center for k in (0, 1, 2, 2, 3, 4, 4)} | {0, -1, -2, 1})
    found = links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    at = {p: i for i, p in enumerate(prints)}
    edges = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2]
    want = merged(np.arange(len(prints)), *np.array(edges).T)
    got = merged(np.arange(len(prints)), np.array([at[r["a"]] for r in found]), np.array([at[r["b"]] for r in found]))
    assert (want == got).all()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 64 for r in found)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
