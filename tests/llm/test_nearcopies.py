import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.conftest import documents

from vintagebook.llm.nearcopies import _chosen_sets, near_copies, row_key, without_near_copies


def units(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets, group = [units(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            low[g] = min(low.get(g, doc_id), doc_id)
    return sorted((str(d), str(low.get(g))) for (d, _), g in zip(rows, group))


def found(df):
    return sorted((str(r["doc_id"]), str(r["component_id"])) for r in df.collect())


def edited(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.random()}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    """Copies around the bound, and chains of them whose ends are far apart."""
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 200, 600]))]
        texts += [" ".join(words)] + [edited(words, len(words) // k, rng) for k in (25, 35, 45, 60, 100)]
    chain = [f"c{i}" for i in range(200)]
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(chain, 3, rng).split()
    texts += [None, "", "  ", "a b c", "A  B c", "a b d"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, "same id"), (3, "same id")]
    assert found(near_copies(documents(spark, [(i, t, None, None) for i, t in rows]))) == brute(rows)


def test_groups_without_a_centre_and_buckets_of_texts_that_are_not_near(spark):
    """Texts that share a long passage, or most of one, meet in many buckets; only some are near."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(150)]
    texts = [" ".join(passage + [f"{k}x{i}" for i in range(rng.choice([20, 30, 40, 60, 90]))]) for k in range(120)]
    texts += [edited(passage, n, rng) for n in (1, 2, 3, 4, 5, 6, 7, 8) for _ in range(12)]
    ring = [f"r{i}" for i in range(400)]
    texts += [" ".join((ring * 2)[i : i + 200]) for i in range(0, 400, 10)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert found(near_copies(documents(spark, [(i, t, None, None) for i, t in rows]))) == brute(rows)


def test_rows_of_one_id(spark):
    """Different texts under one id are different documents; of a group the smallest id stays, of one id the smallest key."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(0, a), (1, a), (1, b), (2, c), (2, d), (2, d), (None, d), (None, "alone"), (None, "alone"), (None, None), (3, "")]
    kept = without_near_copies(documents(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted([("0", a), ("1", b), ("2", c), ("2", d), ("None", "alone"), ("3", "")])


def test_stage_drops_copies_of_similarity_of_four_fifths(spark):
    words = [f"w{i}" for i in range(200)]
    copy = " ".join([*words[:100], "edit", *words[101:150], "edit", *words[151:]])
    rows = [(1, " ".join(words), "en", "s"), (2, copy, "en", "s"), (3, "another text of several words", "en", "s")]
    kept = P.drop_near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_empty_table(spark):
    assert near_copies(documents(spark, [])).count() == 0 and without_near_copies(documents(spark, [])).count() == 0


def test_pairs_linked_by_fingerprints_go_on_without_a_shared_band(spark):
    docs = documents(spark, [(i, f"a b c d e {i}", None, None) for i in range(4)])
    nodes = docs.select(F.col("doc_id").alias("s"), F.array("doc_id").alias("keys"), F.struct(row_key(F.col("doc_id"), F.col("text")).alias("k")).alias("low"))
    linked = spark.createDataFrame([(1, 2)], "a long, b long")
    assert sorted(r["s"] for r in _chosen_sets(docs, nodes, linked).collect()) == [1, 2]
