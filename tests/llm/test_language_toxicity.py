import random

import numpy as np
from tests.llm.conftest import documents

from vintagebook.llm.language import DIMENSIONS, gram_vectors, grams_of, language_report, products, prototypes
from vintagebook.llm.toxicity import Machine, fit, terms_of, toxicity_report

STEMS = {"en": ["the", "ing", "whi", "tion", "and"], "de": ["der", "ung", "sch", "keit", "und"], "fr": ["eau", "que", "éle", "tion", "les"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize()


def test_languages(spark):
    rng = random.Random(6)
    rows = [(i, speech(rng, lang, rng.choice([2, 5, 50])), lang, None) for i in range(600) for lang in [rng.choice(list(STEMS))]]
    extra = [(7000, None, "en", None), (7001, "", "en", None), (7002, "123 !?", "en", None), (7003, speech(rng, "de", 40), None, None), (None, speech(rng, "fr", 40), "fr", None), (7004, "the" * 20_000, None, None), (7005, "ü", None, None)]
    found = language_report(documents(spark, rows + extra)).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows + extra) and all(0 <= r["score"] <= 1 for r in found)
    held = [(i, lang) for i, _, lang, _ in rows if by[i]["held_out"]]
    assert len(held) > 60 and sum(by[i]["lang_pred"] == lang for i, lang in held) >= 0.95 * len(held)
    assert [by[i]["lang_pred"] for i in (7000, 7001, 7002, 7003, 7004, None)] == ["und", "und", "und", "de", "en", "fr"]
    assert by[7005]["lang_pred"] in STEMS


def test_products_are_those_of_bundled_vectors(spark):
    docs = documents(spark, [(i, speech(random.Random(i), lang, 30), lang, None) for i, lang in enumerate(["en", "de", "fr"] * 4)])
    profiles = prototypes(docs)
    table = products(spark, profiles)
    grams = grams_of("the eau der Und")
    bundle = gram_vectors(grams).sum(axis=0, dtype=np.float64)
    assert bundle.size == DIMENSIONS and np.allclose(table[grams].sum(axis=0), [bundle @ p for p in profiles.values()], atol=1e-2)


def test_nothing_to_learn(spark):
    found = language_report(documents(spark, [(1, "abc", None, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)]
    assert language_report(documents(spark, [])).count() == 0


def test_pairs_of_terms_are_learned():
    """Toxic only where an insult meets a mention: a sum of weights can't tell, products of factors can."""
    rng = random.Random(8)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(terms_of(" ".join(["insult"] * a + ["mention"] * b + rng.choices("abcdefgh", k=3))))
        labels.append(float(a and b))
    machine = fit(texts, np.array(labels))
    right = [(machine.score(" ".join(["insult"] * a + ["mention"] * b)) >= 0.5) == (a and b) for a in (0, 1) for b in (0, 1)]
    assert all(right)


def test_a_pair_of_words_that_say_nothing_alone():
    """Toxic if exactly one of two words occurs: each of them is in as many toxic texts as others."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiouxyzw"]
    made = lambda a, b: " ".join(["left"] * a + ["right"] * b + rng.choices(words, k=rng.choice([3, 12, 40])))
    cases = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(5000)]
    texts = [made(a, b) for a, b in cases]
    machine = fit([terms_of(t) for t in texts[:4000]], np.array([float(a != b) for a, b in cases[:4000]]))
    right = [(machine.score(t) >= 0.5) == (a != b) for t, (a, b) in zip(texts[4000:], cases[4000:])]
    assert sum(right) >= 0.95 * len(right)


def test_logit_is_the_sum_over_explicit_pairs():
    rng = np.random.default_rng(3)
    machine = Machine(np.array([2, 5, 9, 11, 40]), 0.3, rng.normal(size=5), rng.normal(size=(5, 4)))
    for found in ([], [5], [2, 9, 40], [1, 2, 5, 7, 9, 11, 40, 41]):
        known = [i for i, t in enumerate([2, 5, 9, 11, 40]) if t in found]
        pairs = sum(machine.factors[i] @ machine.factors[j] for i in known for j in known if i < j)
        assert np.isclose(machine.logit(machine.rows(np.array(found, np.int64))), 0.3 + machine.weights[known].sum() + pairs)


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        words = speech(rng, "en", rng.choice([3, 30, 200])).split()
        for w in rng.choices(["idiot", "scum", "trash"], k=3) if toxic else []:
            words.insert(rng.randint(0, len(words)), w)
        rows.append((i, " ".join(words), "en", None))
        labels.append((i, int(toxic)))
    extra = [(9000, None, None, None), (9001, "", None, None), (None, "you idiot scum", None, None), (5, "row of its id again", None, None)]
    table = spark.createDataFrame([*labels, (9000, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity_report(documents(spark, rows + extra), table).collect()
    assert len(found) == len(rows + extra) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    by = {r["doc_id"]: r for r in found if r["doc_id"] != 5}
    held = [(i, y) for i, y in labels if i in by and by[i]["held_out"]]
    assert sum(by[i]["predicted"] == y for i, y in held) >= 0.97 * len(held)
    assert by[9000]["score"] == by[9001]["score"] and by[9000]["predicted"] == 0 and by[None]["predicted"] == 1


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity_report(documents(spark, [(1, "a b", None, None)]), none).collect()} == {(0.0, 0)}
    assert toxicity_report(documents(spark, []), none).count() == 0
