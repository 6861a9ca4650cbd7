import hashlib

import regex

from pyspark.sql import functions as F
from tests.llm.conftest import documents

from vintagebook.llm.fingerprints import differing, fingerprint_report, succession


def units(text):
    return {p for p in regex.split(r"\n+|(?<=[.!?])[ \t\n\x0b\f\r]+", text) if p}


def likeness(a, b):
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def brute(rows):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out[doc_id, text] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(units(text), units(edited)), likeness(units(text), units(after)))
    return sorted((str(d), *(round(x, 9) if isinstance(x, float) else x for x in out[d, t or ""])) for d, t in rows)


def texts():
    many = [f"Sentence {i} of it. A longer sentence, number {i % 7} of a few. Another {i % 7}!\nLine {i} \U0001f600é" for i in range(120)]
    same = "One. Two. Three.\nFour? Five!\n\nSix"
    return [(10, None), (11, ""), (3, same), (4, same), (900, " ".join(many)), (901, " ".join(many[::-1])), (902, "x" * 9999), (5, "A. A. A. B."), (5, "other text"), (6, same), (6, same), (None, "no id."), (-7, "é\U0001f600")]


def test_equals_brute_force(spark):
    rows = texts()
    found = fingerprint_report(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found) == brute(rows)
    prints = {}
    for r in found:
        prints.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(prints[len("One. Two. Three.\nFour? Five!\n\nSix")]) == 1


def test_peeling_counts_every_difference(spark):
    sets = [(0, 0), (1, 0), (0, 1), (5, 5), (12, 0), (40, 40), (300, 7), (2000, 2000)]
    rows = spark.createDataFrame([(i, "x", list(range(a)), list(range(a // 2, a // 2 + b))) for i, (a, b) in enumerate(sets)], "no long, kind string, one array<long>, other array<long>")
    hashed = rows.select("no", "kind", *[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in ("one", "other")])
    found = {r["no"]: r["differing"] for r in differing(hashed).collect()}
    assert found == {i: len(set(range(a)) ^ set(range(a // 2, a // 2 + b))) for i, (a, b) in enumerate(sets)}


def test_one_document_and_none(spark):
    only = fingerprint_report(documents(spark, [(1, "ab. cd.", None, None)])).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0
    assert succession(documents(spark, [])).count() == 0 and fingerprint_report(documents(spark, [])).count() == 0
