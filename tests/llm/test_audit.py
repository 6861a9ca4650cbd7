import re
from collections import Counter
from itertools import permutations
from math import factorial

from tests.llm.conftest import documents

from vintagebook.llm.audit import audit_report, edges, interactions, path_counts


def fails(rows, i):
    doc_id, text, _ = rows[i]
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return set(out + "E" * (doc_id is not None and any((t or "") == text and d is not None and d < doc_id for d, t, _ in rows)))


def brute(rows, labels):
    failing = [fails(rows, i) for i in range(len(rows))]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {s or "" for *_, s in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failing[i]]
                shapley[f] += len(gone)
                left = [i for i in left if f not in failing[i]]
                redundant = sum(f in failing[i] and bool(failing[i] & set(order[: step - 1])) for i in own)
                alone = sum(failing[i] == {f} for i in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def sample():
    long = " ".join(f"w{i}" for i in range(60))
    few = " ".join(["one two three"] * 30)
    texts = [long, few, long.upper(), long + " #", "short", "SHORT $", "", None, few.upper() + " %", "a\tb\nc\x0bd\x0ce\rf\x1cg", "é" * 10 + "\xa0" + "A", "x " * 5000]
    rows = [(i, t, s) for i, t in enumerate(texts) for s in [("s", None, "", "t")[i % 4]]]
    rows += [(100 + i, t, "u" if i % 3 else None) for i, t in enumerate(texts * 2)]
    return rows + [(None, long, "s"), (None, "short", None), (0, long, "s"), (300, "same id", "s"), (300, "same id", "s"), (-5, "short", "only")]


LABELS = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (2, 0, 0), (4, 1, None), (None, 1, 1), (101, None, 1), (105, 1, 1), (9999, 1, 1)]


def test_equals_every_order_run(spark):
    rows = sample()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = audit_report(documents(spark, [(i, t, None, s) for i, t, s in rows]), labels).collect()
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in found} == brute(rows, LABELS)
    assert len(found) == 600 * len({s or "" for *_, s in rows})


def test_paths():
    for n in (1, 3, 6):
        forward, backward = path_counts(n)
        assert forward[-1] == backward[0] == factorial(n)
        assert all(f * b == factorial(s.bit_count()) * factorial(n - s.bit_count()) for s, (f, b) in enumerate(zip(forward, backward)))
        assert sum(w for _, f, w in edges(n) if f == 1) == factorial(n)


def test_other_filters_and_empty_tables(spark):
    masked = spark.createDataFrame([("p", 3, 1, 0), ("p", 1, 0, 1), ("p", 0, 1, 0)], "part string, mask int, good long, toxic long")
    steps = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in interactions(masked, "XY").collect()}
    assert steps == {("XY", 1): (1, 2, 3), ("XY", 2): (1, 0, 1), ("YX", 1): (2, 1, 1), ("YX", 2): (1, 1, 3)}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_report(documents(spark, []), none).count() == 0
    assert audit_report(documents(spark, [(1, "a", None, "s")]), none).count() == 600
