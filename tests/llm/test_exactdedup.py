import hashlib
import random

from tests.llm.conftest import documents

from vintagebook.llm.exactdedup import deduplicated, duplicates, exact_dedup_report, shape

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        out += [(i, keep, len(ids), n == stays, hashlib.sha256(text.encode("utf-8")).hexdigest()) for n, i in enumerate(ids)]
    return sorted(map(str, out))


def texts(n=1500):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(900)}") for i in rng.sample(range(-n, 9 * n), n)]
    rows += [(20_000 + i, "copied by a third of all") for i in range(n // 2)]
    rows += [(7, None), (8, ""), (9, None), (None, "no id"), (None, "no id"), (None, "no id, alone"), (None, "text 1"), (40_000, "same row"), (40_000, "same row"), (41_000, "x" * 300_000), (41_001, "x" * 300_000), (41_002, "é\U0001f600"), (41_003, "é\U0001f600"), (41_004, "A"), (41_005, "a"), (41_006, " a")]
    rng.shuffle(rows)
    return rows


def found(df):
    return sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in df.collect())))


def test_equals_brute_force(spark):
    rows = texts()
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    assert found(exact_dedup_report(docs)) == brute(rows)


def test_slices_bound_the_broadcast(spark):
    """With two bitmaps a slice at most, the filter is built in several rounds, with the same rows."""
    rows = texts(9000)
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    slices, buckets = shape(len(rows), 2)
    assert slices > 2 and buckets <= 2
    assert found(duplicates(docs, 2)) == brute(rows)


def test_rows_alone_are_not_shuffled(spark):
    rows = [(i, f"alone {i}") for i in range(4000)] + [(i, "copy") for i in range(5000, 5100)]
    marked = duplicates(documents(spark, [(i, t, None, None) for i, t in rows])).collect()
    assert sum(r["shuffled"] for r in marked if r["group_size"] == 1) < 200
    assert all(r["shuffled"] for r in marked if r["group_size"] > 1)


def test_rows_kept_whole(spark):
    rows = texts(300)
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    stay = {r for r in {(i, t or "") for i, t in rows} if r[0] == max((i for i, t in rows if (t or "") == r[1] and i is not None), default=None)}
    assert sorted(map(str, ((r["doc_id"], r["text"] or "") for r in kept.collect()))) == sorted(map(str, stay))


def test_native_and_empty(spark):
    docs = documents(spark, [(1, "a", None, None), (2, "a", None, None)])
    plan = exact_dedup_report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert exact_dedup_report(documents(spark, [])).count() == 0 and deduplicated(documents(spark, [])).count() == 0
