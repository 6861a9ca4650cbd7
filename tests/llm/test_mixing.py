import random

from tests.llm.conftest import documents

from vintagebook.llm.mixing import mix_report, mixed, source_targets


def targets(sizes):
    """Repeated resharing, as the words of the rule have it."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_targets_equal_resharing(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 100, 1000, 5000]) for i in range(rng.randint(1, 9))} | {None: 77}
        found = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = targets(sizes)
        assert all(abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["rate"] <= 2 for r in found) and len(found) == len(sizes)


def test_report(spark):
    rng = random.Random(4)
    rows = [(i, " \t".join(["w"] * rng.randint(0, 30)), None, rng.choice(["a", "é", "b", None, "c"])) for i in range(3000)] + [(1, None, None, "a"), (None, "x y", None, "a"), (None, "x y", None, "a")]
    docs = documents(spark, rows)
    found = mix_report(docs).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    assert len(found) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in found)
    assert {round(r["target"], 6) for r in found} == {round(t, 6) for t in want.values()}
    assert len({r["source_size"] for r in found}) == len(want)
    for size, target in {(r["source_size"], r["target"]) for r in found}:
        own = [r for r in found if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - target) < 0.06 * target + 60
    assert sorted(map(str, found)) == sorted(map(str, mix_report(docs.repartition(3)).collect()))
    copies = mixed(docs)
    assert copies.columns == docs.columns and sum(len((r["text"] or "").split()) for r in copies.collect()) == sum(r["taken"] for r in found)


def test_empty_table(spark):
    assert mix_report(documents(spark, [])).count() == 0
