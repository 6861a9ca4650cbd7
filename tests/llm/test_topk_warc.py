import gzip
import hashlib
import random
import uuid
from pathlib import Path

import numpy as np
import pytest
import vintagebook.llm.topk as T
from pyspark.sql import functions as F

from vintagebook.llm.warc import archive_report, parsed, read_archives, records_in, write_archives


def brute(rows, k=20):
    known = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in known:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in known if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cell int, rows string")


@pytest.mark.parametrize("block", [T.BLOCK, 64])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rng = np.random.default_rng(3)
    center = rng.normal(0, 1, (6, 16))
    rows = [(i, (center[i % 6] * (i % 5 > 0) + rng.normal(0, 0.2, 16)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(i, rows[40][1]) for i in range(900, 1100)]
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 16), (2060, [float("inf")] * 16), (None, [0.5] * 16), (2080, []), (2100, [0.25, -0.5]), (2120, [900.0] * 16)]
    found = T.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert sorted(map(tuple, T.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect())) == brute(rows)
    assert T.top_k(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, payload int")


def page_rows():
    rng = random.Random(1)
    bodies = ["<p>" + "".join(rng.choices("abc é", k=rng.choice([10, 99, 100, 500]))) + "</p>" for _ in range(30)]
    rows = [(i, f"http://a.example/{i}\r\nX: 1", rng.choice(bodies)) for i in range(200)]
    return rows + [(500, None, None), (501, "u", ""), (502, None, "z" * 300_000), (503, None, "z" * 300_000), (504, "u", "HTTP/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9), (None, "u", "no id " * 40), (505, "v", "no id " * 40)]


def want(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        refers = first.get(h) if len(h) >= 100 and first.get(h) != i else None
        out.append((str(i), len(h), hashlib.sha256(h).hexdigest(), "response" if refers is None else "revisit", str(refers)))
    return sorted(out)


def test_round_trip(spark):
    rows = page_rows()
    found = archive_report(pages(spark, rows)).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in found) == want(rows)


def test_archives_are_whole_rolled_ordered_and_the_same_again(spark, tmp_path):
    rows = page_rows()
    folders = [f"file://{tmp_path}/{uuid.uuid4().hex}" for _ in range(2)]
    made = [write_archives(pages(spark, rows).repartition(n), f, roll=4000).orderBy("file").collect() for n, f in zip((1, 5), folders)]
    assert [tuple(r)[1:] for r in made[0]] == [tuple(r)[1:] for r in made[1]] and sum(r["records"] for r in made[0]) == len(rows) and len(made[0]) > 4
    ids = []
    for r in made[0]:
        path = Path(folders[0].removeprefix("file://")) / r["file"]
        data = path.read_bytes()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        ids += [parsed(x)["page_id"] for x in records_in(iter([data[:100], data[100:]]))]
    assert [int(i or -1) for i in ids] == sorted(int(i or -1) for i in ids)
    back = read_archives(spark, folders[0]).where("record_type = 'response'").collect()
    assert {(r["page_id"], bytes(r["payload"])) for r in back} <= {(i, (h or "").encode()) for i, _, h in rows}
    with pytest.raises(ValueError):
        list(records_in(iter([data[:-20]])))


def test_empty_tables(spark):
    assert archive_report(pages(spark, [])).count() == 0
