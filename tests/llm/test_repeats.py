import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import vintagebook.llm.repeats as R
from tests.llm.conftest import documents


def brute(texts, w=200):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + w] for d in data for i in range(len(d) - w + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - w + 1):
            if times[d[i : i + w]] > 1:
                gone[i : i + w] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    out = [None, "", "short", prose(500), "a" * 3000, "ab" * 900, "a" * 199, "a" * 200, "xyz" * 67]
    for s in shared:
        for cut in (0, 1, 17, 60, 150):
            out.append(prose(rng.randint(0, 60)) + s[cut:] + prose(rng.randint(0, 60)))
            out.append(prose(30) + s[: len(s) - cut] + "!" + s[cut:])
    exact = ("é" + prose(80)).encode()[:200].decode("utf-8", "ignore")
    out += [exact + "1", "2" + exact, exact[1:] + "3" + prose(20), out[3], out[3], prose(40) + out[3][500:2500] + prose(40)]
    return out


def check(spark):
    rows = texts()
    found = {r["doc_id"]: tuple(r)[1:] for r in R.repeats_report(documents(spark, [(i, t, None, None) for i, t in enumerate(rows)])).collect()}
    assert [found[i] for i in range(len(rows))] == brute(rows)


def test_equals_brute_force(spark):
    check(spark)


def test_counting_windows_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(R, "SORTED_PHRASES", 1)
    check(spark)


def test_phrases_hold_every_window_once_and_long_texts_go_in_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    for chunk in (R.CHUNK, 1000):
        monkeypatch.setattr(R, "CHUNK", chunk)
        first, n, _, _ = R.phrases_of(data)
        assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == 9000 - 199


def test_sorting_in_many_steps_gives_the_same(spark, monkeypatch):
    rows = [(k, p, 1, bytes(d)) for k, p, d in [(1, 1, b"x" * 100 + b"y" * 120), (1, 2, b"x" * 100 + b"y" * 101), (2, 3, b"z" * 200), (3, 4, b"x" * 90 + b"y" * 110)]]
    import pandas as pd

    batches = lambda: iter([pd.DataFrame([r], columns=["key", "phrase", "copies", "bytes"]) for r in rows])
    whole = [tuple(r.phrase for r in f.itertuples() if r.runs) for f in R._sorted_runs(batches())]
    monkeypatch.setattr(R, "SORT_BYTES", 1)
    parts = [r.phrase for f in R._sorted_runs(batches()) for r in f.itertuples() if r.runs]
    assert set(parts) == {1, 2} and set(whole[0]) >= {1, 2}


def test_kept_text_and_clashing_columns(spark):
    docs = documents(spark, [(1, "é" * 150, "en", "s"), (2, "é" * 150, "en", "s"), (3, "ok", None, None)]).withColumnRenamed("key", "n_removed")
    out = {r["doc_id"]: r for r in R.without_repeats(docs, with_text=True).collect()}
    assert out[1]["kept"] == "" and out[3]["kept"] == "ok" and out[1]["n_removed"] == 300 and out[3]["source"] is None


def test_empty_table(spark):
    assert R.repeats_report(documents(spark, [])).count() == 0


def test_large_batches_are_sorted_in_parts(monkeypatch):
    sorted_bytes = []
    monkeypatch.setattr(R, "SORT_BYTES", 4000)
    ranked = R._ranked
    monkeypatch.setattr(R, "_ranked", lambda rows: sorted_bytes.append(int(rows["bytes"].map(len).sum())) or ranked(rows))
    texts = [bytes([i % 251]) * 400 for i in range(100)]
    rows = pd.DataFrame({"key": [i // 2 for i in range(100)], "phrase": range(100), "copies": 1, "bytes": texts})
    runs = {r.phrase: r.runs for f in R._sorted_runs(iter([rows])) for r in f.itertuples()}
    assert sorted(runs) == list(range(100)) and sum(sorted_bytes) == 40_000 and max(sorted_bytes) <= 8000


def test_window_ranks_order_windows():
    data = np.frombuffer(b"abcabcabcxabcabcabcaab" * 3, np.uint8)
    starts = np.arange(data.size - 20 + 1)
    windows = [data[i : i + 20].tobytes() for i in starts]
    places = {w: i for i, w in enumerate(sorted(set(windows)))}
    assert R.window_ranks(data, starts, 20).tolist() == [places[w] for w in windows]
