import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tests.llm.conftest import documents
from tokenizers import Tokenizer

from vintagebook.llm.alignment import alignment_report, aligned, split_points
from vintagebook.llm.tokens import byte_letters

ODD = ["", None, "a", " ", "  two  blanks ", "\n\n\t x", "<|endoftext|> and <s> </s> <0x41> <unk>", "a▁b", "▁", "日本語のテキスト", "é ﬁ ½ Å", "\x00\x01\x1c\x1d\x1e\x1f\x85᠎​ 　.", "\U0001f469‍\U0001f467 ok", "ÀÉ naïve", "don't we'll I'D", "x" * 5000, "1234567890" * 50, "﻿bom �"]


def tokens_of(texts):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        yield ([], [], [], []) if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole else (a, b, bytes_a, bytes_b)


def spans(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends], ends))


def brute(rows):
    made, count = [], Counter()
    for a, b, bytes_a, bytes_b in tokens_of([t for _, t in rows]):
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links = [(a[i], b[j]) for i, x in enumerate(at_a) for j, y in enumerate(at_b) if x[0] < y[1] and y[0] < x[1]]
        groups, low = [], 0
        for cut in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            parts = [",".join(str(t) for t, (_, e) in zip(ids, at) if low < e <= cut) for ids, at in ((a, at_a), (b, at_b))]
            groups.append("|".join(parts))
            low = cut
        made.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        count.update(set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted(str((i, n_a, n_b, n_g, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), h)) for (i, _), (n_a, n_b, n_g, links, h) in zip(rows, made))


def test_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["the", "of", "alignment", "Tokenisierung", "fußball", "naïve", "l'été", "123", "...", "—", "日本"]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    rows += [(None, "no id"), (5, "same row"), (5, "same row"), (-1, rows[30][1])]
    found = alignment_report(documents(spark, [(i, t, None, None) for i, t in rows]).repartition(5)).collect()
    assert sorted(str(tuple(r)) for r in found) == brute(rows)


def test_no_rows_and_no_tokens(spark):
    assert alignment_report(documents(spark, [])).count() == 0
    assert [tuple(r)[1:] for r in alignment_report(documents(spark, [(1, None, None, None), (2, "", None, None)])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


@given(st.lists(st.integers(1, 40), max_size=60), st.lists(st.integers(1, 40), max_size=60), st.integers(1, 7))
def test_pieces_of_any_size_give_one_alignment(first, second, work):
    end = max([0, *np.cumsum(first).tolist(), *np.cumsum(second).tolist()]) + 1
    a, b = (np.unique([*np.cumsum(x), end]).astype(np.int64) for x in (first, second))
    found = aligned(a, b, work)
    links = [(i, j) for i in range(a.size) for j in range(b.size) if max([0, *a][i], [0, *b][j]) < min(a[i], b[j])]
    assert list(zip(found.a.tolist(), found.b.tolist())) == links
    common = np.intersect1d(a, b)
    assert found.ends_a.tolist() == (np.searchsorted(a, common) + 1).tolist() and found.ends_b.tolist() == (np.searchsorted(b, common) + 1).tolist()


def test_diagonals_meet_the_merge():
    a, b = np.array([2, 5, 5 + 1, 9]), np.array([2, 3, 9])
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    assert split_points(a, b, np.arange(8)).tolist() == [sum(s == 0 for _, s in merged[:d]) for d in range(8)]
