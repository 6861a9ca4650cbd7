"""Token counts under a byte-level BPE vocabulary, with a shortcut for whole tokens.

Proved once per vocabulary: which of its strings the merges rebuild as that one
token. A pre-token equal to such a string counts one, without merging; only the
others are merged, and a worker remembers what it merged.

Defined cases: a null text counts as empty; the special token's string inside a
text counts one, as the library's default has it; repeated rows stay.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagebook.llm.common import bounded_batches

LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: how byte-level BPE cuts text into pre-tokens. Other blanks than these are no white space to it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANK = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = regex.compile(PATTERN.replace(r"[^\s", f"[^{_BLANK}").replace(r"\s", f"[{_BLANK}]").replace(r"\S", f"[^{_BLANK}]"))
#: Pre-tokens a worker remembers.
REMEMBERED = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, the rest counted up from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes -> id, special string -> id) of a vocabulary file; ids are in the order of the merges."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
    return ranks, special


def encoder(ranks: dict[bytes, int], special: dict[str, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def merges_to_one(token: bytes, ranks: dict[bytes, int]) -> bool:
    """Whether merging the token's bytes, lowest rank first, ends in the token itself."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1))
        if rank == 1 << 31:
            return False
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0] in ranks


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token. Tokens that are no UTF-8 cannot equal a pre-token."""
    ranks, _ = read_vocabulary(path)
    proved = set()
    for token in ranks:
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if merges_to_one(token, ranks):
            proved.add(text)
    return frozenset(proved)


class Counter:
    """Counts tokens of texts; lives in a worker for as long as the worker does."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int], whole: frozenset[str]):
        self.merge = encoder(ranks, special).encode_ordinary
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _plain(self, text: str) -> int:
        pieces = PRE_TOKEN.findall(text)
        counts = list(map(self.known.get, pieces))
        total = 0
        if None in counts:
            for piece, count in zip(pieces, counts):
                if count is None and (count := self.known.get(piece)) is None:
                    count = self.known[piece] = len(self.merge(piece))
                total += count
            if len(self.known) > len(self.whole) + REMEMBERED:
                self.known = dict(self.whole)
            return total
        return sum(counts)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row, over the whole text."""
    path = path or vocabulary_path()
    # the vocabulary's size is the file's, not the corpus'
    shared = docs.sparkSession.sparkContext.broadcast((*read_vocabulary(path), whole_tokens(path)))

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(*shared.value)
        return pd.Series([_COUNTERS[path].count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    out = bounded_batches(docs).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
