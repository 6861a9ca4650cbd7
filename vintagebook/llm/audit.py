"""How filters interact: what each removes, in any order, and what it removes alone.

A row's failures are bits of a mask, so that rows become counts per part and mask. The
states of a run are the subsets of filters applied so far; an edge applies one more. Paths
are counted forward (orders that reach a state) and backward (orders that leave it); their
product is the number of orders that take an edge, by which its removals are weighed into
the filter's Shapley sum. The steps of any one order are read from the same edges.

Defined cases: a null text is empty and a null source is the part ''; a null doc_id has no
smaller one and is none; a text repeated under one id is not a copy by itself; several
labels of one id count as one that has every mark among them; texts of any length are read
whole; no rows give no parts; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagebook.llm.common import looked_up
from vintagebook.llm.exactdedup import text_digest
from vintagebook.session import stored

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_BLANKS = "\t\n\x0b\x0c\r"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that see one text only."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT,
        "C": capitals * 100 > F.char_length(text) * MOST_CAPITALS,
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask(failures: Sequence[Column]) -> Column:
    """Bit i is set where the i-th condition holds."""
    bits = [F.when(failure, F.lit(1 << i)).otherwise(F.lit(0)) for i, failure in enumerate(failures)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """(orders reaching, orders leaving) every subset of n filters, by summing over the edges of the lattice."""
    forward, backward = [1] + [0] * ((1 << n) - 1), [0] * ((1 << n) - 1) + [1]
    for state in range(1, 1 << n):
        forward[state] = sum(forward[state ^ (1 << f)] for f in range(n) if state >> f & 1)
    for state in range((1 << n) - 2, -1, -1):
        backward[state] = sum(backward[state | (1 << f)] for f in range(n) if not state >> f & 1)
    return forward, backward


def edges(n: int) -> list[tuple[int, int, int]]:
    """(state, bit of the filter applied to it, number of orders that do so)."""
    forward, backward = path_counts(n)
    return [(s, 1 << f, forward[s] * backward[s | 1 << f]) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def edge_counts(counted: DataFrame, n: int) -> DataFrame:
    """Per part and edge what happens to the rows; ``counted`` has (part, mask, rows, good, toxic)."""
    every = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("bit"), F.lit(w).cast("long").alias("orders")) for s, f, w in edges(n)])
    spread = counted.withColumn("edge", F.explode(every)).select("part", "mask", "rows", "good", "toxic", "edge.*")
    seen, fails = F.col("mask").bitwiseAND(F.col("state")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0

    def sums(condition: Column, what: str = "rows") -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(F.lit(0).cast("long")))

    summed = spread.groupBy("part", "state", "bit", "orders").agg(
        sums(~seen & ~fails).alias("kept"), sums(~seen & fails).alias("removed"), sums(seen & fails).alias("redundant"),
        sums(F.col("mask") == F.col("bit")).alias("unique_fails"),
        sums(~seen & fails, "good").alias("good_lost"), sums(~seen & fails, "toxic").alias("toxic_lost"),
    )
    shares = summed.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return summed.join(shares, ["part", "bit"])


def order_steps(on: DataFrame, names: Sequence[str]) -> DataFrame:
    """(filter_order, step, state, bit) of all orders; a table of fixed size."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[g] for g in order), step, state, 1 << f))
            state |= 1 << f
    return on.sparkSession.createDataFrame(rows, "filter_order string, step int, state int, bit int")


def interactions(masked: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """All steps of all orders per part, from rows (part, mask, good, toxic) with good and toxic 0 or 1."""
    counted = masked.groupBy("part", "mask").agg(F.count("*").alias("rows"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    known = stored(edge_counts(counted, len(names)))
    out = known.join(F.broadcast(order_steps(masked, names)), ["state", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def marked_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row per labelled id."""
    marks = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    return labels.where("doc_id is not null").groupBy("doc_id").agg(*marks)


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) per row of ``docs``."""
    own = mask(list(text_failures(F.col("text")).values()))
    rows = stored(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), own.alias("own"), text_digest(F.col("text")).alias("sha")))
    found = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("copies"))
    copied = stored(found.where("first < last").drop("last"))
    grouped = looked_up(rows, copied, "sha", "copies", rows.count())
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    placed = grouped.select("doc_id", "part", F.when(copy, F.col("own").bitwiseOR(1 << FILTERS.index("E"))).otherwise(F.col("own")).alias("mask"))
    joined = placed.join(marked_labels(labels), "doc_id", "left")
    none = F.lit(0).cast("long")
    return joined.select("part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def audit_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(failure_masks(docs, labels))
