"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations only.

A text's sketch has ``ROWS`` x ``WIDTH`` cells. Every different paragraph's digest goes to
one cell of each row, where a count, an exclusive-or of digests and one of check sums
gather. Subtracting two sketches cell by cell leaves only what differs; a cell with one
digest left gives it away, which is then taken out of its other cells, and so on
(peeling). Sketches that shall tell all differences are made of as many such tables as the
counts of both texts ask for, digests dealt over them by hash. Where peeling gets stuck a
table was too small: its digests are dealt over four tables, with new hashes, and only what
did not peel is retried. All of it is done within rows, so a text's retry moves nothing.

Paragraphs end at line breaks and after full stops, question and exclamation marks; a
paragraph counts once however often it repeats. Likeness of two sketches is
1 - differing / (paragraphs of both), 1 for two empty ones.

Defined cases: a null text is an empty one; ids that are null come first in order; rows
that repeat id and text are one document in the order and give equal rows; rows of equal
ids and other texts follow each other by the md5 of the text; a table of one document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagebook.llm.common import union_all
from vintagebook.llm.repeats import tidy_shuffles
from vintagebook.session import stored

ROWS, WIDTH, STEPS, CHILDREN, LOAD = 3, 8, 6, 4, 8
PARAGRAPH_END = r"\n+|(?<=[.!?])\s+"
_EMPTY = "named_struct('n', 0, 'k', 0L, 'c', 0L)"


def paragraphs(text: Column) -> Column:
    """Digests of the different paragraphs of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH_END), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _hashed(digest: str, level: int) -> str:
    """SQL: a digest with its check sum and the cells it goes to, one in each row, as bits."""
    cells = " | ".join(f"shiftleft(1, int({row * WIDTH} + (shiftrightunsigned(h, {3 * row}) & {WIDTH - 1})))" for row in range(ROWS))
    # transform over one element names an intermediate value
    return f"named_struct('k', {digest}, 'c', xxhash64({digest}, 'check'), 'at', transform(array(xxhash64({digest}, {level})), h -> {cells})[0])"


def sketch(digests: str, level: int) -> str:
    """SQL: cells (n, k, c) of an array of digests, row by row."""
    gathered = "(s, x) -> named_struct('n', s.n + 1, 'k', s.k ^ x.k, 'c', s.c ^ x.c)"
    cells = f"transform(sequence(0, {ROWS * WIDTH - 1}), i -> aggregate(filter(hs, x -> getbit(x.at, i) = 1), {_EMPTY}, {gathered}))"
    return f"transform(array(transform({digests}, d -> {_hashed('d', level)})), hs -> {cells})[0]"


def subtracted(one: str, other: str) -> str:
    return f"zip_with({one}, {other}, (a, b) -> named_struct('n', a.n - b.n, 'k', a.k ^ b.k, 'c', a.c ^ b.c))"


def peeled(cells: str, level: int) -> str:
    """SQL: struct(cells, found), what is left of a difference and how many digests peeling gave."""
    alone = "filter(state.cells, x -> abs(x.n) = 1 AND x.c = xxhash64(x.k, 'check'))"
    pure = f"transform(array_distinct(transform({alone}, x -> named_struct('n', x.n, 'k', x.k))), x -> named_struct('n', x.n, 'x', {_hashed('x.k', level)}))"
    taken = "(s, p) -> named_struct('i', s.i, 'n', s.n - p.n, 'k', s.k ^ p.x.k, 'c', s.c ^ p.x.c)"
    some = "x -> x.n <> 0 OR x.k <> 0 OR x.c <> 0"
    rest = f"filter(transform(state.cells, x -> aggregate(filter(pure, p -> getbit(p.x.at, x.i) = 1), x, {taken})), {some})"
    # only cells with something in them are carried on, with their numbers
    cells = f"filter(transform({cells}, (x, i) -> named_struct('i', i, 'n', x.n, 'k', x.k, 'c', x.c)), {some})"
    ended = "named_struct('cells', state.cells, 'found', state.found, 'going', false)"
    went_on = f"named_struct('cells', {rest}, 'found', state.found + size(pure), 'going', true)"
    step = f"transform(array({pure}), pure -> CASE WHEN size(pure) = 0 THEN {ended} ELSE {went_on} END)[0]"
    return f"aggregate(sequence(1, {STEPS}), named_struct('cells', {cells}, 'found', 0, 'going', true), (state, t) -> CASE WHEN state.going THEN {step} ELSE state END)"


def _dealt(pairs: DataFrame, parts: str, salt: str) -> DataFrame:
    """Every pair as ``parts`` pairs (an SQL number), digests dealt over them by hash."""
    numbered = pairs.selectExpr("*", f"int({parts}) AS parts").selectExpr("*", "explode(sequence(0, parts - 1)) AS part")
    share = "CASE WHEN parts = 1 THEN {0} ELSE filter({0}, d -> pmod(xxhash64(d, '{1}'), parts) = part) END AS {0}"
    return numbered.selectExpr("no", "kind", "size", *[share.format(c, salt) for c in ("one", "other")])


def differing(pairs: DataFrame) -> DataFrame:
    """(no, kind, differing) from pairs (no, kind, one, other) of digest arrays: how many digests are in one of them only.

    No more can differ than both have, so sketches first are that large: a pair has one of
    the small tables for about ``LOAD`` of its digests.
    """
    counted, level = [], 0
    sized = pairs.selectExpr("no", "kind", f"greatest(1, ceil((size(one) + size(other)) / {LOAD})) AS size", "one", "other")
    rest = _dealt(_dealt(sized, "ceil(size / 16)", "group"), "ceil(size / ceil(size / 16))", "table")
    while True:
        state = F.expr(peeled(subtracted(sketch("one", level), sketch("other", level)), level))
        done = rest.select("no", "kind", "size", "one", "other", state.alias("state"))
        done = done.selectExpr("no", "kind", "size", "one", "other", "state.found AS found", "size(state.cells) = 0 AS whole")
        # of what peeled only the number is kept
        kept = ["no", "kind", "size", "found", "whole", *[F.when(~F.col("whole"), F.col(c)).alias(c) for c in ("one", "other")]]
        done = stored(done.select(kept))
        counted.append(done.where("whole").select("no", "kind", "found"))
        stuck = done.where("not whole").select("no", "kind", "size", "one", "other")
        if stuck.isEmpty():
            break
        level += 1
        rest = _dealt(stuck, str(CHILDREN), f"retry {level}")
    return union_all(counted).groupBy("no", "kind").agg(F.sum("found").alias("differing"))


def written_out(cells: str) -> str:
    """SQL: a sketch as text, the count and digests of every cell in hexadecimal digits."""
    return f"array_join(transform({cells}, x -> concat(lower(hex(x.n)), '.', lower(hex(x.k)))), '-')"


def succession(docs: DataFrame) -> DataFrame:
    """(no, key, doc_id, n_chars, copies, next_no, next_key): every document and the one after it by id, the first after the last."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.md5(text.cast("binary")).alias("hash"), F.char_length(text).cast("long").alias("n_chars"))
    once = own.groupBy("doc_id", "hash", "n_chars").agg(F.count("*").alias("copies"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = once.repartitionByRange(parts, "doc_id", "hash").withColumn("part", F.spark_partition_id()).withColumn("no", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("key", _key(F.col("doc_id"), F.col("hash"))))
    after = F.lead(F.struct("no", "key")).over(Window.partitionBy("part").orderBy("doc_id", "hash"))
    # one row per range from here: no more than there are partitions
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "hash", "no", "key")).alias("first"))
    ranges = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(ranges), F.first("first").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("first"))
    chain = ranged.withColumn("after", after).join(firsts, "part").withColumn("after", F.coalesce("after", F.struct(F.col("first.no").alias("no"), F.col("first.key").alias("key"))))
    return stored(chain.select("no", "key", "doc_id", "n_chars", "copies", F.col("after.no").alias("next_no"), F.col("after.key").alias("next_key")))


def _key(doc_id: Column, text_hash: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), text_hash)


def edited(docs: DataFrame, chain: DataFrame) -> DataFrame:
    """(no, text, edited_text): the second half of every text replaced by as much of the next one's beginning."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(_key(F.col("doc_id"), F.md5(text.cast("binary"))).alias("key"), text.alias("text")).dropDuplicates(["key"])
    half = F.floor(F.col("n_chars") / 2)
    taken = chain.select(F.col("key").alias("taker"), F.col("next_key").alias("key"), half.cast("int").alias("half")).join(texts, "key")
    taken = taken.select(F.col("taker").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("taken"))
    # both joins are by key, so texts stay where the first has brought them
    whole = chain.select("no", "key", (F.col("n_chars") - half).cast("int").alias("keep")).join(texts, "key").join(taken, "key")
    return whole.select("no", "text", F.concat(F.substring(F.col("text"), F.lit(1), F.col("keep")), "taken").alias("edited_text"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row."""
    tidy_shuffles(docs.sparkSession)
    chain = succession(docs)
    versions = edited(docs, chain).select(
        "no", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited_text")).alias("changed"))
    versions = stored(versions)
    following = chain.select("no", F.col("next_no")).join(versions.select(F.col("no").alias("next_no"), F.col("own").alias("following")), "next_no").select("no", "following")
    near = versions.select("no", F.lit("edited").alias("kind"), F.col("own").alias("one"), F.col("changed").alias("other"))
    near = near.unionByName(versions.join(following, "no").select("no", F.lit("next").alias("kind"), F.col("own").alias("one"), F.col("following").alias("other")))
    found = differing(near).groupBy("no").agg(F.sum(F.when(F.col("kind") == "edited", F.col("differing"))).alias("d_edited"), F.sum(F.when(F.col("kind") == "next", F.col("differing"))).alias("d_next"))

    def likeness(d: str, one: Column, other: Column) -> Column:
        both = one + other
        return F.when(both == 0, 1.0).otherwise(1 - F.col(d) / both)

    sizes = chain.select("no", "doc_id", "n_chars", "copies").join(versions, "no").join(following.select("no", F.size("following").alias("n_following")), "no").join(found, "no")
    out = sizes.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(written_out(sketch("own", 0))).alias("fingerprint"), F.expr(written_out(sketch("changed", 0))).alias("edited_fingerprint"),
        likeness("d_edited", F.size("own"), F.size("changed")).alias("near_edited"), likeness("d_next", F.size("own"), F.col("n_following")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("one of the copies"))
    return out.drop("one of the copies")
