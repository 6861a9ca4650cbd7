"""Who is who: agencies across spellings, measures across sources, stable ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagebook.functions import ids
from vintagebook.functions.names import canonical_portfolio
from vintagebook.functions.numbers import departmental_label, leading_outcome
from vintagebook.functions.text import phrase_key
from vintagebook.functions.years import budget_year_of, edition_order
from vintagebook.operators.lookups import distinct_union, salted_lookup, union_all
from vintagebook.session import stored


# --- agencies ------------------------------------------------------------------

def same_year_short_name(rows: DataFrame, aliases: DataFrame, agency: str = "agency", year: str = "budget_year") -> DataFrame:
    """Add ``resolved_agency``: the short name the same year's workbooks use, else the agency itself."""
    known = aliases.groupBy(
        F.col("budget_year").alias("__year"), F.lower("formal_name").alias("__name")
    ).agg(F.max_by("short_name", "id").alias("__short"))
    keyed = rows.withColumn("__year", F.col(year)).withColumn("__name", F.lower(agency))
    joined = salted_lookup(keyed, known, ["__year", "__name"])
    return joined.withColumn("resolved_agency", F.coalesce("__short", agency)).drop("__year", "__name", "__short")


def agency_spellings(agencies: DataFrame, aliases: DataFrame, canonical: bool = False) -> DataFrame:
    """Every known spelling of each distinct (agency, portfolio): exactly two hops.

    First hop: the formal names that have the agency as short name, or equal it in
    any case. Second hop: the short names of those formal names. An agency without
    a first hop keeps only its own spelling. With ``canonical`` the portfolios are
    compared in their display form.
    """
    scope = (lambda c: canonical_portfolio(F.col(c))) if canonical else F.col
    wanted = agencies.select("agency", "portfolio").distinct().withColumn("__scope", scope("portfolio"))
    names = aliases.select(scope("portfolio").alias("__scope"), "formal_name", "short_name").distinct()

    as_short = names.select("__scope", F.col("short_name").alias("__key"), "formal_name")
    as_formal = names.select("__scope", F.lower("formal_name").alias("__key"), "formal_name")
    hop_short = wanted.withColumn("__key", F.col("agency")).join(as_short, ["__scope", "__key"])
    hop_formal = wanted.withColumn("__key", F.lower("agency")).join(as_formal, ["__scope", "__key"])
    columns = ["agency", "portfolio", "__scope", "formal_name"]
    formal = distinct_union(hop_short.select(*columns), hop_formal.select(*columns))

    shorts = formal.join(names, ["__scope", "formal_name"]).select(
        "agency", "portfolio", F.col("short_name").alias("spelling")
    )
    own = wanted.select("agency", "portfolio", F.col("agency").alias("spelling"))
    return distinct_union(shorts, own)


def display_names(aliases: DataFrame) -> DataFrame:
    """(edition, agency) -> formal name, the oldest alias row of several."""
    return aliases.groupBy("edition", F.col("short_name").alias("agency")).agg(
        F.min_by("formal_name", "id").alias("formal_name")
    )


def with_display_agency(rows: DataFrame, aliases: DataFrame, out: str = "display_agency") -> DataFrame:
    joined = salted_lookup(rows, display_names(aliases), ["edition", "agency"])
    return joined.withColumn(out, F.coalesce("formal_name", "agency")).drop("formal_name")


# --- programs a measure touches ------------------------------------------------------

def program_directory(expenses: DataFrame) -> DataFrame:
    """(budget_year, agency, program_number) -> name and outcome, newest row of several."""
    rank = F.struct(edition_order(F.col("edition")), F.col("edition"), F.col("id"))
    value = F.struct("program_name", "outcome_number", "outcome_description")
    best = expenses.groupBy("budget_year", "agency", "program_number").agg(F.max_by(value, rank).alias("v"))
    return best.select("budget_year", F.col("agency").alias("spelling"), "program_number", "v.*")


def resolve_programs(
    touched: DataFrame, expenses: DataFrame, aliases: DataFrame, canonical: bool = False, named_only: bool = False
) -> DataFrame:
    """Name and outcome of every program a measure touches.

    The agency may be spelled in any known way; its own spelling is tried first,
    then the others alphabetically. Departmental lines without a match get a
    label of their own, other lines stay null. ``named_only`` keeps the matched
    lines alone and passes over matches without a name.

    Resolution runs on the distinct (year, agency, portfolio, number) keys, so a hot
    agency costs one key, not its rows; the answer is joined back with salt.
    """
    lines = touched.withColumn("budget_year", budget_year_of(F.col("edition")))
    key = ["budget_year", "agency", "portfolio", "program_number"]
    wanted = lines.select(*key).distinct()
    candidates = wanted.join(agency_spellings(wanted, aliases, canonical), ["agency", "portfolio"])
    directory = program_directory(expenses)
    if named_only:
        directory = directory.where(F.coalesce(F.col("program_name"), F.lit("")) != "")
    hits = candidates.join(directory, ["budget_year", "spelling", "program_number"])
    preference = F.struct((F.col("spelling") != F.col("agency")).cast("int"), F.col("spelling"))
    value = F.struct("program_name", "outcome_number", "outcome_description")
    answer = hits.groupBy(*key).agg(F.min_by(value, preference).alias("hit"))

    joined = salted_lookup(lines, answer, key, how="inner" if named_only else "left")
    fallback = F.col("hit").isNull() & F.col("is_departmental")
    return joined.select(
        *[F.col(c) for c in lines.columns],
        F.when(fallback, departmental_label(F.col("program_number"))).otherwise(F.col("hit.program_name")).alias("program_name"),
        F.when(fallback, leading_outcome(F.col("program_number"))).otherwise(F.col("hit.outcome_number")).alias("outcome_number"),
        F.col("hit.outcome_description").alias("outcome_description"),
    )


def program_reverse_index(touched: DataFrame, expenses: DataFrame, aliases: DataFrame) -> DataFrame:
    """(program_name, canonical portfolio) -> measure, one row per pair."""
    matched = resolve_programs(touched, expenses, aliases, named_only=True)
    return matched.select(
        "program_name", canonical_portfolio(F.col("portfolio")).alias("portfolio"), "measure_name", "edition"
    ).distinct()


def agency_portfolio(programs: DataFrame, impacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The portfolio of each agency: from its first program row, else its first impact row."""
    def ranked(part: DataFrame, source: int) -> DataFrame:
        return part.groupBy(*keys, "agency").agg(
            F.min_by("portfolio", "id").alias("portfolio")
        ).withColumn("source", F.lit(source))

    both = ranked(programs, 0).unionByName(ranked(impacts, 1))
    return both.groupBy(*keys, "agency").agg(F.min_by("portfolio", "source").alias("portfolio"))


# --- measures ---------------------------------------------------------------------------

MEASURE_KEY = ["measure_name", "edition"]


def measure_keys(*tables: DataFrame) -> DataFrame:
    """Every (measure, edition) that occurs in any of the tables."""
    return distinct_union(*[t.select(*MEASURE_KEY) for t in tables])


def related_measures(phrases: DataFrame, *named: DataFrame) -> DataFrame:
    """Phrases that name a measure, with the measure of the alphabetically latest edition."""
    parts = [t.select("measure_name", "edition", "measure_id") for t in named]
    names = distinct_union(*parts)
    rank = F.struct("edition", "measure_id", "measure_name")
    latest = names.groupBy(F.lower("measure_name").alias("__key")).agg(F.max(rank).alias("m"))
    keyed = phrases.withColumn("__key", phrase_key(F.col("phrase")))
    return salted_lookup(keyed, latest, ["__key"], how="inner").select(
        *[F.col(c) for c in phrases.columns], "m.measure_id", "m.measure_name", "m.edition"
    )


def resolve_ids(*sources: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """measure_id -> (name, edition); earlier sources win, inside a source the oldest row. ``only`` has the ids that are asked for.

    Rows are put together before anything is joined or grouped: a union of parts that were each
    shuffled by id fails where AQE changes one of them. A semi-join would be pushed into the parts.
    """
    rows = union_all([s.select("measure_id", *MEASURE_KEY, "id", F.lit(rank).alias("source")) for rank, s in enumerate(sources)])
    if only is not None:
        rows = rows.join(only.select("measure_id").distinct(), "measure_id")
    best = rows.groupBy("measure_id").agg(F.min_by(F.struct(*MEASURE_KEY, "source"), F.struct("source", "id")).alias("b"))
    return best.select("measure_id", "b.measure_name", "b.edition", "b.source")


def split_request(requested: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested ids with an answer, and those without."""
    return (
        requested.join(resolved, "measure_id"),
        requested.join(resolved, "measure_id", "left_anti"),
    )


def source_coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per edition, how many measures of ``left`` also occur in ``right``."""
    keys = left.select(*MEASURE_KEY).distinct()
    other = right.select(*MEASURE_KEY).distinct().withColumn("hit", F.lit(1))
    return keys.join(other, MEASURE_KEY, "left").groupBy("edition").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count("hit").alias("n_matched")
    )


# --- ids -----------------------------------------------------------------------------------

def _judged(proposals: DataFrame) -> DataFrame:
    """Whether each proposal loses its id: to ids that were given before, or to an earlier key proposing the same."""
    mine = F.struct("rank", *MEASURE_KEY)
    winners = proposals.groupBy("measure_id").agg(F.min(mine).alias("winner"), F.count(F.lit(1)).alias("n"))
    contested = winners.where(F.col("n") > 1).select("measure_id", "winner")
    judged = proposals.join(contested, "measure_id", "left")
    lost = F.col("taken") | (F.col("winner").isNotNull() & (F.col("winner") != mine))
    return judged.select(*MEASURE_KEY, "rank", "salt", "measure_id", lost.alias("lost"))


def assign_measure_ids(
    keys: DataFrame, order: Column | None = None, known: DataFrame | None = None, space: int = ids.ID_SPACE
) -> DataFrame:
    """One id per (measure_name, edition), collisions resolved as if keys came one at a time.

    Every key proposes its id for salt 0, 1, ...; an id goes to the earliest key that
    proposes it and everyone else moves to the next salt. Because all ids prefer earlier
    keys this converges to the same answer as going through the keys in order.
    ``known`` rows (measure_name, edition, measure_id) keep their ids.

    The first round settles all but real collisions and is stored once; later rounds
    carry only the losers and the holders they now challenge. More keys than ids raise.
    ``order`` ranks the keys (default: edition, then name).
    """
    rank = order if order is not None else F.struct("edition", "measure_name")
    fresh = keys.groupBy(*MEASURE_KEY).agg(F.min(rank).alias("rank"))
    seeds = None
    if known is not None:
        seeds = known.groupBy(*MEASURE_KEY).agg(F.max("measure_id").alias("measure_id"))
        fresh = fresh.join(seeds.select(*MEASURE_KEY), MEASURE_KEY, "left_anti")

    def proposed(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("measure_id", ids.measure_id(F.col("measure_name"), F.col("edition"), F.col("salt"), space))
        if seeds is None:
            return out.withColumn("taken", F.lit(False))
        taken = seeds.select("measure_id", F.lit(True).alias("taken")).distinct()
        return out.join(taken, "measure_id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))

    first = stored(_judged(proposed(fresh.withColumn("salt", F.lit(0)))))
    if first.count() + (seeds.count() if seeds is not None else 0) > space:
        raise ValueError(f"more keys than the {space} ids there are")
    settled, moved = first.where("not lost").drop("lost"), stored(first.where("lost"))
    while not moved.where("lost").isEmpty():
        again = proposed(moved.where("lost").select(*MEASURE_KEY, "rank", (F.col("salt") + 1).alias("salt")))
        asked = again.select("measure_id").distinct()
        calm = moved.where("not lost")
        holders = settled.join(asked, "measure_id", "left_semi").join(moved.select(*MEASURE_KEY), MEASURE_KEY, "left_anti")
        holders = holders.unionByName(calm.drop("lost").join(asked, "measure_id", "left_semi")).withColumn("taken", F.lit(False))
        rest = calm.join(asked, "measure_id", "left_anti")
        moved = stored(_judged(again.unionByName(holders)).unionByName(rest))
    kept = settled.join(moved.select(*MEASURE_KEY), MEASURE_KEY, "left_anti").unionByName(moved.drop("lost"))
    assigned = kept.select(*MEASURE_KEY, "measure_id", "salt")
    if seeds is not None:
        assigned = assigned.unionByName(seeds.select(*MEASURE_KEY, "measure_id", F.lit(0).alias("salt")))
    return assigned


def id_collisions(assigned: DataFrame) -> DataFrame:
    return assigned.agg(
        F.count(F.lit(1)).alias("n_ids"), F.sum((F.col("salt") > 0).cast("long")).alias("collisions_resolved")
    )


# --- outcome labels ----------------------------------------------------------------------------

def backfill_labels(facts: DataFrame, by: Sequence[str], number: str, description: str, label: str) -> DataFrame:
    """Where a number has exactly one stated description within ``by``, use it on all its rows.

    Numbers with several descriptions are left alone. The check runs on one row
    per (by, number): counting distinct values is combined before the shuffle.
    """
    stated = F.when(F.trim(F.coalesce(F.col(description), F.lit(""))) != "", F.col(description))
    facts_of = facts.select(*by, number, stated.alias("d")).distinct().groupBy(*by, number).agg(
        F.count("d").alias("n"), F.min("d").alias("only")
    )
    single = facts_of.where(F.col("n") == 1).select(*by, number, "only")
    joined = salted_lookup(facts, single, [*by, number])
    return joined.withColumn(label, F.coalesce("only", label)).drop("only")

