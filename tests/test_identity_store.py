import hashlib

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintagebook.operators import identity as I
from vintagebook.operators import measures as M
from vintagebook.operators import search as S
from vintagebook.operators import series as T
from vintagebook.plans import bindings
from vintagebook.plans import profiles as P
from vintagebook.sources import cells as C
from vintagebook.sources import discovery as D
from vintagebook.sources import store, versions
from vintagebook.streaming.rebuild import rebuild_stream

FACTS = "program_name string, fiscal_year string, estimate_type string, edition string, budget_year string, amount_thousands bigint, id bigint"


def brute_force_ids(keys, space, known=()):
    given = {k: i for k, i in known}
    used, out = set(given.values()), dict(given)
    for name, edition in keys:
        if (name, edition) in out:
            continue
        salt = 0
        while True:
            digest = hashlib.sha256(f"{name}\x1f{edition}\x1f{salt}".encode()).hexdigest()
            number = str(int(digest[:12], 16) % space).zfill(8)
            if number not in used:
                break
            salt += 1
        used.add(number)
        out[(name, edition)] = number
    return out


def test_ids_in_a_crowded_space_equal_one_at_a_time(spark):
    keys = sorted(((f"m{i}", f"e{i % 3}") for i in range(120)), key=lambda k: (k[1], k[0]))
    frame = spark.createDataFrame(keys, "measure_name string, edition string")
    found = {(r["measure_name"], r["edition"]): r["measure_id"] for r in I.assign_measure_ids(frame, space=150).collect()}
    assert found == brute_force_ids(keys, 150)
    assert I.id_collisions(I.assign_measure_ids(frame, space=150)).first()["collisions_resolved"] > 0


def test_known_ids_are_kept(spark):
    keys = [(f"m{i}", "e") for i in range(40)]
    keys.sort()
    known = [(("m3", "e"), "00000007"), (("gone", "e"), "00000009")]
    frame = spark.createDataFrame(keys, "measure_name string, edition string")
    seeds = spark.createDataFrame([(*k, i) for k, i in known], "measure_name string, edition string, measure_id string")
    found = {(r["measure_name"], r["edition"]): r["measure_id"] for r in I.assign_measure_ids(frame, known=seeds, space=60).collect()}
    assert found == brute_force_ids(keys, 60, known)


def test_ids_of_a_request_are_looked_up_once_over_all_sources(spark):
    schema = "measure_id string, measure_name string, edition string, id bigint"
    impacts = spark.createDataFrame([("1", "a", "e", 5), ("1", "b", "e", 4), ("9", "x", "e", 1)], schema)
    programs = spark.createDataFrame([("1", "c", "e", 1), ("2", "d", "e", 2)], schema)
    requested = spark.createDataFrame([(7, "1"), (8, "2"), (9, "3"), (10, "2")], "position bigint, measure_id string")
    found = P.requested_measures(requested, impacts, programs, impacts)
    assert sorted(tuple(r) for r in found.select("position", "measure_id", "measure_name").collect()) == [(7, "1", "b"), (8, "2", "d"), (9, "3", None), (10, "2", "d")]
    # joins inside the union are what adaptive execution fails on
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[plan.index("Union"):]


def test_write_ups_do_not_change_ids_of_facts(spark, monkeypatch):
    monkeypatch.setattr(bindings, "_BUILT", {})
    monkeypatch.setattr(bindings, "assign_measure_ids", lambda keys: I.assign_measure_ids(keys, space=8000))
    bound = bindings.Bound(spark, "/root/testdata/sf0.001")
    for rows, ids in ((bound.measure_records, bound.measure_ids), (bound.documents, bound.text_ids)):
        keys = sorted({tuple(r) for r in rows.select("measure_name", "edition").collect()}, key=lambda k: (k[1], k[0]))
        assert {(r["measure_name"], r["edition"]): r["measure_id"] for r in ids.collect()} == brute_force_ids(keys, 8000)


def test_stitched_series_prefers_actuals_then_latest_budget(spark):
    rows = [
        ("p", "2022-23", "estimated_actual", "2023-24 Budget", "2023-24", 5, 1), ("p", "2022-23", "estimated_actual", "2023-24 MYEFO", "2023-24", 6, 2),
        ("p", "2022-23", "budget", "2024-25 Budget", "2024-25", 9, 3), ("p", "2024-25", "budget", "2024-25 Budget", "2024-25", 7, 4),
        ("p", "2024-25", "forward_estimate", "2024-25 Budget", "2024-25", 8, 5), ("p", "2025-26", "forward_estimate", "2023-24 Budget", "2023-24", 1, 6),
        ("p", "2024-25", "budget", "2024-25 Budget", "2024-25", 10, 7),
    ]
    facts = spark.createDataFrame(rows, FACTS)
    found = {r["fiscal_year"]: (r["estimate_type"], r["amount_thousands"]) for r in T.stitched_series(facts, ["program_name"], "2024-25 Budget").collect()}
    assert found == {"2022-23": ("estimated_actual", 6), "2024-25": ("budget", 17)}
    early = T.stitched_series(facts, ["program_name"], "2024-25 Budget", prefer="earliest").where("fiscal_year = '2022-23'").first()
    assert early["amount_thousands"] == 5


def test_agency_chain_is_two_hops_and_scoped(spark):
    aliases = spark.createDataFrame(
        [("e1", "y1", "P", "Services Australia", "SAUS", "f", 1), ("e2", "y2", "P", "Services Australia", "SA", "f", 2), ("e3", "y3", "P", "Other Body", "SA", "f", 3),
         ("e3", "y3", "P", "Other Body", "OB", "f", 4), ("e1", "y1", "Q", "Services Australia", "XX", "f", 5)],
        "edition string, budget_year string, portfolio string, formal_name string, short_name string, source_file string, id bigint")
    wanted = spark.createDataFrame([("SAUS", "P"), ("services australia", "P"), ("Lone", "P")], "agency string, portfolio string")
    found = {}
    for r in I.agency_spellings(wanted, aliases).collect():
        found.setdefault(r["agency"], set()).add(r["spelling"])
    assert found == {"SAUS": {"SAUS", "SA"}, "services australia": {"services australia", "SAUS", "SA"}, "Lone": {"Lone"}}


def test_hot_agency_keeps_all_rows_in_lookups(spark):
    rows = spark.range(1000).select(F.lit("e").alias("edition"), F.when(F.col("id") % 3 == 0, F.lit("cold")).otherwise(F.lit("hot")).alias("agency"), "id")
    aliases = spark.createDataFrame([("e", "y", "P", "Hot Agency", "hot", "f", 1), ("e", "y", "P", "Second", "hot", "f", 2)],
                                    "edition string, budget_year string, portfolio string, formal_name string, short_name string, source_file string, id bigint")
    shown = {r["display_agency"]: r["n"] for r in I.with_display_agency(rows, aliases).groupBy("display_agency").agg(F.count("*").alias("n")).collect()}
    assert shown == {"Hot Agency": 666, "cold": 334}


def test_matrix_has_totals_and_zero_cells(spark):
    rows = spark.createDataFrame([("A", "payment", "2024-25", 5), ("B", "payment", "2025-26", 7), ("A", "receipt", "2024-25", -2)], "agency string, direction string, fiscal_year string, amount_thousands bigint")
    found = {(r["direction"], r["agency"], r["is_total"]): (r["figures"]["2024-25"], r["figures"]["2025-26"]) for r in M.impact_matrix(rows, []).collect()}
    assert found == {("payment", "A", False): (5, 0), ("payment", "B", False): (0, 7), ("payment", "Total", True): (5, 7), ("receipt", "A", False): (-2, 0), ("receipt", "Total", True): (-2, 0)}
    assert M.dominant_agency(rows, []).first()["agency"] == "B"


def test_nearest_vectors_equal_brute_force(spark):
    import numpy as np

    points = np.random.default_rng(1).normal(size=(300, 8))
    frame = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<float>").repartition(5)
    queries = [(7, list(points[7])), (9, list(points[9]))]
    found = {}
    for r in S.nearest_vectors(frame, queries, 5).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    exact = points.astype(np.float32).astype(np.float64)
    for q, vector in queries:
        order = np.argsort(((exact - vector) ** 2).sum(axis=1), kind="stable")[:5]
        assert [found[q][k] for k in range(1, 6)] == order.tolist()


ROWS = "edition string, source_file string, measure_name string, amount_thousands bigint"


def test_rebuild_touches_only_what_is_named_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    current = spark.createDataFrame([("e1", "a", "m", 1), ("e1", "b", "m", 2), ("e2", "c", "m", 3), ("e3", "d", "m", 4)], ROWS)
    versions.create_table(current, path)
    fresh = spark.createDataFrame([("e1", "a", "m", 10), ("e1", "b", "m", 20), ("e2", "c", "m", 30)], ROWS)
    files = spark.createDataFrame([("a",)], "source_file string")
    read = lambda: {(r["edition"], r["source_file"], r["amount_thousands"]) for r in versions.read_table(spark, path).collect()}
    for _ in range(2):
        versions.rebuild(spark, path, fresh, ["e2"], files)
        assert read() == {("e1", "a", 10), ("e1", "b", 2), ("e2", "c", 30), ("e3", "d", 4)}
    versions.rebuild(spark, path, fresh, ["e3"])
    assert read() == {("e1", "a", 10), ("e1", "b", 2), ("e2", "c", 30)}


def test_a_killed_rebuild_leaves_the_old_table_or_the_new(spark, tmp_path, monkeypatch):
    """Killed before, between or after any two of its steps, a rebuild shows one whole state, and the next one succeeds."""
    current = spark.createDataFrame([("e: 1", "a", "m", 1), ("e: 1", "b", "m", 2), ("e2", "c", "m", 3), ("e3", "d", "m", 4)], ROWS)
    fresh = spark.createDataFrame([("e: 1", "a", "m", 10), ("e9", "c", "m", 30)], ROWS)
    files = spark.createDataFrame([("a",), ("c",)], "source_file string")
    old = {("e: 1", "a", 1), ("e: 1", "b", 2), ("e2", "c", 3), ("e3", "d", 4)}
    new = {("e: 1", "a", 10), ("e: 1", "b", 2), ("e9", "c", 30), ("e3", "d", 4)}

    class Killed(Exception):
        pass

    seen = []
    for step in range(6):
        path = str(tmp_path / f"table{step}")
        versions.create_table(current, path)
        read = lambda: {(r["edition"], r["source_file"], r["amount_thousands"]) for r in versions.read_table(spark, path).collect()}  # noqa: B023, E731
        done = [0]

        def watched(function):
            def call(*args):
                if done[0] == step:
                    raise Killed
                done[0] += 1
                out = function(*args)
                if done[0] == step:
                    raise Killed
                done[0] += 1
                return out

            return call

        with monkeypatch.context() as patched:
            for name in ("_read", "_write_generation", "_publish"):
                patched.setattr(versions, name, watched(getattr(versions, name)))
            try:
                versions.rebuild(spark, path, fresh, (), files)
            except Killed:
                pass
        seen.append(read())
        assert seen[-1] in (old, new)
        versions.rebuild(spark, path, fresh, (), files)
        assert read() == new
        versions.drop_unused(path)
        assert read() == new
    assert seen[0] == old and seen[4] == old


def test_ids_stay_in_a_subset_rebuild(spark):
    current = spark.createDataFrame([("m", "e", "00000001"), ("n", "e", "00000002")], "measure_name string, edition string, measure_id string")
    fresh = spark.createDataFrame([("m", "e", 5), ("new", "e", 6)], "measure_name string, edition string, amount_thousands bigint")
    found = {r["measure_name"]: r["measure_id"] for r in store.with_stable_ids(fresh, current).collect()}
    assert found["m"] == "00000001" and found["new"] not in {"00000001", "00000002"}


def test_collection_reconciliation_is_idempotent(spark):
    wanted = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, document string")
    current = spark.createDataFrame([("1", "a"), ("2", "old"), ("9", "x")], "id string, document string")
    actions = store.reconcile_collection(current, wanted)
    assert {r["id"]: r["action"] for r in actions.collect()} == {"1": "keep", "2": "update", "3": "insert", "9": "delete"}
    after = store.reconciled_collection(current, wanted, actions)
    assert {tuple(r) for r in after.collect()} == {("1", "a"), ("2", "b"), ("3", "c")}
    assert {r["action"] for r in store.reconcile_collection(after, wanted).collect()} == {"keep"}


def test_arriving_files_replace_their_rows(spark, tmp_path):
    table, incoming = str(tmp_path / "table"), str(tmp_path / "in")
    versions.create_table(spark.createDataFrame([("e1", "a", "m", 1), ("e1", "b", "m", 2)], ROWS), table)
    spark.createDataFrame([("e1", "a", "m", 7), ("e2", "z", "m", 8)], ROWS).write.parquet(incoming)
    for _ in range(2):
        rebuild_stream(spark, incoming, ROWS, table, str(tmp_path / "state")).awaitTermination()
        assert {(r["edition"], r["source_file"], r["amount_thousands"]) for r in versions.read_table(spark, table).collect()} == {("e1", "a", 7), ("e1", "b", 2), ("e2", "z", 8)}


def test_workbooks_are_listed_and_damaged_ones_isolated(spark, tmp_path):
    folder = tmp_path / "2024-25 Budget" / "2024-25 PBS Health"
    folder.mkdir(parents=True)
    for name in ("Health Tables.xlsx", "~$Health.xlsx", "Bad.xls", "notes.txt"):
        (folder / name).write_bytes(b"bad" if name == "Bad.xls" else b"good")
    found = D.with_context(D.listed_workbooks(spark, str(tmp_path))).collect()
    assert {(r["edition"], r["portfolio"], r["agency"]) for r in found} == {("2024-25 Budget", "Health", "Health"), ("2024-25 Budget", "Health", "Bad")}

    def decoder(content):
        if content == b"bad":
            raise ValueError("damaged")
        yield "S", 0, 0, 0, "1", 1.0

    cells, errors = C.split_decoded(C.decoded_workbooks(spark, str(tmp_path), decoder))
    assert cells.count() == 1 and "damaged" in errors.first()["error"]


def test_crowded_ids_are_those_of_going_through_the_keys_in_order(spark):
    import hashlib

    space = 80
    keys = sorted((f"{2014 + i % 3}-15 Budget", f"Measure {i}") for i in range(70))
    known = {("Measure 3", keys[0][0]): "00000005"}
    taken, want = set(known.values()), dict(known)
    for edition, name in keys:
        salt = 0
        while (name, edition) not in want:
            digest = hashlib.sha256(f"{name}\x1f{edition}\x1f{salt}".encode()).hexdigest()
            found = f"{int(digest[:12], 16) % space:08d}"
            if found not in taken:
                want[name, edition] = found
                taken.add(found)
            salt += 1
    frame = spark.createDataFrame([(n, e) for e, n in keys], "measure_name string, edition string")
    seeds = spark.createDataFrame([(n, e, i) for (n, e), i in known.items()], "measure_name string, edition string, measure_id string")
    found = I.assign_measure_ids(frame, known=seeds, space=space).collect()
    assert {(r["measure_name"], r["edition"]): r["measure_id"] for r in found} == want
    with pytest.raises(ValueError):
        I.assign_measure_ids(frame, space=60)


def test_facts_and_lines_keep_all_rows(spark):
    from vintagebook.plans.bindings import Bound

    b = Bound(spark, "/root/testdata/sf0.001")
    facts = b.program_expenses
    assert facts.count() == b.table("lineitem").count() == facts.select("id").distinct().count()
    lines = b.table("documents").select(F.explode(F.split("text", "\n")).alias("line"))
    text = b.measure_text.agg(F.sum(F.length(F.regexp_replace("full_measure_text", "\\s", "")))).first()[0]
    kept = b.write_ups.select(F.explode("lines").alias("line"))
    assert text == kept.agg(F.sum(F.length(F.regexp_replace("line", "\\s", "")))).first()[0] and kept.count() <= lines.count()


def test_write_ups_built_from_lines(spark):
    """Of two measures of one name in an edition the first stays, with its own children; known ids are kept."""
    from vintagebook.schemas import LINES
    from vintagebook.sources.builds import build_measure_text

    def page(doc, name, text, run):
        spec = [
            ("Part 2: Payment Measures", "body", []), ("HEALTH", "portfolio", []), (name, "heading", []), ("Payments ($m)", "table", []), ("Department 1.5 nfp", "table", []),
            ("Total – Payments 1.5 nfp", "table", []), (text, "body", [(False, True, run)]), ("a part", "bullet", []), ("Last words.", "body", []),
        ]
        return [(doc, 1, i, t, s, 90.0, r) for i, (t, s, r) in enumerate(spec)]

    lines = page("d1", "Care", "First text.", "Act 1") + page("d2", "Care", "Other text.", "Act 2") + page("d3", "Care", "Text of another year.", "Act 3")
    files = spark.createDataFrame([("d1", "e1", "b.pdf"), ("d2", "e1", "a.pdf"), ("d3", "e2", "a.pdf")], "doc string, edition string, source_file string")
    known = spark.createDataFrame([("Care", "e2", "00000042")], "measure_name string, edition string, measure_id string")
    made = build_measure_text(spark.createDataFrame(lines, LINES), files, known)
    texts = {r["edition"]: r for r in made["measure_text"].collect()}
    assert len(texts) == 2 and texts["e1"]["full_measure_text"] == "Other text.\n\nLast words." and texts["e1"]["source_file"] == "a.pdf"
    assert texts["e2"]["measure_id"] == "00000042" and (texts["e1"]["portfolio"], texts["e1"]["document_section"]) == ("HEALTH", "payment")
    first = texts["e1"]["measure_id"]
    assert {(r["ordinal"], r["marker"]) for r in made["components"].collect() if r["measure_id"] == first} == {(0, "text"), (1, "dot"), (2, "text")}
    assert sorted((r["row_ordinal"], r["year_index"], r["value_raw"]) for r in made["financials"].collect() if r["measure_id"] == first) == [(0, 0, "1.5"), (0, 1, "nfp")]
    assert sorted((r["measure_id"] == first, r["phrase"]) for r in made["related"].collect()) == [(False, "Act 3"), (True, "Act 2")]


def test_one_hot_group_is_spread(spark):
    """Ranks, years, titles and lists with nine tenths of the rows in one group equal those of a plain pass."""
    from vintagebook.operators.measure_tables import resolved_titles
    from vintagebook.operators.measures import programs_by_agency
    from vintagebook.operators.ordered import ranked, with_ranges
    from vintagebook.operators.series import year_window
    from vintagebook.sources.discovery import borrowed_portfolios

    rows = [("hot" if i % 10 else f"k{i % 7}", i * 7919 % 4001, f"n{i}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "g string, v int, n string")
    places = {}
    for g, v, n in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        places[n] = places.get((g,), 0) + 1
        places[(g,)] = places[n]
    found = ranked(frame, ["g"], [F.desc("v"), "n"], "place").collect()
    assert {r["n"]: r["place"] for r in found} == {n: p for n, p in places.items() if isinstance(n, str)}
    sizes = [r["count"] for r in with_ranges(frame, ["g"], F.desc("v")).groupBy("__range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000

    points = spark.createDataFrame([(g, n, f"{2000 + v % 9}-{(1 + v) % 9:02d}", v % 3) for g, v, n in rows], "edition string, name string, fiscal_year string, amount_thousands long")
    shown = {}
    for r in year_window(points, ["edition", "name"], ["edition"], 2).collect():
        shown.setdefault((r["edition"], r["name"]), []).append(r["fiscal_year"])
    years = {g: sorted({p["fiscal_year"] for p in points.collect() if p["edition"] == g}) for g in {r[0] for r in rows}}
    for g, v, n in rows:
        at = years[g].index(f"{2000 + v % 9}-{(1 + v) % 9:02d}")
        assert sorted(shown[g, n]) == years[g][at : at + 2]

    titles = frame.withColumns({"label": F.when(F.col("v") % 3 == 0, F.concat(F.lit("- "), "n")).otherwise(F.col("n")), "starts": F.col("v") % 5 != 0, "at": F.row_number().over(Window.orderBy("n"))})
    plain, cut = (sorted(map(str, resolved_titles(titles, ["g"], "at", "label", "starts", spread=s).select("n", "title").collect())) for s in (False, True))
    assert plain == cut

    merged = frame.selectExpr("'e' AS edition", "g AS agency", "n AS program_name", "n AS program_number", "'payment' AS direction", "array('Administered') AS channels", "1L AS touched_by", "CAST(v AS string) AS portfolio")
    listed = programs_by_agency(merged, ["edition"]).collect()
    assert len(listed) == 4000 and sorted(r["place"] for r in listed if r["agency"] == "hot") == list(range(1, 3601))
    assert {r["portfolio"] for r in listed if r["agency"] == "hot"} == {min(str(v) for g, v, _ in rows if g == "hot")}

    flat = frame.selectExpr("'2015-16' AS budget_year", "g AS agency", "n")
    other = spark.createDataFrame([("2015-16", "hot", "P"), ("2014-15", "k1", "Q")], "budget_year string, agency string, portfolio string")
    assert {(r["agency"] == "hot", r["portfolio"]) for r in borrowed_portfolios(flat, other).collect()} == {(True, "P"), (False, "")}


def test_refreshed_index_equals_a_full_build(spark, tmp_path):
    """After changes of two editions the index is that of a full build; editions of other years keep their very files."""
    from vintagebook.sources.builds import build_reverse_index, refresh_reverse_index

    editions = ["2015-16 Budget", "2015-16 MYEFO", "2016-17 Budget", "2017-18 Budget"]
    touched = spark.createDataFrame(
        [(e, f"m{i}", "P", "a", "payment", "1.1", False, f"{e}/x", i) for i, e in enumerate(editions)],
        "edition string, measure_name string, portfolio string, agency string, direction string, program_number string, is_departmental boolean, source_file string, id long",
    )
    facts = "edition string, budget_year string, agency string, portfolio string, program_number string, program_name string, outcome_number int, outcome_description string, id long"
    expenses = lambda name: spark.createDataFrame([(e, e[:7], "a", "P", "1.1", name(e), 1, "o", i) for i, e in enumerate(editions)], facts)
    aliases = spark.createDataFrame([], "edition string, budget_year string, portfolio string, formal_name string, short_name string, source_file string, id long")
    root, full = str(tmp_path / "index"), str(tmp_path / "full")
    build_reverse_index(root, touched.where("edition <> '2017-18 Budget'"), expenses(lambda e: "old"), aliases)
    before = versions._newest(root)["parts"]
    after = expenses(lambda e: "new" if e == "2015-16 MYEFO" else "old")
    done = refresh_reverse_index(spark, root, touched, after, aliases, ["2015-16 MYEFO", "2017-18 Budget"])
    assert done == ["2015-16 Budget", "2015-16 MYEFO", "2017-18 Budget"]
    build_reverse_index(full, touched, after, aliases)
    rows = lambda path: sorted(map(str, versions.read_table(spark, path).select("edition", "program_name", "portfolio", "measure_name").collect()))
    assert rows(root) == rows(full) and len(rows(full)) == 4
    parts = versions._newest(root)["parts"]
    assert [e for e in parts if before.get(e) == parts[e]] == ["edition=2016-17 Budget"]


def test_workbooks_are_listed_by_tasks_at_any_depth(spark, tmp_path):
    from vintagebook.sources.discovery import listed_workbooks

    for name in ("a b/c/x 1.xlsx", "a b/y.XLS", "a b/.hidden.xlsx", "z.xlsm", "a b/c/x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    found = listed_workbooks(spark, str(tmp_path))
    assert found.inputFiles() and not any(f.endswith("xlsx") for f in found.inputFiles())
    assert sorted((r["path"].split("/")[-1], r["length"]) for r in found.collect()) == [("x 1.xlsx", 3), ("z.xlsm", 3)]


def test_workbooks_are_read_by_tasks_that_the_driver_has_no_list_of(spark, tmp_path):
    for name in ("a b/x 1.xlsx", "a b/%20y.xlsx", "z.xlsm", "a b/~$x.xlsx", "gone.xlsx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())

    def decoder(content):
        yield "S", 0, 0, 0, content.decode(), None

    decoded = C.decoded_workbooks(spark, str(tmp_path), decoder)
    (tmp_path / "gone.xlsx").unlink()
    assert not any(f.endswith(("xlsx", "xlsm")) for f in decoded.inputFiles())
    cells, errors = C.split_decoded(decoded)
    assert sorted(r["value"] for r in cells.collect()) == ["a b/%20y.xlsx", "a b/x 1.xlsx", "z.xlsm"]
    assert [r["source_file"].split("/")[-1] for r in errors.collect()] == ["gone.xlsx"]
