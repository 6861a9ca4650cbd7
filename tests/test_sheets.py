"""Program and measure sheets written by hand, with the irregularities publications have."""

from vintagebook.operators import measure_tables as MT
from vintagebook.operators import program_tables as PT
from vintagebook.operators.measures import conflicting_duplicates, first_of_duplicates
from vintagebook.schemas import CELLS

HEAD = [["", "2023-24 Estimated actual", "2024-25 Budget", "2025-26 Forward estimate"]]


def grid(spark, sheets, file="b/Health/Health.xlsx"):
    rows = []
    for index, (name, lines) in enumerate(sheets.items()):
        for r, line in enumerate(lines):
            for c, value in enumerate(line):
                if value not in ("", None):
                    number = float(value) if isinstance(value, (int, float)) else None
                    rows.append((file, name, index, r, c, str(value), number))
    return spark.createDataFrame(rows, CELLS)


def records(spark, sheets):
    found = PT.program_records(grid(spark, sheets)).collect()
    return sorted((r["outcome_number"], r["program_number"], r["program_name"], r["fiscal_year"], r["estimate_type"], r["amount_thousands"]) for r in found)


def test_sheets_with_one_header_share_its_block_and_are_read_from_one_row_each(spark):
    first = [["Budgeted expenses for Outcome 1"], *HEAD, *[[]] * 8, ["Program 1.1: A"], ["Total program expenses", 1, 2, 3]]
    second = [["Budgeted expenses for Outcome 2"], *HEAD, *[[]] * 8, ["Program 2.1: B"], ["Total program expenses", 4, 5, 6]]
    sheets = PT.gathered(grid(spark, {"S": first, "T": second}))
    assert sheets.count() == 2
    assert PT.header_blocks(sheets).select("block_key").distinct().count() == 1
    found = PT.program_records(sheets).collect()
    assert sorted((r["sheet_name"], r["amount_thousands"]) for r in found) == [("S", 1), ("S", 2), ("S", 3), ("T", 4), ("T", 5), ("T", 6)]


def test_figures_right_below_a_header_are_no_part_of_its_block(spark):
    first = [["Budgeted expenses for Outcome 1"], *HEAD, ["Program 1.1: A"], ["Total program expenses", "1,000", "nfp", "3"]]
    second = [["Budgeted expenses for Outcome 2"], *HEAD, ["Program 2.1: B"], ["Total program expenses", "4", "5,000", "(6)"]]
    sheets = PT.gathered(grid(spark, {"S": first, "T": second}))
    assert PT.header_blocks(sheets).select("block_key").distinct().count() == 1
    found = PT.program_records(sheets).collect()
    assert sorted((r["sheet_name"], r["fiscal_year"], r["amount_thousands"]) for r in found) == [
        ("S", "2023-24", 1000), ("S", "2025-26", 3), ("T", "2023-24", 4), ("T", "2024-25", 5000), ("T", "2025-26", -6),
    ]


def test_total_rows_are_found_without_moving_a_row(spark):
    sheet = [["Budgeted expenses for Outcome 1"], *HEAD, ["Total program expenses", 9, 9, 9], ["Program 1.1: A"], ["Total program expenses", 1, 2, 3],
             ["Program 1.2: B"], ["Total for program 1.9", 4, 5, 6], ["Outcome 1 Totals by appropriation type"], ["Program 1.3: C"], ["Total program expenses", 7, 7, 7]]
    closed = PT.closed_programs(PT.row_events(PT.sheet_outcomes(PT.sheet_readings(grid(spark, {"S": sheet})).localCheckpoint())))
    assert sorted(tuple(r)[2:] for r in PT.program_of_row(closed).collect()) == [(4, "1.1"), (6, "1.2")]
    events = PT.row_events(PT.sheet_outcomes(PT.sheet_readings(grid(spark, {"S": sheet})).localCheckpoint()))
    plan = PT.program_of_row(PT.closed_programs(events.localCheckpoint()))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_measure_rows_are_read_alike_from_cells_and_from_rows_with_their_cells(spark):
    sheet = [["Table 1.2: Measures"], ["Program", "", "", "2023-24 $'000", "2024-25 $'000"], ["Payment measures"], ["Name"], ["Administered payments", 1.1, "", 5, "nfp"]]
    cells = grid(spark, {"Table 1.2": sheet})
    rows = MT.gathered_rows(cells)
    assert rows.count() == 5
    found = [sorted(map(str, MT.measure_records(table).collect())) for table in (cells, rows)]
    assert len(found[0]) == 1 and found[0] == found[1]


def test_header_on_three_rows_and_total_with_wrong_number(spark):
    sheet = [
        ["Budgeted expenses for Outcome 2"], ["Outcome 2: Better health"],
        ["", "2023-24", "2024-25"], ["", "Estimated", "Budget"], ["", "actual"],
        ["Program 2.6: Hospitals (a)"], ["Total for program 2.5", "1,000", "(20)"],
    ]
    assert records(spark, {"S": sheet}) == [
        (2, "2.6", "Hospitals", "2023-24", "estimated_actual", 1000), (2, "2.6", "Hospitals", "2024-25", "budget", -20),
    ]


def test_mistyped_year_is_repaired_by_position(spark):
    sheet = [["Budgeted expenses for Outcome 1"], ["", "2023-24 Estimated actual", "2024-25 Budget", "2025-25 Forward estimate"], ["Program 1.1 – Name"], ["Total program expenses", 1, 2, 3]]
    assert [(r[3], r[5]) for r in records(spark, {"S": sheet})] == [("2023-24", 1), ("2024-25", 2), ("2025-26", 3)]


def test_copied_title_is_outvoted(spark):
    sheet = [["Budgeted expenses for Outcome 1"], ["Outcome 3: Other"], *HEAD, ["Program 3.1: Name"], ["Total program expenses", 5, 6, 7]]
    assert {r[0] for r in records(spark, {"S": sheet})} == {3}


def test_missing_header_is_borrowed_and_numbers_come_from_sheet_or_program(spark):
    first = [["Budgeted expenses"], *HEAD, ["Program 1.1: A"], ["Total program expenses", 1, 2, 3]]
    second = [["Budgeted expenses for Outcome 2"], ["Program 2.1: B"], ["Total program expenses", 4, 5, 6]]
    found = records(spark, {"Table 2.1.1": first, "Table 2.2.1": second})
    assert [(r[0], r[5]) for r in found] == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6)]


def test_single_program_takes_the_outcome_total_and_summary_part_is_ignored(spark):
    sheet = [
        ["Budgeted expenses for Outcome 1"], *HEAD, ["Program 1.1: Only"], ["Annual appropriations", 1, 1, 1],
        ["Outcome 1 Totals by appropriation type"], ["Program 1.2: Not one"], ["Total program expenses", 9, 9, 9],
        ["Total expenses for Outcome 1", 10, "nfp", 30],
    ]
    assert [(r[1], r[3], r[5]) for r in records(spark, {"S": sheet})] == [("1.1", "2023-24", 10), ("1.1", "2025-26", 30)]


def test_description_from_the_resource_sheet(spark):
    sheet = [["Budgeted expenses for Outcome 1"], *HEAD, ["Program 1.1: A"], ["Total program expenses", 1, 2, 3]]
    found = PT.program_records(grid(spark, {"1.1 Resources": [["Outcome 1: Ageing"]], "S": sheet})).collect()
    assert {r["outcome_description"] for r in found} == {"Ageing"}


def test_conflicting_duplicates_keep_the_first(spark):
    rows = spark.createDataFrame([("f", 1, 10), ("f", 2, 12), ("f", 3, 10), ("g", 4, 5)], "k string, pos int, amount_thousands bigint")
    assert {(r["k"], r["amount_thousands"]) for r in first_of_duplicates(rows, ["k"], ["pos"], ["amount_thousands"]).collect()} == {("f", 10), ("g", 5)}
    assert [(r["k"], r["pos"], r["kept_amount"], r["dropped_amount"]) for r in conflicting_duplicates(rows, ["k"], ["pos"]).collect()] == [("f", 2, 10, 12)]


YEARS = ["Program", "", "2024-25 $'000", "2025-26 $'000"]


def measures(spark, lines, name="Table 1.2"):
    found = MT.measure_records(grid(spark, {name: lines}, "b/Edu/Education.xlsx")).collect()
    return sorted((r["measure_name"], r["agency"], r["direction"], tuple(r["programs"]), r["is_departmental"], r["fiscal_year"], r["amount_thousands"]) for r in found)


def test_measures_agencies_categories_and_grand_total_breakdown(spark):
    found = measures(spark, [
        ["Table 1.2: Education 2024-25 Budget Measures"], YEARS, ["Payment measures"],
        ["Better Schools – reform (a)"], ["Services Australia"], ["Administered payments", 1.8, 10, "nfp"], ["", 2.3, 5, 6],
        ["Department of Finance"], ["Departmental payments", 2, 7, 8], ["Total payments", "", 22, 14],
        ["Total payment measures", "", 22, 14], ["Administered payment", "", 15, 6],
        ["Receipt measures"], ["Fee change"], ["Departmental payments", "1.1", 3, "-"], ["Total"],
    ])
    assert found == sorted([
        ("Better Schools - reform", "Services Australia", "payment", ("1.8",), False, "2024-25", 10),
        ("Better Schools - reform", "Services Australia", "payment", ("2.3",), False, "2024-25", 5),
        ("Better Schools - reform", "Services Australia", "payment", ("2.3",), False, "2025-26", 6),
        ("Better Schools - reform", "Department of Finance", "payment", ("2.0",), True, "2024-25", 7),
        ("Better Schools - reform", "Department of Finance", "payment", ("2.0",), True, "2025-26", 8),
        ("Fee change", "Education", "receipt", ("1.1",), True, "2024-25", 3),
    ])


def test_program_hints_headings_wrapped_titles_and_related_receipts(spark):
    found = measures(spark, [
        YEARS, ["Plan for Care", "1.1; 1.2"], ["Administered payments", "", 1, 2], ["Total", "", 1, 2],
        ["Tax Package"], ["Total"], ["– first bullet"], ["Administered payments", 1.1, 3, 4], ["Total"],
        ["Universities Accord -"], ["further reforms"], ["Administered payments", 1.1, 5, 6], ["Related receipts", "", 7, "nfp"],
        ["Inline Measure", 1.4, 8, 9], ["<Enter measure name here> (a)", "", 0, 0],
    ])
    assert found == sorted([
        ("Plan for Care", "Education", "payment", ("1.1", "1.2"), False, "2024-25", 1), ("Plan for Care", "Education", "payment", ("1.1", "1.2"), False, "2025-26", 2),
        ("Tax Package – first bullet".replace("–", "-"), "Education", "payment", ("1.1",), False, "2024-25", 3), ("Tax Package - first bullet", "Education", "payment", ("1.1",), False, "2025-26", 4),
        ("Universities Accord - further reforms", "Education", "payment", ("1.1",), False, "2024-25", 5), ("Universities Accord - further reforms", "Education", "payment", ("1.1",), False, "2025-26", 6),
        ("Universities Accord - further reforms", "Education", "receipt", (), False, "2024-25", 7),
        ("Inline Measure", "Education", "payment", ("1.4",), False, "2024-25", 8), ("Inline Measure", "Education", "payment", ("1.4",), False, "2025-26", 9),
    ])


def test_sheet_without_totals_reads_plain_rows_as_measures(spark):
    lines = [YEARS]
    for i in range(6):
        lines += [[f"Measure {i}"], ["Administered payments", 1.1, i + 1, 0]]
    assert {r[0] for r in measures(spark, lines)} == {f"Measure {i}" for i in range(6)}
    assert {r[1] for r in measures(spark, lines)} == {"Education"}


def test_other_tables_are_left_out(spark):
    body = [YEARS, ["Name"], ["Administered payments", 1.1, 1, 2]]
    assert measures(spark, [["Table 1.2: Additional estimates and variations to outcomes from measures"], *body]) == []
    assert measures(spark, [["Table 1.1: Resource statement"], *body]) == []
    assert measures(spark, body, name="2.1.2 Prog 1.2") == []
    assert measures(spark, [*body, ["(spare space"], ["Later"], ["Administered payments", 1.1, 9, 9]]) == measures(spark, body)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_measure_sheets_are_read_where_they_are_printed(spark):
    from vintagebook.plans import sheets as P
    from vintagebook.plans.bindings import Bound

    printed = P.measure_cells(Bound(spark, "/root/testdata/sf0.001"))
    near = MT.measure_records(printed, together=True)
    assert exchanges(near) == exchanges(printed)
    assert exchanges(MT.impact_tables(printed, together=True)[1]) == exchanges(printed)
    apart = MT.measure_records(printed.localCheckpoint())
    assert near.count() > 0 and sorted(map(str, near.collect())) == sorted(map(str, apart.collect()))


def test_heads_of_measure_sheets_are_those_of_the_whole_grid(spark):
    from vintagebook.plans import sheets as P
    from vintagebook.plans.bindings import Bound

    bound = Bound(spark, "/root/testdata/sf0.001")
    whole = P.measure_cells(bound).where("row_idx < 8")
    assert sorted(map(str, P.measure_heads(bound).select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
