import csv

import pytest

from panelstat.functions.scalar import PARTICIPANT_PREFIX
from panelstat.operators import survey as SV
from panelstat.sources.survey_csv import find_column, header_layout, read_survey_csv, survey_layout, write_survey_csv

A = "0075b71f-ec8f-4884-8297-5119de2e4b0e"
B = "1175b71f-ec8f-4884-8297-5119de2e4b0e"
LONG = "A person of a certain age arrives with a long story that takes more than fifty letters"
WHO = ["Name", "Email", "Expertise", "Recorded Date"]
PEOPLE = [
    ["Ann Lee", "ann@x.org", "cardio", "2026-01-12 07:32:34", "Wait", "Stay,\nplease"],
    ["Bob Ray", "bob @x.org", "", "soon", "Operate", ""],
    ["Cy", "", "", "", "Wait", "Go"],
    ["", "", "", "", "", ""],
    ["Dee", "dee(at)x", "", "", "Wait", "Go"],
    ["Eve", "eve@x.org", "", "01/13/2026 09:00", "something else", "Go"],
    ["Ann Lee", "ANN@x.org", "other", "2026-01-11 07:00", "Operate", "Go"],
]
AS_OF = "2026-02-01 00:00:00"


def layouts():
    one = [WHO + [f"{A} - {LONG}", f"{B} - {LONG}"]]
    two = [["QID1", "QID2", "QID3", "EndDate", "QID4", "QID5"], WHO + [f"{A} - {LONG}", f"{B} - {LONG}"]]
    bare = [WHO + [A, B], WHO + [LONG, LONG]]
    meta = two + [['{"ImportId":"x"}'] * 6]
    return {"one": one, "two": two, "bare": bare, "meta": meta}


def write(tmp_path, head, rows=PEOPLE, bom=True):
    p = tmp_path / "survey.csv"
    with open(p, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        csv.writer(f).writerows(head + rows)
    return str(p)


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(A, "Wait", "Operate"), (B, " Stay,\nplease", "Go")], "case_id string, choice_1 string, choice_2 string")


@pytest.mark.parametrize("kind", ["one", "two", "bare", "meta"])
def test_header_layouts(spark, tmp_path, cases, kind):
    rows, layout = read_survey_csv(spark, write(tmp_path, layouts()[kind], bom=kind != "two"))
    assert layout.first_data_row == {"one": 1, "two": 2, "bare": 2, "meta": 3}[kind]
    assert list(layout.cases.values()) == [A, B] and layout.warnings == []
    assert rows.count() == 6
    s = SV.parse_survey(rows, list(layout.cases.values()), cases, AS_OF, layout.warnings)
    got = sorted((r.case_id, r.selected_choice) for r in s.responses.collect())
    assert got == [(A, "choice_1"), (A, "choice_2"), (A, "choice_2"), (B, "choice_1"), (B, "choice_2"), (B, "choice_2")]


def test_everything_else(spark, tmp_path, cases):
    rows, layout = read_survey_csv(spark, write(tmp_path, layouts()["one"]))
    s = SV.parse_survey(rows, [A, B], cases, AS_OF, layout.warnings)
    assert [(r.case_id, r.response_text) for r in s.unmatched.collect()] == [(A, "something else")]
    p = {r.name: r for r in s.participants.collect()}
    assert set(p) == {"Ann Lee", "Bob Ray", "Eve"}
    assert p["Ann Lee"].expertise == "cardio" and str(p["Ann Lee"].first_seen) == "2026-01-11 07:00:00" and str(p["Ann Lee"].last_seen) == "2026-01-12 07:32:34"
    assert p["Bob Ray"].email == "bob@x.org" and str(p["Bob Ray"].first_seen) == AS_OF
    assert p["Eve"].participant_id.startswith(PARTICIPANT_PREFIX)
    kinds = {r.kind: r.n for r in SV.warning_histogram(s.warnings, None).collect()}
    assert kinds == {"Emails with spaces": 1, "Timestamp parsing issues": 2, "Missing participant data": 1, "Invalid email formats": 1, "Unmatched responses": 1, "Empty responses": 1}
    assert SV.warning_histogram(s.warnings).count() == 5
    with pytest.raises(ValueError, match="2 response"):
        SV.check_strict(s)


def test_unknown_case_and_missing_columns(spark, tmp_path, cases):
    head = [["Name", "Email", f"{A} - x"]]
    rows, layout = read_survey_csv(spark, write(tmp_path, head, [["Ann", "a@x.org", "Wait"]]))
    assert layout.timestamp is None and "Column 'Recorded Date' not found" in layout.warnings[0]
    s = SV.parse_survey(rows, [A], cases.filter("false"), AS_OF, layout.warnings)
    kinds = {r.kind for r in SV.warning_histogram(s.warnings, None).collect()}
    assert kinds == {"Missing columns", "Missing case files", "Timestamp parsing issues"}
    assert s.unmatched.count() == 1
    SV.check_strict(SV.parse_survey(rows, [A], cases, AS_OF))


def test_layout_rules():
    assert header_layout([["Name", "x"]]) == (["Name", "x"], 1)
    assert header_layout([["Name", A], ["Ann", "Wait"]])[1] == 1
    assert find_column("email", ["Your e-mail", "Email address"], None) == 1
    assert find_column("name", ["Q1", "Q2"], ["x", "Full Name"]) == 1
    assert find_column("name", ["Q1"], None) is None
    with pytest.raises(ValueError, match="more than one column"):
        survey_layout([["Name", "Email", A, f"{A} - x"], ["a", "b", "c", "d"]])
    with pytest.raises(ValueError):
        survey_layout([["Name"]])


def test_registry_upsert_is_idempotent(spark):
    schema = "participant_id string, name string, email string, expertise string, first_seen timestamp_ntz, last_seen timestamp_ntz"
    row = lambda e, a, b, n="Ann": spark.sql(f"select 'p' participant_id, '{n}' name, 'e' email, '{e}' expertise, timestamp_ntz'{a}' first_seen, timestamp_ntz'{b}' last_seen")
    empty = spark.createDataFrame([], schema)
    one = SV.upsert_registry(empty, row("", "2026-01-02", "2026-01-03"))
    two = SV.upsert_registry(one, row("x", "2026-01-01", "2026-01-02", "Other"))
    again = SV.upsert_registry(two, row("y", "2026-01-01", "2026-01-02"))
    r = again.first()
    assert (r.name, r.expertise, str(r.first_seen)[:10], str(r.last_seen)[:10]) == ("Ann", "x", "2026-01-01", "2026-01-03")


def test_import_statistics(spark, cases):
    resp = spark.createDataFrame([(A, "p"), (B, "p"), (A, "q"), ("gone", "p"), (A, "nobody")], "case_id string, participant_id string")
    people = spark.createDataFrame([("p",), ("q",)], "participant_id string")
    known = spark.createDataFrame([("p",)], "participant_id string")
    r = SV.import_statistics(resp, cases, people, known).first()
    assert (r.cases_updated, r.responses_saved, r.participants_added) == (2, 3, 1)


@pytest.mark.parametrize("n_files", [1, 3, 8])
def test_survey_in_many_files(spark, tmp_path, n_files):
    """Row numbers are those of one file, cells with line breaks, quotes and commas stay whole, blank rows keep their place."""
    case = "00000001-0000-4000-8000-000000000000"
    head = [["QID"] * 4, ["Name", "Email", "Recorded Date", f"{case} - a"]]
    said = [(i, f"n{i}", 'a "b", c\nd' if i % 3 else "", None, None if i % 5 == 0 else " x") for i in range(40)]
    said[7] = (7, None, None, None, None)
    rows = spark.createDataFrame(said, "row int, name string, email string, recorded string, answer string").repartition(5)
    path = str(tmp_path / f"s{n_files}")
    write_survey_csv(rows, head, path, n_files=n_files)
    got, layout = read_survey_csv(spark, path)
    assert layout.first_data_row == 2 and layout.cases == {3: case}
    want = sorted((i + 3, n or "", e or "", a or "") for i, n, e, _, a in said if i != 7)
    assert sorted((r.row, r.name, r.email, r[case]) for r in got.collect()) == want
    files = [p for p in (tmp_path / f"s{n_files}" / "1-rows").glob("part-*")]
    assert len(files) == n_files
    write_survey_csv(rows.limit(0), head, path)
    assert read_survey_csv(spark, path)[0].count() == 0
    with pytest.raises(ValueError, match="one cell per column"):
        write_survey_csv(rows, [["Name"]], path)
