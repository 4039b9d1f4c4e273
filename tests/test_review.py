import pytest

from panelstat.operators import merge as J
from panelstat.operators import review as RV
from panelstat.plans.positions import dense_position
from panelstat.schema import REVIEW_COLUMNS
from panelstat.sources import review_table, seeds

SCHEMA = "case_id string, pos int, iteration int, vignette string, tagged boolean, reviewer string, decision string, comments string"


@pytest.fixture(scope="module")
def iterations(spark):
    return spark.createDataFrame([
        ("a", 0, 0, "v0", False, None, None, None), ("a", 1, 1, "v1", True, "Ann ", "Approved", "ok"), ("a", 2, 2, None, False, "Bo", "no", None),
        ("b", 0, 5, "w0", True, None, None, None), ("b", 1, 6, "w1", True, "Ann", "reject", "x"), ("b", 2, 7, "w2", True, "Ann", "yes", "y"),
        ("c", 0, 0, None, False, " ", "approve", None),
    ], SCHEMA)


def test_final_versions(iterations):
    pos = lambda rule: {r.case_id: r.pos for r in RV.final_version(iterations, rule).collect()}
    assert pos("last") == {"a": 2, "b": 2, "c": 0}
    assert pos("last_if_tagged") == {"b": 2}
    assert pos("last_tagged") == {"a": 1, "b": 2}
    assert pos("last_with_data") == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        RV.final_version(iterations, "first")


def test_votes_and_summary(spark, iterations):
    v = {(r.case_id, r.reviewer): r.decision for r in RV.reviewer_votes(iterations).collect()}
    assert v == {("a", "Ann"): "approve", ("a", "Bo"): "reject", ("b", "Ann"): "approve"}
    rec = spark.createDataFrame([(c, i) for i, c in enumerate("abc")], "case_id string, created_at int")
    s = {r.case_id: r for r in RV.review_summary(rec, RV.reviewer_votes(iterations)).collect()}
    assert s["a"].controversy == 0.5 and s["b"].controversy == 0 and s["c"].num_evaluations == 0
    order = lambda o: [r.case_id for r in RV.ordered_cases(RV.review_summary(rec, RV.reviewer_votes(iterations)), o).collect()]
    assert order("newest") == ["c", "b", "a"] and order("oldest") == ["a", "b", "c"]
    assert order("most_controversial") == ["a", "b", "c"] and order("most_approved") == ["b", "a", "c"]


def test_evaluations(iterations):
    assert {r.case_id: r.reviewer for r in RV.export_evaluation(iterations).collect()} == {"a": "Ann ", "b": "Ann"}
    assert {r.case_id: r.pos for r in RV.latest_evaluation(iterations).collect()} == {"a": 2, "b": 2, "c": 0}


def test_status(spark):
    rows = [("approve", "", "", "needs_review"), ("", " Approve", "", "approved"), ("", "", "approve", "approved"), ("Reject", "approve", "", "deprecated"), (None, None, None, "needs_review")]
    df = spark.createDataFrame(rows, "a string, b string, c string, want string")
    assert all(r.got == r.want for r in df.select("want", RV.derive_status("a", "b", "c").alias("got")).collect())
    st = spark.createDataFrame([(s,) for s in ("failed", "Draft", "odd", "approved", "needs_review")], "s string")
    assert [r.s for r in st.orderBy(RV.status_priority("s")).collect()] == ["needs_review", "approved", "Draft", "failed", "odd"]


def test_update_plan(spark):
    cols = "case_id string, vignette string, r1 string, r1_decision string, r2 string, r2_decision string, r3 string, r3_decision string, comments string"
    base = ("v", "Ann", "", "Bo", "approve", "", "", "note")
    hist = spark.createDataFrame([("same", *base, 3, "approved"), ("text", *base, 3, "approved"), ("who", *base, 3, "approved"), ("status", *base, 3, "draft"), ("new", None, None, None, None, None, None, None, None, None, "draft")],
                                 cols + ", last_iteration int, status string")
    inc = spark.createDataFrame([("same", " v", "ann", "", "bo", "Approve", "", "", "note "), ("text", "v2", *base[1:]), ("who", "v", "Cy", *base[2:]), ("status", *base), ("new", *base), ("gone", *base)], cols)
    got = {r.case_id: r for r in RV.plan_updates(hist, inc, ["vignette"], ["r1", "r1_decision", "r2", "r2_decision", "r3", "r3_decision"], "comments").collect()}
    assert {k: r.action for k, r in got.items()} == {"same": "unchanged", "text": "append", "who": "append", "status": "append", "new": "append", "gone": "skipped"}
    assert got["text"].next_iteration == 4 and got["new"].next_iteration == 0 and got["text"].new_status == "approved"


def test_rubrics(spark):
    df = spark.createDataFrame([("a", "x", 2, "two", False, " b "), ("a", "x", 1, "one", False, "a"), ("a", "x", 3, "three", True, None), ("a", "y", 1, "one", True, None)],
                               "case_id string, rubric string, position int, criterion string, outcome boolean, suggested_changes string")
    r = {x.rubric: x for x in RV.rubric_metrics(df).collect()}
    assert r["x"].failing == "one,two" and r["x"].suggestions == "one: a\ntwo: b" and r["x"].pass_rate == pytest.approx(1 / 3) and not r["x"].overall_pass
    assert r["y"].overall_pass and r["y"].suggestions == ""


def test_sync(spark):
    local = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "case_id string, exportable boolean")
    sheet = spark.createDataFrame([("c",), ("d",)], "case_id string")
    assert {r.case_id: r.action for r in J.sync_plan(local, sheet).collect()} == {"a": "push", "b": "skipped", "c": "pull", "d": "sheet_only"}
    assert {r.case_id: r.action for r in J.sync_plan(local, None).collect()} == {"a": "push", "b": "skipped", "c": "push"}
    assert tuple(J.sync_summary(local, sheet).first()) == (3, 2, 2, 1, 1)


def test_review_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "sheet")
    case = spark.createDataFrame([("id1", "approved", 'say "hi",\nnow', "x", "y", "promotes")], "case_id string, status string, vignette string, choice_1 string, choice_2 string, c1_autonomy string")
    row = RV.review_row(case)
    assert row.columns == REVIEW_COLUMNS and row.first()["Autonomy C1"] == "promotes" and row.first()["Justice C2"] == "neutral"
    review_table.write_review_rows(row, path)
    blank = spark.createDataFrame([tuple([" "] * 20)], row.schema)
    review_table.write_review_rows(blank, path, "append")
    back = review_table.read_review_rows(spark, path)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in row.collect()]
    assert review_table.read_review_rows(spark, path, "APPROVED").count() == 1 and review_table.read_review_rows(spark, path, "draft").count() == 0


def test_short_review_rows(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text(",".join(f'"{c}"' for c in REVIEW_COLUMNS) + "\nid1,Ann\n\n,,,\n")
    rows = review_table.read_review_rows(spark, str(p)).collect()
    assert len(rows) == 1 and rows[0]["R1"] == "Ann" and rows[0]["Reviewer Comments"] == ""


def test_feedback(spark):
    df = spark.createDataFrame([("approve", "Ann", "lit", ["x", "y"], "c"), ("reject", "Ann", "lit", [], "d"), ("reject", "Bo", "syn", ["x"], ""), (None, "Bo", "syn", None, "e")],
                               "decision string, evaluator string, seed_mode string, problem_axes array<string>, comments string")
    got = {(r.facet, r.value): r.n for r in RV.feedback_statistics(df).collect()}
    assert got == {("total", ""): 3, ("decision", "approve"): 1, ("decision", "reject"): 1, ("decision", None): 1, ("evaluator", "Ann"): 2, ("evaluator", "Bo"): 1,
                   ("seed_mode", "lit"): 2, ("seed_mode", "syn"): 1, ("axis", "x"): 1, ("axis", "y"): 1}


def test_newest_file(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "case_id string, modified int, file string")
    assert {r.case_id: r.file for r in RV.newest_file(df).collect()} == {"a": "y", "b": "z"}


def test_seeds(spark, tmp_path):
    p = tmp_path / "seeds.json"
    p.write_text('[{"case": "one", "value_1": "a", "value_2": "b", "scenario_type": "within"},\n {"case": "two", "scenario_type": "between"}, {"case": "three", "scenario_type": "within"}]')
    s = seeds.of_type(seeds.read_seeds(spark, str(p)))
    assert [r.case for r in s.orderBy("pos").collect()] == ["one", "three"]
    pos = s.select("case").join(dense_position(s, "case"), "case")
    assert seeds.seed_at(pos, 1).count() == 1 and seeds.seed_slice(pos, 0, 2).count() == 2
    with pytest.raises(Exception, match="out of bounds"):
        seeds.seed_at(pos, 2).collect()
    with pytest.raises(ValueError):
        seeds.seed_at(pos, -1)
    assert seeds.random_seed_row(s, "case", 1).first() == seeds.random_seed_row(s.repartition(3), "case", 1).first()
