from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from panelstat.operators import validate as V
from panelstat.schema import ATTRIBUTES, REVIEW_COLUMNS, TAGS


def rule_of(pairs):
    """The four rules over ((tag_1, tag_2), ...) in plain Python."""
    if any(a == b != "neutral" for a, b in pairs):
        return 1
    if sum(a != "neutral" or b != "neutral" for a, b in pairs) < 2:
        return 2
    sets = {(o, t): {i for i, p in enumerate(pairs) if p[o] == t} for o in (0, 1) for t in ("promotes", "violates")}
    apart = any(sets[0, t] and sets[1, t] and sets[0, t] != sets[1, t] for t in ("promotes", "violates"))
    if not apart and not any({a, b} == {"promotes", "violates"} for a, b in pairs):
        return 3
    kinds = [("promotes" in [p[o] for p in pairs], "violates" in [p[o] for p in pairs]) for o in (0, 1)]
    down = [v and not p for p, v in kinds]
    good = [p for p, _ in kinds]
    return 4 if (down[0] and good[1]) or (down[1] and good[0]) else None


def test_all_tag_combinations(spark):
    combos = list(product(product(TAGS, repeat=2), repeat=4))
    rows = [(str(i), a, p[0], p[1]) for i, c in enumerate(combos) for a, p in zip(ATTRIBUTES, c)]
    tags = spark.createDataFrame(rows, "case_id string, attribute string, tag_1 string, tag_2 string")
    got = {r.case_id: r.failed_rule for r in V.validate_cases(tags).collect()}
    want = {str(i): rule_of(c) for i, c in enumerate(combos)}
    assert got == want
    assert Counter(want.values()) == {1: 4160, 2: 25, 3: 244, 4: 850, None: 1282}


def test_first_bad_attribute_in_order(spark):
    rows = [("c", "justice", "promotes", "promotes"), ("c", "beneficence", "violates", "violates"),
            ("c", "autonomy", "neutral", "neutral"), ("c", "nonmaleficence", "neutral", "promotes")]
    tags = spark.createDataFrame(rows, "case_id string, attribute string, tag_1 string, tag_2 string")
    assert V.validate_cases(tags).first().message.endswith("beneficence")


def review(spark, **cells):
    base = dict.fromkeys(REVIEW_COLUMNS, "")
    base |= {"Case ID": "c", "Vignette": "v", "Choice 1": "a", "Choice 2": "b"}
    base |= {f"{a.capitalize()} C{o}": "neutral" for a in ATTRIBUTES for o in (1, 2)}
    base |= {"Autonomy C1": "promotes", "Autonomy C2": "violates", "Justice C1": "violates", "Justice C2": "Promotes "}
    base |= cells
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"`{c}` string" for c in base))


def test_review_rows(spark):
    check = lambda **c: V.validate_review_rows(review(spark, **c)).first()
    assert check().status == "valid"
    assert check(**{"Case ID": " "}).errors == ["Missing Case ID"] and check(**{"Case ID": ""}).reported_id == "UNKNOWN"
    bad = check(**{"Vignette": "", "Justice C1": "maybe", "Autonomy C2": ""})
    assert bad.errors == [
        "Missing vignette", "Invalid value tag 'maybe' in Justice C1 (must be promotes/violates/neutral)", "Missing value tag: Autonomy C2",
    ]
    assert check(**{"Justice C1": "promotes"}).status == "error"


def test_rubrics_statuses_vectors(spark):
    r = spark.createDataFrame([("c", "x", False, ""), ("c", "y", True, None), ("c", "z", False, "fix")], "case_id string, criterion string, outcome boolean, suggested_changes string")
    assert [x.criterion for x in V.rubric_violations(r).collect()] == ["x"]
    s = spark.createDataFrame([("a", "completed"), ("b", "draft")], "case_id string, status string")
    assert [x.case_id for x in V.unknown_statuses(s).collect()] == ["a"]
    got = spark.createDataFrame([("a", [1.0]), ("b", []), ("c", [float("nan")]), ("x", [1.0]), ("a2", [1.0]), ("a2", [1.0])], "case_id string, embedding array<float>")
    asked = spark.createDataFrame([(i,) for i in ("a", "a2", "b", "c", "d")], "case_id string")
    assert {r.case_id: r.problem for r in V.embedding_problems(got, asked).collect()} == {
        "a2": "repeated", "b": "empty vector", "c": "not numeric", "d": "missing vector", "x": "not asked for"}
    assert V.by_status(s, []).count() == 2 and V.by_status(s).count() == 0
