import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelstat.functions import tails
from panelstat.operators import correlate as C
from panelstat.operators import merge as J
from panelstat.operators import metrics as M
from panelstat.operators import summary as SM
from panelstat.plans.gram import pair_moments
from panelstat.plans.positions import dense_position

SCHEMA = "case_id string, rater string, parsed_choice string"


def runs(spark, cells):
    rows = [(c, r, x) for (c, r), xs in cells.items() for x in xs]
    names = {"1": "choice_1", "2": "choice_2", "R": "REFUSAL"}
    return spark.createDataFrame([(c, r, names[x]) for c, r, x in rows], SCHEMA)


@pytest.fixture(scope="module")
def summary(spark):
    return SM.with_consensus(SM.run_summary(runs(spark, {
        ("a", "m"): "12", ("b", "m"): "RR", ("c", "m"): "111R",
        ("a", "human/p"): "1", ("a", "human/q"): "2", ("b", "human/p"): "R", ("c", "human/p"): "1", ("c", "human/q"): "1",
        ("a", "n"): "222", ("c", "n"): "22",
    }))).cache()


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_ties_and_refusals(summary):
    s = by(summary, "case_id", "rater")
    assert s["a", "m"].majority == "choice_1"
    assert s["a", "human_consensus"].majority is None and s["a", "human_consensus"].majority_probability == 0.5
    assert s["b", "m"].majority is None and s["b", "m"].entropy is None and s["b", "m"].p1 is None
    assert s["c", "m"].entropy == 0.0 and s["a", "m"].entropy == 1.0
    assert ("b", "human_consensus") in s and s["b", "human_consensus"].valid == 0


def test_refusal_rate_is_a_mean_of_ratios(summary):
    r = by(M.refusal_rate(summary), "rater")
    assert r["m"].refusal_rate == pytest.approx((0 + 1 + 0.25) / 3)
    assert "human_consensus" not in r


def test_preference_skips_neutral_cases(spark, summary):
    tags = spark.createDataFrame([("a", "x", 1, -1), ("b", "x", 1, 0), ("c", "x", 0, 0), ("c", "y", -1, 1)], "case_id string, attribute string, align_1 int, align_2 int")
    p = by(M.value_preference(summary, tags, ["x", "y"]), "rater", "attribute")
    assert p["m", "x"].preference == 0.0 and p["m", "x"].n_cases == 1
    assert p["n", "x"].preference == -1.0 and p["n", "y"].preference == 1.0
    with pytest.raises(Exception, match="nobody"):
        M.require_rows(M.value_preference(summary, tags, ["x", "y"]), "rater", ["m", "nobody"], "no valid runs").collect()
    assert M.require_rows(M.value_preference(summary, tags, ["x", "y"]), "rater", ["m"], "no valid runs").count() == 2


def test_agreement(summary):
    m = by(M.agreement_matrix(summary), "rater_a", "rater_b")
    assert m["m", "n"].agreement == 0.0 and m["m", "n"].n_cases == 2
    assert m["human/p", "m"].agreement == 1.0
    assert m["human_consensus", "m"].n_cases == 1
    assert M.agreement_rate(summary, "m", "n").first().agreement == 0.0


def test_pair_moments_blocks_and_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", f"r{j}", float(rng.normal())) for j in range(40)]
    rows += [(f"c{i}", f"r{j}", float(rng.normal())) for i in range(30) for j in rng.choice(40, 7, replace=False)]
    df = spark.createDataFrame(rows, "g string, r string, v double")
    cells = {}
    for g, r, v in rows:
        cells.setdefault(g, {})[r] = v
    want = {}
    for d in cells.values():
        for a in d:
            for b in d:
                if a < b:
                    w = want.setdefault((a, b), np.zeros(6))
                    w += [1, d[a], d[b], d[a] ** 2, d[b] ** 2, d[a] * d[b]]
    for n in (1, 3):
        got = {(r.item_a, r.item_b): np.array([r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy]) for r in pair_moments(df, "g", "r", "v", n).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k]) for k in want)


def test_constant_entropy_has_no_correlation(summary):
    m = by(C.entropy_correlation_matrix(summary), "rater_a", "rater_b")
    assert m["human/p", "m"].r is None


def test_spearman_with_ties(spark):
    x, y = [1, 2, 2, 4, 5, 5], [3, 1, 4, 4, 9, 2]
    rank = lambda v: np.array([sum(u < w for u in v) + (sum(u == w for u in v) + 1) / 2 for w in v])
    want = np.corrcoef(rank(x), rank(y))[0, 1]
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)] + [("h", 1.0, 1.0)], "k string, x double, y double")
    got = C.spearman(df, ["k"]).collect()
    assert len(got) == 1 and got[0].rho == pytest.approx(want) and 0 < got[0].p < 1


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 9), (3, 5), (5, 4), (2, 8)])
def test_exact_rank_sum_p(n1, n2):
    """Against every split of the ranks, for every U."""
    every = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        far = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(v >= far for v in every) / len(every))
        assert tails.rank_sum_p(float(u), n1, n2, 0.0, 9.9) == pytest.approx(want, rel=1e-14)


def test_rank_sum_p_table_and_choice(spark):
    # critical values of the two-sided 5 % table: 13 for 8 and 8, 2 for 5 and 5, 0 for 4 and 4 at 2/70
    assert tails.rank_sum_p(13.0, 8, 8, 0.0, 0.0) <= 0.05 < tails.rank_sum_p(14.0, 8, 8, 0.0, 0.0)
    assert tails.rank_sum_p(2.0, 5, 5, 0.0, 0.0) <= 0.05 < tails.rank_sum_p(3.0, 5, 5, 0.0, 0.0)
    assert tails.rank_sum_p(0.0, 4, 4, 0.0, 0.0) == pytest.approx(2 / 70)
    normal = 0.04999579029644087  # two-sided at 1.96
    assert tails.rank_sum_p(0.0, 9, 9, 0.0, 1.96) == pytest.approx(normal) == tails.rank_sum_p(0.0, 4, 4, 6.0, 1.96)
    assert tails.rank_sum_p(0.0, 0, 4, 0.0, float("nan")) is None
    rows = [("t", "A", v) for v in (1.0, 2.0, 3.0)] + [("t", "B", v) for v in (4.0, 5.0, 6.0)] + [("one", "B", 1.0)]
    df = spark.createDataFrame(rows, "k string, g string, v double")
    got = {r.k: (r.u, r.p) for r in C.mann_whitney(df, ["k"], "g", "A", "v").collect()}
    assert got == {"t": (0.0, pytest.approx(2 / 20)), "one": (0.0, None)}


def test_tension_table_function(spark):
    rows = [("c1", "a", 1), ("c1", "b", -2), ("c1", "c", 0), ("c1", "d", 1), ("c1", "e", -1), ("c2", "a", 1), ("c3", "a", None), ("c3", "b", 1)]
    tags = spark.createDataFrame(rows, "case_id string, attribute string, delta int")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(M.tension_pairs_lateral(tags)) == key(M.tension_pairs(tags)) == [("c1", "a", "b"), ("c1", "a", "e"), ("c1", "b", "d"), ("c1", "d", "e")]
    assert M.tension_pairs_lateral(tags.limit(0)).count() == 0


def test_mann_whitney(spark):
    a, b = [1.0, 4.0, 6.0, 6.0], [2.0, 6.0, 7.0, 8.0, 9.0]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    df = spark.createDataFrame([("t", "A", v) for v in a] + [("t", "B", v) for v in b], "k string, g string, v double")
    got = C.mann_whitney(df, ["k"], "g", "A", "v").first()
    assert got.u == u and (got.n1, got.n2) == (4, 5)


def test_fleiss_kappa(spark):
    t = spark.createDataFrame([(3, 1), (0, 4), (2, 2)], "a int, b int")
    rows = np.array([[3, 1], [0, 4], [2, 2]])
    p_i = ((rows**2).sum(1) - 4) / 12
    pe = ((rows.sum(0) / 12) ** 2).sum()
    assert M.fleiss_kappa(t, ["a", "b"]).first().kappa == pytest.approx((p_i.mean() - pe) / (1 - pe))
    with pytest.raises(Exception, match="unequal"):
        M.fleiss_kappa(t.union(spark.createDataFrame([(1, 1)], "a int, b int")), ["a", "b"]).collect()


def test_tension_pairs(spark):
    tags = spark.createDataFrame([("c", "b", 2), ("c", "a", -1), ("c", "d", 0), ("c", "e", 1)], "case_id string, attribute string, delta int")
    assert {(r.x, r.y) for r in M.tension_pairs(tags).collect()} == {("a", "b"), ("a", "e")}


def test_near_determinism_is_exact_at_nine_of_ten(spark):
    s = SM.run_summary(runs(spark, {("a", "m"): "1" * 9 + "2", ("b", "m"): "1" * 8 + "22"}))
    assert M.near_determinism(s).first().near_deterministic == 0.5


def test_merge_runs_rejects_a_rater_on_both_sides(spark):
    a = runs(spark, {("a", "m"): "1"})
    b = runs(spark, {("a", "human/p"): "1"})
    assert J.merge_runs(a, b).count() == 2
    with pytest.raises(Exception, match="both sides"):
        J.merge_runs(a, a).collect()


def test_latest_response_and_upsert(spark):
    schema = "case_id string, participant_id string, parsed_choice string, ts timestamp_ntz, event_id bigint"
    rows = spark.sql("select 'c' case_id, 'p' participant_id, x parsed_choice, timestamp_ntz'2026-01-01 00:00:00' ts, e event_id from values ('a', 1L), ('b', 2L) t(x, e)")
    empty = spark.createDataFrame([], schema)
    once = J.upsert_responses(empty, rows, 1)
    twice = J.upsert_responses(once, rows, 2)
    assert [r.parsed_choice for r in twice.collect()] == ["b"]
    older = rows.filter("event_id = 1")
    # the newest import wins even with an older response
    assert J.upsert_responses(twice, older, 3).first().parsed_choice == "a"


def test_select_and_pending(spark):
    rec = spark.createDataFrame([("a", "approved", True), ("b", "approved", False), ("c", "draft", True)], "case_id string, status string, final_tagged boolean")
    assert [r.case_id for r in J.select_cases(rec).collect()] == ["a"]
    assert J.select_cases(rec, "all").count() == 3
    for args in (("explicit", []), ("other", None)):
        with pytest.raises(ValueError):
            J.select_cases(rec, *args)
    wanted = spark.createDataFrame([(x,) for x in "abcd"], "case_id string")
    assert {r.case_id: r.problem for r in J.lookup_errors(wanted, rec).collect()} == {"b": "no final version", "c": "status draft", "d": "not found"}
    s = SM.run_summary(runs(spark, {("a", "m"): "12", ("b", "m"): "111"}))
    todo = J.pending_work(rec, s, ["m"], 3)
    assert sorted((r.case_id, r.run) for r in todo.collect()) == [("a", 2), ("c", 0), ("c", 1), ("c", 2)]


def test_positions_do_not_depend_on_partitions(spark):
    ids = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    a = {r.k: (r.pos, r.n) for r in dense_position(ids, "k").collect()}
    b = {r.k: (r.pos, r.n) for r in dense_position(ids.repartition(13), "k").collect()}
    assert a == b and sorted(p for p, _ in a.values()) == list(range(500)) and {n for _, n in a.values()} == {500}


def test_entropy_values(spark):
    from panelstat.functions.scalar import binary_entropy

    df = spark.createDataFrame([(0, 0), (0, 4), (4, 4), (1, 4)], "k int, n int")
    got = [r.e for r in df.select(binary_entropy("k", "n").alias("e")).collect()]
    assert got[:3] == [0, 0, 0] and got[3] == pytest.approx(-(0.25 * math.log2(0.25) + 0.75 * math.log2(0.75)))


def test_pair_moments_in_blocks(spark):
    """Blocks are taken one after the other, whatever number of items there is."""
    from panelstat.plans.gram import pair_moments

    cells = spark.range(400).select((F.col("id") % 20).alias("c"), F.concat(F.lit("r"), (F.col("id") % 37).cast("string")).alias("i"), (F.col("id") % 11).cast("double").alias("v")).distinct().cache()
    read = lambda **kw: sorted(map(tuple, pair_moments(cells, "c", "i", "v", **kw).collect()))
    assert read() == read(n_blocks=1) == read(n_blocks=5) and len(read()) > 100


def test_pair_moments_of_short_and_long_groups(spark, monkeypatch):
    """With several blocks short groups go pair by pair and never meet as blocks; sums that are handed on early add up."""
    from panelstat.plans import gram

    rng = np.random.default_rng(6)
    rows = [(f"c{i}", f"r{j}", float(rng.normal())) for i in range(60) for j in rng.choice(90, 30 if i % 20 == 0 else 6, replace=False)]
    df = spark.createDataFrame(rows, "g string, r string, v double")
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r, v) for c, r, v in rows if c == g)
        for i, (a, x) in enumerate(own):
            for b, y in own[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + np.array([1, x, y, x * x, y * y, x * y])
    read = lambda: {(r.item_a, r.item_b): np.array(r[2:]) for r in pair_moments(df, "g", "r", "v", 5).collect()}
    for limit in (10, 128):
        monkeypatch.setattr(gram, "SHORT_GROUP", limit)
        got = read()
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    batch = pa.RecordBatch.from_arrays([pa.array([[{"item": r, "value": v} for c, r, v in rows if c == g] for g in sorted({r[0] for r in rows})])], names=["a"])
    monkeypatch.setattr(gram, "PAIR_SUMS", 40)
    sums, lines = {}, 0
    for out in gram._short_moments(iter([batch.slice(i, 3) for i in range(0, 60, 3)])):
        for r in out.to_pylist():
            sums[r["item_a"], r["item_b"]] = sums.get((r["item_a"], r["item_b"]), 0) + np.array(list(r.values())[2:])
            lines += 1
    assert lines > len(want) and sums.keys() == want.keys() and all(np.allclose(sums[k], want[k]) for k in want)
