import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstat.operators import profiles as P
from panelstat.plans.blocks import block_pairs


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a > 0)
    return (kl(p) + kl(q)) / 2


@pytest.fixture(scope="module")
def profiles(spark):
    rng = np.random.default_rng(7)
    rows = [(f"r{i}", [float(x) for x in rng.dirichlet(np.ones(4))]) for i in range(30)]
    rows += [("one", [1.0, 0.0, 0.0, 0.0]), ("two", [0.0, 1.0, 0.0, 0.0]), ("flat", [0.25] * 4)]
    return rows, spark.createDataFrame(rows, "rater string, profile array<double>")


def test_softmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 1000.0],), ([0.0] * 4,)], "b array<double>")
    got = [r.s for r in df.select(P.softmax("b", 1.0).alias("s")).collect()]
    assert got[0] == pytest.approx([0, 0, 0, 1]) and got[1] == [0.25] * 4
    hot = df.select(P.softmax("b", 1e9).alias("s")).first().s
    assert hot == pytest.approx([0.25] * 4, abs=1e-5)
    for t in (0, -1):
        with pytest.raises(ValueError):
            P.softmax("b", t)


def test_long_and_array_forms_agree(spark):
    df = spark.createDataFrame([("a", "x", 0.3), ("a", "y", -1.0), ("a", "z", 2.0)], "k string, attribute string, v double")
    long = [r.share for r in P.softmax_long(df, ["k"], "v", 0.5).orderBy("attribute").collect()]
    arr = spark.createDataFrame([([0.3, -1.0, 2.0],)], "b array<double>").select(P.softmax("b", 0.5).alias("s")).first().s
    assert long == pytest.approx(arr)


@pytest.mark.parametrize("blocks", [1, 3, 8])
def test_matrix_is_complete_and_right(profiles, blocks):
    rows, df = profiles
    vec = dict(rows)
    got = {(r.a, r.b): r.jsd for r in P.jsd_matrix(df, n_blocks=blocks).collect()}
    assert len(got) == len(rows) * (len(rows) - 1) // 2
    assert all(v == pytest.approx(js(vec[a], vec[b]), abs=1e-12) and 0 <= v <= 1 for (a, b), v in got.items())
    assert got["one", "two"] == pytest.approx(1)


def test_square_root_is_a_metric(profiles):
    rows, df = profiles
    d = {}
    for r in P.jsd_matrix(df).collect():
        d[r.a, r.b] = d[r.b, r.a] = math.sqrt(r.jsd)
    names = [r for r, _ in rows][:10]
    assert all(d[a, c] <= d[a, b] + d[b, c] + 1e-12 for a in names for b in names for c in names if len({a, b, c}) == 3)


def test_mean_within_group(spark, profiles):
    rows, df = profiles
    vec = dict(rows)
    members = spark.createDataFrame([("g", "r1"), ("g", "r2"), ("g", "r3"), ("h", "one"), ("h", "two")], "group string, member string")
    got = {r.group: r.mean_jsd for r in P.mean_within_group(P.jsd_matrix(df), members).collect()}
    pairs = [("r1", "r2"), ("r1", "r3"), ("r2", "r3")]
    assert got["g"] == pytest.approx(sum(js(vec[a], vec[b]) for a, b in pairs) / 3) and got["h"] == pytest.approx(1)


def test_to_reference(profiles):
    rows, df = profiles
    vec = dict(rows)
    got = {r.rater: r.jsd for r in P.to_reference(df, "flat").collect()}
    assert len(got) == len(rows) - 1 and got["one"] == pytest.approx(js(vec["one"], vec["flat"]))


def test_block_pairs_within_groups(spark):
    df = spark.createDataFrame([(g, f"k{i}") for g in "ab" for i in range(9)], "g string, k string")
    got = [(r.g, r.a.k, r.b.k) for r in block_pairs(df, "k", 4, on=["g"]).collect()]
    assert len(got) == len(set(got)) == 2 * 36 and all(a < b for _, a, b in got)


def test_temperature_sweep(spark):
    beta = [0.2, 0.5, -0.1, 0.0]
    e = np.exp(np.array(beta) / 0.3)
    agents = spark.createDataFrame([("g", [float(v) for v in e / e.sum()], beta)], "grp string, weights array<double>, beta array<double>")
    sweep = P.temperature_sweep(agents, [0.1, 0.3, 1.0], "grp")
    best = P.best_temperature(sweep, "grp").first()
    assert best.temperature == 0.3 and best.mean_jsd == pytest.approx(0, abs=1e-12)
    assert all(r.std_jsd == 0 for r in sweep.collect())


def test_significance(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.03), ("d", 0.9)], "k string, p double")
    got = {r.k: r.significance for r in P.significance(df).collect()}
    assert got == {"a": "corrected", "b": "nominal", "c": "nominal", "d": "none"}
    assert P.significance(df).agg(F.max("bonferroni")).first()[0] == pytest.approx(0.0125)


def test_mean_within_group_makes_no_pair_rows(spark, profiles):
    rows, df = profiles
    members = df.select(F.when(F.col("rater") < "r5", "g").otherwise("h").alias("group"), F.col("rater").alias("member"))
    members = members.union(spark.createDataFrame([("alone", "r1"), ("h", "nobody")], "group string, member string"))
    want = {tuple(r) for r in P.mean_within_group(P.jsd_matrix(df), members).selectExpr("group", "round(mean_jsd, 9)", "n_pairs").collect()}
    blocks = P.mean_within_group(df, members)
    assert {tuple(r) for r in blocks.selectExpr("group", "round(mean_jsd, 9)", "n_pairs").collect()} == want
    totals = {r.rater: r.total for r in P.divergence_totals(df, "rater", n_blocks=3).collect()}
    assert sum(totals.values()) / 2 == pytest.approx(sum(r.jsd for r in P.jsd_matrix(df).collect()))
