import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstat.operators import glm as G
from panelstat.operators import profiles as P
from panelstat.operators import summary as SM
from panelstat.schema import ATTRIBUTES

D = [f"d_{a}" for a in ATTRIBUTES]


def make(seed, n_cases=60, raters=("r0", "r1"), trials=(1, 12)):
    rng = np.random.default_rng(seed)
    X = rng.integers(-2, 3, size=(n_cases, 4))
    rows = []
    for r in raters:
        beta = rng.normal(0, 0.5, 4)
        n = rng.integers(*trials, size=n_cases)
        c1 = rng.binomial(n, 1 / (1 + np.exp(-X @ beta)))
        rows += [(f"c{i}", r, *map(int, X[i]), float(c1[i] / n[i]), int(c1[i]), int(n[i])) for i in range(n_cases)]
    return rows


SCHEMA = "case_id string, rater string, " + ", ".join(f"{d} int" for d in D) + ", p1 double, c1 bigint, n bigint"


def arrays(rows, rater):
    r = [x for x in rows if x[1] == rater]
    return np.array([x[2:6] for x in r], float), np.array([x[7] for x in r], float), np.array([x[8] for x in r], float)


def newton(X, c1, n, lam=None):
    b = np.zeros(X.shape[1])
    lam = np.zeros(X.shape[1]) if lam is None else lam
    for _ in range(60):
        mu = 1 / (1 + np.exp(-X @ b))
        H = (X.T * (n * mu * (1 - mu))) @ X + np.diag(lam)
        b = b + np.linalg.solve(H, X.T @ (c1 - n * mu) - lam * b)
    mu = 1 / (1 + np.exp(-X @ b))
    return b, mu, np.linalg.inv((X.T * (n * mu * (1 - mu))) @ X)


def loglik(X, c1, n, b):
    """Per case, with the share as the outcome and the trials as weights."""
    y, mu = c1 / n, 1 / (1 + np.exp(-X @ b))
    const = np.array([-math.lgamma(v + 1) - math.lgamma(2 - v) for v in y])
    return (n * (const + y * np.log(mu) + (1 - y) * np.log(1 - mu))).sum()


@pytest.fixture(scope="module")
def data(spark):
    rows = make(1)
    design = spark.createDataFrame(rows, SCHEMA).cache()
    cells = G.design_cells(design, ["rater"]).cache()
    return rows, design, cells


def test_weights_and_sandwich(data):
    rows, design, cells = data
    fits = G.fit_cells(cells, ["rater"], sandwich=True)
    got = {(r.rater, r.attribute): r for r in G.long_weights(fits, ["rater"]).collect()}
    for rater in ("r0", "r1"):
        X, c1, n = arrays(rows, rater)
        b, mu, inv = newton(X, c1, n)
        meat = (X.T * (n * (c1 / n - mu) ** 2)) @ X
        se = np.sqrt(np.diag(inv @ meat @ inv))
        for i, a in enumerate(ATTRIBUTES):
            r = got[rater, a]
            assert r.beta == pytest.approx(b[i], abs=1e-9) and r.std_error == pytest.approx(se[i], rel=1e-8)
            assert r.p_value == pytest.approx(math.erfc(abs(b[i] / se[i]) / math.sqrt(2)), rel=1e-6)


def test_leverage_errors(data):
    rows, design, cells = data
    got = {(r.rater, r.attribute): r.std_error for r in G.leverage_errors(design, G.fit_cells(cells, ["rater"])).collect()}
    X, c1, n = arrays(rows, "r0")
    b, mu, inv = newton(X, c1, n)
    w = n * mu * (1 - mu)
    h = w * np.einsum("ij,jk,ik->i", X, inv, X)
    g = n * (c1 / n - mu) / (1 - h)
    se = np.sqrt(np.diag(inv @ ((X.T * g**2) @ X) @ inv))
    assert [got["r0", a] for a in ATTRIBUTES] == pytest.approx(list(se), rel=1e-8)


def test_goodness_of_fit_and_uniform_null(data):
    rows, design, cells = data
    gof = {r.rater: r for r in G.goodness_of_fit(G.fit_cells(cells, ["rater"]), ["rater"]).collect()}
    lrt = {r.rater: r for r in G.lrt_uniform_null(cells, ["rater"]).collect()}
    X, c1, n = arrays(rows, "r1")
    b, mu, _ = newton(X, c1, n)
    ll = loglik(X, c1, n, b)
    y, m = c1 / n, c1.sum() / n.sum()
    ll0 = loglik(np.ones((len(n), 1)), c1, n, np.array([math.log(m / (1 - m))]))
    dev = sum(2 * w * ((v * math.log(v / u) if v > 0 else 0) + ((1 - v) * math.log((1 - v) / (1 - u)) if v < 1 else 0)) for w, v, u in zip(n, y, mu))
    assert gof["r1"].log_likelihood == pytest.approx(ll) and gof["r1"].deviance == pytest.approx(dev)
    assert gof["r1"].mcfadden_r2 == pytest.approx(1 - ll / ll0)
    s = X.sum(1, keepdims=True)
    null = loglik(s, c1, n, newton(s, c1, n)[0])
    assert lrt["r1"].ll_null == pytest.approx(null) and lrt["r1"].lrt == pytest.approx(2 * (ll - null), abs=1e-8)
    assert lrt["r1"].df == 3 and 0 <= lrt["r1"].p_value <= 1


def test_interactions_and_margins(data):
    rows, design, cells = data
    full = G.interaction_weights(cells, ["rater"])
    got = {r.rater: r for r in full.collect()}
    X, c1, n = arrays(rows, "r0")
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    Z = np.hstack([X, np.stack([X[:, i] * X[:, j] for i, j in pairs], axis=1)])
    b, _, _ = newton(Z, c1, n)
    assert np.allclose(got["r0"].beta, b, atol=1e-7) and got["r0"].penalty == 0
    marg = {r.rater: r.beta for r in G.marginal_weights(full, cells, ["rater"]).collect()}["r0"]
    m = X.mean(0)
    want = [b[v] + sum(b[4 + p] * m[j if i == v else i] for p, (i, j) in enumerate(pairs) if v in (i, j)) for v in range(4)]
    assert np.allclose(marg, want, atol=1e-7)


def frame(spark, rows):
    return G.design_cells(spark.createDataFrame(rows, SCHEMA), ["rater"])


def test_fits_without_variation_are_zero(spark):
    ones = [(f"c{i}", "y", i % 2, 1, 0, 0, 1.0, 3, 3) for i in range(4)]
    flat = [(f"c{i}", "x", 0, 0, 0, 0, 0.5, 1, 2) for i in range(4)]
    got = {r.rater: r for r in G.fit_cells(frame(spark, ones + flat), ["rater"]).collect()}
    assert got["y"].status == "constant_outcome" and got["x"].status == "constant_design"
    assert all(list(r.beta) == [0, 0, 0, 0] for r in got.values())


def test_rank_deficient_design_gets_the_smallest_solution(spark):
    rows = [(f"c{i}", "r", d, d, 0, 0, c / 4, c, 4) for i, (d, c) in enumerate([(1, 3), (-1, 1), (2, 4), (1, 2)])]
    r = G.fit_cells(frame(spark, rows), ["rater"]).first()
    assert r.status == "converged" and r.beta[0] == pytest.approx(r.beta[1]) and r.beta[2] == 0
    x, c1 = np.array([[1.0], [-1], [2], [1]]), np.array([3.0, 1, 4, 2])
    assert 2 * r.beta[0] == pytest.approx(newton(x, c1, np.full(4, 4.0))[0][0], abs=1e-8)


def test_separated_data_is_flagged_or_large(spark):
    rows = [("c0", "r", 1, 0, 0, 0, 1.0, 2, 2), ("c1", "r", -1, 0, 0, 0, 0.0, 0, 2)]
    r = G.fit_cells(frame(spark, rows), ["rater"]).first()
    assert np.isfinite(r.beta).all() and r.beta[0] > 5


def test_penalised_refit(spark):
    rows = make(5, n_cases=5, raters=("r",), trials=(1, 3))
    r = G.interaction_weights(frame(spark, rows), ["rater"]).first()
    assert np.isfinite(r.raw_beta).all()


def test_design_from_summary(spark):
    runs = spark.createDataFrame([("a", "m", "choice_1"), ("a", "m", "choice_2"), ("b", "m", "REFUSAL")], "case_id string, rater string, parsed_choice string")
    tags = spark.createDataFrame([(c, a, i) for c in "ab" for i, a in enumerate(ATTRIBUTES, -1)], "case_id string, attribute string, delta int")
    d = G.design_matrix(SM.run_summary(runs), tags).collect()
    assert len(d) == 1 and tuple(d[0][x] for x in D) == (-1, 0, 1, 2) and d[0].p1 == 0.5 and d[0].n == 2


def test_many_draws_match_single_fits(spark, data):
    rows, design, cells = data
    copies = design.crossJoin(spark.range(30).withColumnRenamed("id", "b"))
    fits = G.fit_cells(G.design_cells(copies, ["rater", "b"]), ["rater", "b"])
    spread = fits.groupBy("rater").agg(*[(F.max(F.col("beta")[i]) - F.min(F.col("beta")[i])).alias(f"s{i}") for i in range(4)], F.count("*").alias("n"))
    for r in spread.collect():
        assert r.n == 30 and max(r.s0, r.s1, r.s2, r.s3) < 1e-10


def test_profiles_of_fits(data):
    _, _, cells = data
    p = P.value_profiles(G.fit_cells(cells, ["rater"]), 0.262).collect()
    assert all(sum(r.profile) == pytest.approx(1) for r in p)
