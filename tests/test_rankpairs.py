import itertools
import math

import numpy as np
import pytest

from panelstat.functions import tails
from panelstat.operators import rankpairs as RP


def tau(x, y):
    s = nx = ny = 0
    for i in range(len(x)):
        a, b = np.sign(x[i] - x[:i]), np.sign(y[i] - y[:i])
        s, nx, ny = s + (a * b).sum(), nx + abs(a).sum(), ny + abs(b).sum()
    return s / math.sqrt(nx * ny) if nx * ny else None


def frame(spark, groups):
    rows = [(g, None if a is None else float(a), None if b is None else float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "k string, x double, y double")


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        rank, w = rng.permutation(n), rng.integers(1, 5, n)
        want = sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if rank[i] > rank[j])
        assert RP.inversions(rank, w) == want


@pytest.mark.parametrize("n_blocks", [None, 4, 31])
def test_tau_is_that_of_all_pairs(spark, n_blocks):
    """Without ties, with many, with a value that a third share, opposite and equal orders; the same for any blocks."""
    rng = np.random.default_rng(2)
    n = 150
    x = rng.normal(size=n)
    hot = np.where(np.arange(n) < 50, 0.0, x)
    groups = {
        "plain": (x, x + rng.normal(size=n)), "ties": (rng.integers(0, 6, n), rng.integers(0, 6, n)), "hot": (hot, rng.integers(0, 40, n)),
        "same": (x, x), "against": (x, -x), "copies": (np.repeat([1, 2], 75), np.repeat([2, 1], 75)),
    }
    got = {r.k: r for r in RP.kendall_tau(frame(spark, groups), ["k"], "x", "y", n_blocks).collect()}
    for k, (a, b) in groups.items():
        assert got[k].tau == pytest.approx(tau(np.asarray(a, float), np.asarray(b, float)), abs=1e-12), k
        assert (got[k].n, got[k].n_pairs) == (n, n * (n - 1) // 2)


def test_exact_p_against_every_order(spark):
    base = list(range(6))
    every = []
    for order in itertools.permutations(base):
        every.append(round(tau(np.array(base), np.array(order)) * 15))
    order = [0, 2, 1, 3, 5, 4]
    got = RP.kendall_tau(frame(spark, {"a": (base, order)}), ["k"], "x", "y").first()
    s = round(got.tau * 15)
    assert got.p == pytest.approx(sum(abs(v) >= abs(s) for v in every) / len(every))


def test_normal_p_with_ties():
    """The variance of S over all orders of y is the formula's."""
    x, y = np.array([1.0, 1, 2, 3, 3, 3]), np.array([1.0, 2, 2, 2, 4, 5])
    s_of = lambda b: sum(np.sign(x[i] - x[j]) * np.sign(b[i] - b[j]) for i in range(6) for j in range(i))
    spread = np.sqrt(np.mean([s_of(np.array(p)) ** 2 for p in itertools.permutations(y)]))
    sums = lambda t: (sum(k * (k - 1) / 2 for k in t), sum(k * (k - 1) * (k - 2) for k in t), sum(k * (k - 1) * (2 * k + 5) for k in t))
    (tx, x0, x1), (ty, y0, y1) = sums([2, 1, 3]), sums([1, 3, 1, 1])
    p = tails.rank_correlation_p(6, 0, s_of(y), tx, ty, x0, y0, x1, y1)
    assert p == pytest.approx(math.erfc(abs(s_of(y)) / spread / math.sqrt(2)))


def test_odd_groups(spark):
    nan = float("nan")
    df = frame(spark, {"one": ([1], [2]), "flat": ([1, 1, 1], [1, 2, 3]), "gaps": ([1, None, 2, nan], [1, 5, 2, 9]), "zeros": ([0.0, -0.0, 1], [1, 2, 3])})
    got = {r.k: (r.tau, r.p, r.n) for r in RP.kendall_tau(df, ["k"], "x", "y").collect()}
    assert got["one"] == (None, None, 1) and got["flat"] == (None, None, 3) and got["gaps"] == (1.0, 1.0, 2)
    assert got["zeros"][0] == pytest.approx(2 / math.sqrt(6))
    assert RP.kendall_tau(df.limit(0), ["k"], "x", "y").count() == 0


def test_no_pair_rows(spark):
    plan = RP.kendall_tau(frame(spark, {"a": ([1, 2], [2, 1])}), ["k"], "x", "y", 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
