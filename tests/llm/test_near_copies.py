import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelstat.llm import simhash


def test_forest_joins_what_the_edges_join():
    rnd = np.random.default_rng(0)
    forest = simhash._Forest(200)
    a, b = rnd.integers(0, 200, 300), rnd.integers(0, 200, 300)
    for k in range(0, 300, 50):
        forest.add(a[k:k + 50], b[k:k + 50])
    whole = simhash._Forest(200)
    whole.add(a, b)
    assert len(forest.edges) == len(whole.edges) and len(set(forest.label)) == 200 - len(forest.edges) == len(set(whole.label))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40), st.sampled_from([2, 3, 16]), st.sampled_from([64, 4096]))
def test_common_members_as_brute_force(seed, n, often, columns):
    rnd = np.random.default_rng(seed)
    common = rnd.integers(-(2**62), 2**62, 90)
    sets = [np.unique(np.concatenate([rnd.choice(common, rnd.integers(0, 80)), rnd.integers(0, 60, rnd.integers(0, 9))])) for _ in range(n)]
    got = simhash.shared(sets, often, columns)
    for i in range(n):
        for j in range(i + 1, n):
            assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_forest_of_alike_sets(share):
    rnd = np.random.default_rng(4)
    base = [np.arange(k * 1000, k * 1000 + 40) for k in range(4)]
    sets = [np.unique(np.where(rnd.random(40) < rnd.choice([0, 0.05, 0.2]), rnd.integers(10**6, 10**9, 40), base[rnd.integers(4)])) for _ in range(80)]
    root = list(range(80))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(80):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n >= share * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                root[find(i)] = find(j)
    edges = simhash.alike_forest(sets, share)
    forest = simhash._Forest(80)
    forest.add(*np.array(edges).reshape(-1, 2).T)
    assert len(edges) == len(forest.edges) == 80 - len({find(i) for i in range(80)})
    assert all(find(a) == find(b) for a, b in edges)
