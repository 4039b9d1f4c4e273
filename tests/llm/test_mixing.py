import random
from collections import Counter, defaultdict

import pytest

from panelstat.llm import mixing


def brute_targets(sizes):
    """Shares by weight; what is over the cap is given to the others by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    rest, target, full = float(sum(sizes.values())), dict.fromkeys(names, 0.0), set()
    while rest > 1e-9 and len(full) < len(names):
        total = sum(weight[s] for s in names if s not in full)
        share = {s: rest * weight[s] / total for s in names if s not in full}
        rest = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {rnd.choice(["a", "B", "ü", "z", None, "m", "n", "😀"]) if k < 8 else f"s{k}": rnd.choice([0, 1, 5, 100, 5000]) for k in range(14)}
    sizes["hot"] = 3000
    got = {r[0]: (r[1], r[2]) for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert {s: v[0] for s, v in got.items()} == sizes
    for s in want:
        assert got[s][1] == pytest.approx(want[s], rel=1e-9, abs=1e-6)


def corpus(spark, n=3000, seed=5):
    rnd = random.Random(seed)
    rows = [(i, "w " * (40 if i % 2 else rnd.choice([1, 10, 30, 80, 300])), "x", "hot" if i % 3 else rnd.choice(["a", "B", None, "ü", "c"]), 0) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, None, "a", 0), (n + 1, "", None, "only empty", 0)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_sources_come_near_their_targets(spark):
    docs = corpus(spark)
    out = [r.asDict() for r in mixing.mix(docs, rows_per_window=50).collect()]
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(40, 0.01 * want[s]), s
    # tilted by size: within a source the rate goes one way along the sizes
    by = defaultdict(dict)
    for r in out:
        by[r["source"]][r["size"]] = r["rate"]
    for rates in by.values():
        along = [rates[z] for z in sorted(rates) if z]
        assert along in (sorted(along), sorted(along, reverse=True))
    again = mixing.mix(docs.repartition(7), rows_per_window=50).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(docs, rows_per_window=50).collect())


def test_dual_is_solved(spark):
    hist = spark.createDataFrame([(s, z, n) for s in ("a", "b") for z, n in ((1, 500), (10, 100), (100, 30), (1000, 2))], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 6500, 900.0), ("b", 6500, 17000.0)], "source string, source_size long, target double")
    import math
    for r in mixing.tilt(hist, targets).collect():
        got = sum(n * z * min(3, math.exp(r["lam"] * z / r["mean_size"])) for z, n in ((1, 500), (10, 100), (100, 30), (1000, 2)))
        assert got == pytest.approx({"a": 900, "b": 17000}[r["source"]], rel=1e-6)


def test_rows_edges(spark, docs, clashing, no_docs, rows):
    out = mixing.mix(docs)
    assert out.count() == len(rows)
    mixed = mixing.mix_rows(clashing)
    assert mixed.columns == clashing.columns
    want = sum(r["copies"] for r in out.collect())
    assert abs(mixed.count() - want) <= 3
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 9  # three equal rows, three copies each
    assert mixing.mix(no_docs).count() == 0 and mixing.mix_rows(no_docs).count() == 0


def test_native_plan(spark, docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
