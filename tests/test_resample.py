import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstat.operators import glm as G
from panelstat.operators import profiles as P
from panelstat.operators import resample as RS
from panelstat.plans.positions import dense_position

from test_glm import SCHEMA, arrays, make, newton
from test_profiles import js


def u32(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def positions(spark):
    return dense_position(spark.range(40).select(F.concat(F.lit("c"), "id").alias("case_id")), "case_id").cache()


def draws_of(positions, n, seed, key="case_id"):
    pos = {r.pos: r[key] for r in positions.collect()}
    return [[pos[u32(seed, b, s) % len(pos)] for s in range(len(pos))] for b in range(n)]


def test_draws_are_what_the_generator_says(positions):
    want = draws_of(positions, 5, 9)
    got = {(r.b, r.case_id): r.weight for r in RS.bootstrap_draws(positions, 5, 9).collect()}
    assert got == {(b, c): w for b, d in enumerate(want) for c, w in zip(*np.unique(d, return_counts=True))}


def test_draws_do_not_depend_on_partitions(spark, positions):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(RS.bootstrap_draws(positions, 4, 1)) == key(RS.bootstrap_draws(positions.repartition(7), 4, 1))
    assert key(RS.bootstrap_draws(positions, 4, 1)) != key(RS.bootstrap_draws(positions, 4, 2))
    with pytest.raises(ValueError):
        RS.bootstrap_draws(positions, 0, 1)


def test_bootstrap_means(spark, positions):
    rng = np.random.default_rng(0)
    vals = {f"c{i}": float(rng.normal()) for i in range(0, 40, 2)}
    df = spark.createDataFrame([("r", 3, c, v) for c, v in vals.items()], "rater string, k int, case_id string, value double")
    got = {r.b: r["mean"] for r in RS.bootstrap_means(df, positions, ["rater", "k"], 6, 9).collect()}
    for b, d in enumerate(draws_of(positions, 6, 9)):
        assert got[b] == pytest.approx(np.mean([vals[c] for c in d if c in vals]))


def test_many_raters_on_one_case(spark, positions, monkeypatch):
    rows = [(f"r{j}", "c3", float(j)) for j in range(3000)] + [("r1", f"c{i}", 1.0) for i in range(10, 30)]
    df = spark.createDataFrame(rows, "rater string, case_id string, value double")
    once = {(r.rater, r.b): r["mean"] for r in RS.bootstrap_means(df, positions, ["rater"], 8, 9).collect()}
    monkeypatch.setattr(RS, "SUM_LIMIT", 500)  # the function is built here and carries the smaller limit along
    split = {(r.rater, r.b): r["mean"] for r in RS.bootstrap_means(df, positions, ["rater"], 8, 9, n_blocks=4).collect()}
    assert once.keys() == split.keys() and all(split[k] == pytest.approx(v) for k, v in once.items())
    drawn = {b for b, d in enumerate(draws_of(positions, 8, 9)) if "c3" in d}
    assert {b for r, b in once if r == "r7"} == drawn and once["r7", min(drawn)] == 7


def test_draw_without_data_is_absent(spark, positions):
    df = spark.createDataFrame([("r", "c0", 1.0)], "rater string, case_id string, value double")
    got = {r.b for r in RS.bootstrap_means(df, positions, ["rater"], 30, 9).collect()}
    assert got == {b for b, d in enumerate(draws_of(positions, 30, 9)) if "c0" in d} and len(got) < 30


def test_summary_and_difference(spark):
    s = spark.createDataFrame([(k, b, float(b * (1 if k == "a" else 2))) for k in "ab" for b in range(5)], "rater string, b int, v double")
    r = RS.summarise(s.filter("rater = 'a'"), ["rater"], "v", 90).first()
    assert (r["mean"], r.median, r.n_samples) == (2, 2, 5) and r.std == pytest.approx(np.std(range(5), ddof=1))
    assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.percentile(range(5), [5, 95])))
    d = RS.paired_difference(s, "rater", "a", "b", "v", [])
    assert sorted(x.difference for x in d.collect()) == [-4, -3, -2, -1, 0]
    assert RS.summarise(s.filter("b = 0"), ["rater"], "v").first().std is None


def test_bootstrap_weights(spark):
    rows = make(2, n_cases=40, raters=("r0",), trials=(4, 12))
    design = spark.createDataFrame(rows, SCHEMA)
    pos = dense_position(design, "case_id")
    fits = {r.b: r.beta for r in RS.bootstrap_weights(design, pos, 4, 11).collect()}
    X, c1, n = arrays(rows, "r0")
    at = {r[0]: i for i, r in enumerate(rows)}
    for b, d in enumerate(draws_of(pos, 4, 11)):
        w = np.bincount([at[c] for c in d], minlength=40)
        assert np.allclose(fits[b], newton(X, c1 * w, n * w)[0], atol=1e-7)


def test_bootstrap_weights_at_the_full_number(spark, monkeypatch):
    monkeypatch.setattr(RS, "SUM_LIMIT", 20_000)  # partial sums are handed on often
    rows = make(3, n_cases=30, raters=("r0", "r1"), trials=(4, 12))
    design = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pos = dense_position(design, "case_id")
    fits = {(r.rater, r.b): r.beta for r in RS.bootstrap_weights(design, pos, 1000, 11).collect()}
    assert len(fits) == 2000
    X, c1, n = arrays(rows, "r1")
    at = {r[0]: i for i, r in enumerate(x for x in rows if x[1] == "r1")}
    for b, d in enumerate(draws_of(pos, 1000, 11)):
        if b % 97 == 0:
            w = np.bincount([at[c] for c in d], minlength=30)
            assert np.allclose(fits["r1", b], newton(X, c1 * w, n * w)[0], atol=1e-6)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    prof = {f"{g}{i}": rng.dirichlet(np.ones(4)) for g, n in (("a", 6), ("b", 8)) for i in range(n)}
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in prof.items()], "rater string, profile array<double>")
    members = spark.createDataFrame([("A" if k[0] == "a" else "B", k) for k in prof] + [("B", "a0")], "group string, member string").cache()
    return prof, df.cache(), members


def mean_js(prof, ids):
    k = len(ids)
    return sum(js(prof[ids[i]], prof[ids[j]]) for i in range(k) for j in range(i)) / (k * (k - 1) / 2)


def test_bootstrap_mean_jsd(panel):
    prof, df, members = panel
    got = {r.b: r for r in RS.bootstrap_mean_jsd(df, members, ("A", "B"), 5, 3).collect()}
    for g, name in (("A", "mean_a"), ("B", "mean_b")):
        pos = dense_position(members.filter(F.col("group") == g), "member")
        for b, d in enumerate(draws_of(pos, 5, f"3|{g}", "member")):
            assert got[b][name] == pytest.approx(mean_js(prof, d))
    assert all(r.difference == pytest.approx(r.mean_a - r.mean_b) for r in got.values())


def test_too_small_a_group_fails(spark, panel):
    _, df, members = panel
    alone = members.filter("member = 'a1'").union(members.filter("group = 'B'"))
    with pytest.raises(Exception, match="two members"):
        RS.bootstrap_mean_jsd(df, alone, ("A", "B"), 2, 1).collect()


def test_permutation(panel):
    prof, df, members = panel
    pool = [("A", m) for m in sorted(prof) if m[0] == "a"] + [("B", m) for m in sorted(prof) if m[0] == "b"] + [("B", "a0")]
    null = {r.perm: r.statistic for r in RS.permutation_null_jsd(df, members, ("A", "B"), 20, 5).collect()}
    want = []
    for p in range(20):
        order = sorted(pool, key=lambda gm: (hashlib.md5(f"5|{p}|{gm[0]}|{gm[1]}".encode()).hexdigest(), gm))
        want.append(abs(mean_js(prof, [m for _, m in order[:6]]) - mean_js(prof, [m for _, m in order[6:]])))
    assert [null[p] for p in range(20)] == pytest.approx(want)
    r = RS.permutation_test_jsd(df, members, ("A", "B"), 20, 5).first()
    obs = abs(mean_js(prof, [m for g, m in pool if g == "A"]) - mean_js(prof, [m for g, m in pool if g == "B"]))
    assert r.observed_diff == pytest.approx(obs) and r.p_value == pytest.approx(np.mean(np.array(want) >= obs))
    plus = RS.permutation_test_jsd(df, members, ("A", "B"), 20, 5, add_one=True).first()
    assert plus.p_value == pytest.approx((round(r.p_value * 20) + 1) / 21)


def test_permutation_of_means(spark):
    rows = [("A", f"a{i}", "x", 0.1 * i) for i in range(5)] + [("B", f"b{i}", "x", 0.1 * i) for i in range(5)]
    rows += [("A", f"a{i}", "y", 1.0 + i * 1e-3) for i in range(5)] + [("B", f"b{i}", "y", i * 1e-3) for i in range(5)]
    df = spark.createDataFrame(rows, "group string, member string, attribute string, share double")
    got = {r.attribute: r for r in RS.permutation_test_means(df, ("A", "B"), 200, 1).collect()}
    assert got["x"].p_value == 1.0 and got["y"].p_value < 0.1 and got["y"].observed_diff == pytest.approx(1)


def test_panel_reference_against_direct_pooling(spark):
    rows = make(8, n_cases=30, raters=tuple(f"h{i}" for i in range(5)) + ("m",), trials=(6, 12))
    design = spark.createDataFrame(rows, SCHEMA)
    cells = G.design_cells(design, ["rater"]).cache()
    prof = P.value_profiles(G.fit_cells(cells, ["rater"]), 1.0).select("rater", "profile").cache()
    human = F.col("rater").startswith("h")
    panel = prof.filter(human).select(F.col("rater").alias("member"))
    ref = RS.panel_reference(cells.filter(human), prof.filter(human), panel, prof.filter("rater = 'm'"), 3, 7, 1.0)
    got = {(r.b, r.id): (r.jsd, r.copies) for r in ref.collect()}
    own = {r.rater: r.profile for r in prof.collect()}
    X = arrays(rows, "h0")[0]
    vote = {r: arrays(rows, r)[1:] for r in own}

    def consensus(ids):
        b = newton(X, sum(vote[i][0] for i in ids), sum(vote[i][1] for i in ids))[0]
        e = np.exp(b - b.max())
        return e / e.sum()

    pos = dense_position(panel, "member")
    n = 0
    for b, d in enumerate(draws_of(pos, 3, 7, "member")):
        assert got[b, "m"][0] == pytest.approx(js(own["m"], consensus(set(d))), abs=1e-9)
        for m in set(d):
            want = js(own[m], consensus(set(d) - {m}))
            assert got[b, m] == (pytest.approx(want, abs=1e-9), d.count(m))
            n += 1
    assert len(got) == n + 3


def test_calibration(spark):
    ref = spark.createDataFrame(
        [(0, "member", "x", 2, 0.1), (0, "member", "y", 1, 0.3), (1, "member", "x", 1, 0.2)] + [(b, "rater", "m", 1, 0.1 * b) for b in range(4)],
        "b int, kind string, id string, copies bigint, jsd double")
    obs = spark.createDataFrame([("m", 0.2)], "id string, jsd double")
    r = RS.calibration(ref, obs).first()
    assert r.p_value == pytest.approx(2 / 4) and r.ci_low == pytest.approx(np.percentile([0, 0.1, 0.2, 0.3], 2.5))
    assert RS.reference_cut(ref, 0.5).first().cut == pytest.approx(np.median([0.1, 0.1, 0.3, 0.2]))


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 1, 2, 4)], "v double")
    got = {r.bin: r.n for r in RS.histogram(df, "v", 4).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 1}
    assert {r.bin: r.n for r in RS.histogram(df.filter("v = 1"), "v", 4).collect()} == {0: 2}


def test_positions_of_ids_with_one_prefix(spark):
    from panelstat.plans.positions import case_positions

    ids = [f"case_{i * 7:05}" for i in range(3000)]
    df = spark.createDataFrame([(i,) for i in ids + ids[:10]], "case_id string").repartition(3)
    assert {r.case_id: (r.pos, r.n) for r in case_positions(df).collect()} == {x: (k, 3000) for k, x in enumerate(sorted(ids))}
    assert case_positions(df.limit(0)).count() == 0


def apart(x, trials, successes):
    """Whether some direction tells successes and failures apart, by all directions at right angles to a cell and between two of these."""
    rows = x[trials > 0][:, :2]
    share = (successes[trials > 0] / trials[trials > 0])
    normals = [v for a, b in rows.tolist() for v in ((-b, a), (b, -a)) if a or b]
    unit = sorted({round(float(np.arctan2(v[1], v[0])), 12) for v in normals})
    angles = unit + [(a + b) / 2 for a, b in zip(unit, unit[1:] + [unit[0] + 2 * np.pi])]
    for t in angles:
        z = rows @ np.array([np.cos(t), np.sin(t)])
        z[np.abs(z) < 1e-9] = 0
        if z.any() and (z[share == 1] >= 0).all() and (z[share == 0] <= 0).all() and not z[(share > 0) & (share < 1)].any():
            return True
    return False


def test_separated_draws_at_the_full_number(spark):
    """Few cases of two attributes: many draws are constant, completely or quasi-completely separated."""
    rng = np.random.default_rng(17)
    rows = []
    for i in range(9):
        d = rng.integers(-2, 3, 2)
        n = int(rng.integers(1, 4))
        rows.append((f"c{i}", "r", int(d[0]), int(d[1]), 0, 0, 0.0, int(rng.choice([0, n, n, rng.integers(0, n + 1)])), n))
    design = spark.createDataFrame(rows, SCHEMA)
    pos = dense_position(design, "case_id")
    got = {r.b: r for r in RS.bootstrap_weights(design, pos, 1000, 5).collect()}
    X, c1, n = arrays(rows, "r")
    at = {r[0]: i for i, r in enumerate(rows)}
    seen = {}
    for b, d in enumerate(draws_of(pos, 1000, 5)):
        w = np.bincount([at[c] for c in d], minlength=9)
        cells = np.unique(X, axis=0)
        trials = np.array([(n * w)[(X == c).all(axis=1)].sum() for c in cells])
        successes = np.array([(c1 * w)[(X == c).all(axis=1)].sum() for c in cells])
        if successes.sum() in (0, trials.sum()):
            want = "constant_outcome"
        elif not cells[trials > 0].any():
            want = "constant_design"
        else:
            want = "separated" if apart(cells, trials, successes) else "converged"
        assert got[b].status == want, (b, cells, trials, successes)
        if want == "converged":
            beta = np.array(got[b].beta)  # a maximum, and the least of all where the design leaves a choice
            assert np.abs(cells.T @ (successes - trials / (1 + np.exp(-cells @ beta)))).max() < 1e-6
            used = cells[trials > 0]
            assert np.allclose(np.linalg.pinv(used) @ used @ beta, beta, atol=1e-6)
        else:
            assert got[b].beta == [0.0] * 4
        seen[want] = seen.get(want, 0) + 1
    assert seen["separated"] > 50 and seen["converged"] > 50, seen


def test_many_cells_by_products_and_one_by_one(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(RS, "BLOCK", 64)
    for n, cases, items in ((5000, 40, 30), (300, 500, 2000), (0, 5, 5)):
        code, case, x = rng.integers(0, items, n), rng.integers(0, cases, n), rng.normal(size=n)
        w, local = rng.integers(0, 3, (cases, 7)).astype(float), rng.permutation(items)
        sums = np.zeros((2, items, 7))
        RS.add_products(sums, local, code, case, x, w)
        want = np.zeros((2, items, 7))
        for c, k, v in zip(code, case, x):
            want[0, local[c]] += v * w[k]
            want[1, local[c]] += w[k]
        assert np.allclose(sums, want)


def test_shared_cells_fit_as_single_fits():
    from panelstat.functions import irls

    rng = np.random.default_rng(2)
    for cells in (rng.integers(-2, 3, (30, 4)).astype(float), np.hstack([rng.integers(-2, 3, (30, 2)), np.zeros((30, 2))])):
        n = rng.integers(0, 9, (40, 30)).astype(float)
        s = np.floor(rng.random((40, 30)) * (n + 1))
        want = irls.fit(np.broadcast_to(cells, (40, 30, 4)), n, s)[0]
        for start in (None, want.mean(axis=0)):
            assert np.allclose(irls.fit_shared(cells, n, s, start), want, atol=1e-7)


def test_panels_at_the_full_number(spark):
    """10,000 draws of a panel of seven: every fit against one made by itself, and the draws' copies."""
    raters = tuple(f"h{i}" for i in range(7))
    rows = make(9, n_cases=25, raters=raters, trials=(4, 9))
    design = spark.createDataFrame(rows, SCHEMA)
    cells = G.design_cells(design, ["rater"])
    panel = design.select(F.col("rater").alias("member")).distinct()
    got = RS.panel_fits(cells, panel, 10_000, 3).collect()
    X = arrays(rows, "h0")[0]
    vote = {r: arrays(rows, r)[1:] for r in raters}
    fits = {}

    def fit(ids):
        if ids not in fits:
            fits[ids] = newton(X, sum(vote[i][0] for i in ids), sum(vote[i][1] for i in ids))[0]
        return fits[ids]

    draws = draws_of(dense_position(panel, "member"), 10_000, 3, "member")
    assert len(got) == sum(1 + (len(set(d)) if len(set(d)) > 1 else 0) for d in draws)
    for r in got:
        d = draws[r.b]
        assert r.copies == (1 if r.member is None else d.count(r.member))
        assert np.allclose(r.beta, fit(frozenset(d) - {r.member}), atol=1e-7)


def test_fits_without_light_members_are_steps():
    from panelstat.functions import irls

    rng = np.random.default_rng(4)
    cells = np.unique(rng.integers(-2, 3, (80, 4)), axis=0).astype(float)
    own_n = rng.integers(0, 2, (400, len(cells))) * rng.integers(1, 3, (400, len(cells))).astype(float)
    own_n[:3] *= [[500.0], [100.0], [0.0]]  # two that weigh much, one without votes
    own_s = np.floor(rng.random(own_n.shape) * (own_n + 1))
    n, s = own_n.sum(axis=0), own_s.sum(axis=0)
    who, at = np.nonzero(own_n)
    beta = irls.fit_shared(cells, n[None], s[None])[0]
    got, settled = irls.fit_without(cells, n, s, beta, who, at, own_n[who, at], own_s[who, at], 400)
    assert not settled[:2].any() and settled[2:].mean() > 0.9
    want = irls.fit(np.broadcast_to(cells, (400, *cells.shape)), n - own_n, s - own_s)[0]
    assert np.allclose(got[settled], want[settled], atol=1e-9, rtol=0) and np.abs(want - beta).max() > 1e-4
    apart = np.where(cells[:, 0] > 0, n, 0.0)  # outcomes told apart: nothing to step from
    assert not irls.fit_without(cells, n, apart, irls.fit_shared(cells, n[None], apart[None])[0], who, at, own_n[who, at], apart[at], 400)[1].any()


def test_panel_of_light_and_heavy_members(spark):
    from panelstat.functions import irls

    raters = tuple(f"h{i:02d}" for i in range(60))
    rows = make(5, n_cases=60, raters=raters, trials=(1, 3))
    rows = [(*r[:7], r[7] * (300 if r[1] == "h00" else 1), r[8] * (300 if r[1] == "h00" else 1)) for r in rows]
    design = spark.createDataFrame(rows, SCHEMA)
    panel = design.select(F.col("rater").alias("member")).distinct()
    fits = RS.panel_fits(G.design_cells(design, ["rater"]), panel, 40, 3, chunk=2)
    assert fits.rdd.getNumPartitions() > 20  # a chunk of draws a group, not all in one task
    X = arrays(rows, "h00")[0]
    vote = {r: arrays(rows, r)[1:] for r in raters}
    draws = draws_of(dense_position(panel, "member"), 40, 3, "member")
    got = fits.collect()
    assert len(got) == sum(1 + len(set(d)) for d in draws)
    pooled = [np.sum([vote[i] for i in set(draws[r.b]) - {r.member}], axis=0) for r in got]
    want = irls.fit_shared(X, np.array([p[1] for p in pooled], float), np.array([p[0] for p in pooled], float))
    assert np.allclose([r.beta for r in got], want, atol=1e-8)


@pytest.mark.parametrize("sizes", [(1, 40), (17, 24), (40, 1), (0, 5), (5, 0)])
def test_labels_are_the_smallest_hashes(spark, sizes):
    rows = [("a", f"m{i}") for i in range(sizes[0])] + [("b", f"m{i}") for i in range(sizes[1])] + [("other", "m0")]
    members = spark.createDataFrame(rows, "group string, member string")
    got = {}
    for r in RS._relabelled(members, ("a", "b"), 6, 3).collect():
        got.setdefault(r.perm, set()).add((r.group, r.member, r.first))
    for perm in range(6):
        pool = sorted((hashlib.md5(f"3|{perm}|{g}|{m}".encode()).hexdigest(), g, m) for g, m in rows if g != "other")
        assert got[perm] == {(g, m, i < sizes[0]) for i, (_, g, m) in enumerate(pool)}


def test_no_permutation_is_ordered_as_a_whole(spark):
    members = spark.createDataFrame([("a", "x"), ("b", "y")], "group string, member string")
    plan = RS._relabelled(members, ("a", "b"), 6, 3)._jdf.queryExecution().toString()
    assert "Window" not in plan


def _operators(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_draws_and_slots_are_no_rows(spark, positions):
    """Slots, and draws of an item before the result, were rows that were shuffled."""
    values = spark.createDataFrame([("r", f"c{i}", float(i)) for i in range(40)], "rater string, case_id string, value double")
    assert "Generate" not in _operators(RS.bootstrap_draws(positions, 4, 1))
    assert _operators(RS.bootstrap_means(values, positions, ["rater"], 4, 1)).count("Generate") == 1  # the result's


def test_draws_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(RS, "DRAW_BLOCK", 7)
    pos = dense_position(spark.range(40).select(F.concat(F.lit("c"), "id").alias("case_id")), "case_id").cache()
    got = {(r.b, r.case_id): r.weight for r in RS.bootstrap_draws(pos, 300, 9).collect()}
    assert got == {(b, c): w for b, d in enumerate(draws_of(pos, 300, 9)) for c, w in zip(*np.unique(d, return_counts=True))}


@pytest.mark.parametrize("sizes", [(3, 30), (30, 3), (20, 20)])
def test_null_of_sparse_and_dense_labels(spark, monkeypatch, sizes):
    """Labels reach the statistic as lists per position; before, positions times permutations were rows."""
    monkeypatch.setattr(RS, "PAIR_DRAWS", 7)
    rng = np.random.default_rng(1)
    prof = {f"{g}{i}": rng.dirichlet(np.ones(4)) for g, n in zip("ab", sizes) for i in range(n)}
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in prof.items()], "rater string, profile array<double>")
    members = spark.createDataFrame([(k[0].upper(), k) for k in prof], "group string, member string")
    null = RS.permutation_null_jsd(df, members, ("A", "B"), 30, 5)
    assert "Generate [explode(sequence(0, 29" not in _operators(null)
    got = {r.perm: r.statistic for r in null.collect()}
    for p in range(30):
        order = [m for _, _, m in sorted((hashlib.md5(f"5|{p}|{k[0].upper()}|{k}".encode()).hexdigest(), k[0], k) for k in prof)]
        assert got[p] == pytest.approx(abs(mean_js(prof, order[: sizes[0]]) - mean_js(prof, order[sizes[0] :])))


def test_labels_are_made_in_many_tasks(spark):
    """R9's members come out of a shuffle by the same keys; a repetition of it would leave one task."""
    members = spark.createDataFrame([("a", f"m{i}") for i in range(20)] + [("b", "y")], "group string, member string").distinct()
    lists, n_first, n_second = RS._first_group(members, ("a", "b"), 6, 3)
    assert (n_first, n_second) == (20, 1) and lists.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("level", [0.0, 0.05, 0.5, 0.95, 0.999, 1.0])
def test_cut_is_the_percentile_without_one_task_for_all_values(spark, level):
    """The percentile held every distinct value, 9.5 million at sf0.1, in one task."""
    rng = np.random.default_rng(3)
    for values in (rng.random(300) ** 4, np.round(rng.random(300), 1), np.full(9, 0.25), [0.2], [0.1, 0.3], [float("nan"), 0.5, float("inf"), 0.5, -0.25], []):
        rows = [(i % 7, "member", f"m{i}", int(rng.integers(1, 4)), float(x)) for i, x in enumerate(values)] + [(0, "member", "none", 2, None), (0, "rater", "r", 1, 0.9)]
        ref = spark.createDataFrame(rows, "b int, kind string, id string, copies bigint, jsd double")
        want = ref.filter("kind = 'member'").agg(F.percentile("jsd", F.lit(level), F.col("copies"))).first()[0]
        cut = RS.reference_cut(ref, level)
        got = cut.first()
        assert got.cut == (None if want is None else pytest.approx(want, rel=1e-12, nan_ok=True)) and got.n_values == sum(r[3] for r in rows[:-1])
        assert "percentile(" not in _operators(cut)


@pytest.mark.parametrize("alpha", [0.1, 1.0])
def test_sums_of_draws_by_factors_are_those_of_pairs(monkeypatch, alpha):
    """Every draw is summed without pairs; before, a member went to every block of pairs with all its draws."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    p = np.concatenate([rng.dirichlet(np.ones(4) * alpha, 300), np.eye(4), np.full((2, 4), 0.25)])
    a, f = P.factors(p)(0, len(p))
    want = P.divergences(p, p)
    assert f.shape[1] < 200 and np.abs(a[:, None] + a - f @ f.T - want).max() < 1.1e-11
    part = P.factors(p)(100, 150)
    assert np.allclose(part[1], f[100:150], atol=1e-9) and (part[0] == a[100:150]).all()
    order = rng.permutation(len(p))
    table = pa.table({"pos": order, "n": [len(p)] * len(p), "profile": list(p[order])})
    sums = {}
    for name, found in (("factors", P.factors), ("pairs", lambda p: None)):
        monkeypatch.setattr(P, "factors", found)
        for rows in (table, table.take(list(range(0, 306, 2)) + [0, 2])):  # all; some without a profile and two that come twice
            sums.setdefault(name, []).append(RS._draw_sums(40, "7|x", 30)((pa.scalar(1),), rows))
    for own, pairs, rows in zip(sums["factors"], sums["pairs"], (table, table.take(list(range(0, 306, 2)) + [0, 2]))):
        at = rows["pos"].to_numpy()
        assert own["b"].to_pylist() == list(range(30, 40)) == pairs["b"].to_pylist()
        for b, s, t in zip(own["b"].to_pylist(), own["s"].to_pylist(), pairs["s"].to_pylist()):
            w = np.bincount([u32("7|x", b, k) % len(p) for k in range(len(p))], minlength=len(p))[at].astype(float)
            assert s == pytest.approx(w @ want[np.ix_(at, at)] @ w / 2, rel=1e-9) == pytest.approx(t, rel=1e-9)


def test_no_member_goes_to_blocks_with_its_draws(panel):
    _, df, members = panel
    plan = _operators(RS.bootstrap_mean_jsd(df, members, ("A", "B"), 600, 3))
    assert "_lo" not in plan and "draws" not in plan


def test_factors_that_do_not_end_are_none(monkeypatch):
    p = np.random.default_rng(2).dirichlet(np.ones(4), 200)
    assert P.factors(np.where(p == p[0, 0], np.nan, p)) is None
    monkeypatch.setattr(P, "FACTORS", 20)
    assert P.factors(p) is None


def test_digests_are_those_of_hashlib():
    from panelstat.functions import digests

    heads = [b"x" * size + b"%d|" % b for size in (0, 3, 41, 53, 60) for b in (0, 7, 12, 345)]
    assert (digests.numbered(heads, 1200) == [[int(hashlib.md5(h + b"%d" % k).hexdigest()[:8], 16) for k in range(1200)] for h in heads]).all()
    tails, seen = [("ä" * k).encode() for k in range(40)], 0
    for at, where, high, low in digests.digests(heads, tails):
        for i, j in np.ndindex(high.shape):
            assert f"{int(high[i, j]):016x}{int(low[i, j]):016x}" == hashlib.md5(heads[at[i]] + tails[where[j]]).hexdigest()
        seen += high.size
    assert seen == len(heads) * len(tails)


@pytest.mark.parametrize("n", [1, 4, 5, 1001])
def test_packed_counts(n):
    import pyarrow as pa

    from panelstat.plans import counts

    rng = np.random.default_rng(n)
    for most in (1, 18, 19, 100_000):
        c = rng.poisson(1.2, (50, n))
        c[7, 0], c[-1, -1] = most, 3
        packed = pa.chunked_array([pa.array([b"other", *counts.pack(c)], pa.binary())[1:], pa.array([], pa.binary())])
        assert (counts.unpack(packed, n) == c).all() and counts.unpack(packed.slice(0, 0), n).shape == (0, n)
    assert n < 1000 or sum(map(len, counts.pack(rng.poisson(1, (50, n))))) < 0.31 * 50 * n  # an array of draws takes four bytes each


def test_draws_travel_packed(spark, positions):
    """A draw of an item took four bytes and more."""
    out = RS._with_draws(positions, 1000, 9, "case_id")
    rows = out.collect()
    assert out.schema["draws"].dataType.simpleString() == "binary" and sum(len(r.draws) for r in rows) < 0.35 * 40_000


def test_raters_of_few_and_many_cases_are_fitted_alike(spark, monkeypatch):
    """Few cases go on with their draws, many are summed; the sums of every cell and draw were shuffled for each rater."""
    rows = make(4, n_cases=30, raters=("r0", "r1"), trials=(4, 12))
    rows = [r for i, r in enumerate(rows) if r[1] == "r0" or i % 5 == 0] + [(*r[:1], None, *r[2:]) for r in rows if r[1] == "r0"]
    design = spark.createDataFrame(rows, SCHEMA)
    pos = dense_position(design, "case_id")
    fits = lambda: {(r.rater, r.b): (r.status, r.beta) for r in RS.bootstrap_weights(design, pos, 60, 11).collect()}
    got = {}
    for few in (1, 12, 1000):
        monkeypatch.setattr(RS, "FEW", few)
        got[few] = fits()
    assert got[1].keys() == got[12].keys() == got[1000].keys() and {r for r, _ in got[1]} == {"r0", "r1", None}
    for k, (status, beta) in got[1].items():
        assert {got[few][k][0] for few in got} == {status} and np.allclose([got[12][k][1], got[1000][k][1]], beta, atol=1e-7)
        assert k[0] != "r0" or np.allclose(got[1][None, k[1]][1], beta, atol=1e-7)


def test_panel_fits_come_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    cells = np.array([[1.0, 0], [0, 1], [-1, 1]])
    table = pa.table({"member": [f"m{i}" for i in range(6) for _ in cells], "pos": np.repeat(np.arange(6), 3), "cell": [c.tolist() for _ in range(6) for c in cells], "trials": [4.0] * 18, "successes": [1.0, 2.0, 3.0] * 6})
    monkeypatch.setattr(RS, "PANEL_LINES", 20)
    parts = list(RS._panel_fits(40, 3, 40, 2)((pa.scalar(0),), iter(table.to_batches())))
    assert len(parts) > 5 and max(p.num_rows for p in parts) < 60
    monkeypatch.setattr(RS, "PANEL_LINES", 10_000)
    (whole,) = RS._panel_fits(40, 3, 40, 2)((pa.scalar(0),), iter(table.to_batches()))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([whole]))


def test_sums_are_handed_on_in_two_bytes_or_whole():
    import pyarrow as pa

    for sums in ([0.0, 3, 65535], [1.5, 2], [65536.0, 1], [-1.0, 2], [np.inf, 1], [np.nan, 1]):
        data = RS._short(np.array(sums))
        assert np.array_equal(RS._long(pa.py_buffer(data), len(sums)), sums, equal_nan=True)
    assert len(RS._short(np.arange(1000.0))) == 2000
