import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelstat.llm import negatives as N

ROWS = "vec_id long, embedding array<float>, label int"
NULL = (True, 0)


def made(seed, n=240, dims=6):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        c = rnd.choice(centres)
        out.append((i, [round(x + rnd.gauss(0, 0.5), 1) for x in c], rnd.randint(0, 3)))
    hot = out[7][1]
    out += [(n + i, hot, i % 3) for i in range(n // 2)]  # one vector in a third of all rows
    out += [(20, [1.0] * dims, 1), (20, [1.0] * dims, 1), (20, [0.5] * dims, 2), (None, [1.0] * dims, 1), (None, [0.9] * dims, 2)]
    out += [(40, [1.0, 2.0], 1), (41, [1.5, 2.0], 1), (42, [1.0, 1.0], 2), (60, [], 1), (61, [], 1), (62, [], 2), (80, [0.0] * dims, 3)]
    out += [(100, None, 1), (120, [1.0] * dims, None), (140, [1.0, None] + [1.0] * (dims - 2), 1), (160, [math.nan] * dims, 1), (180, [math.inf] * dims, 1)]
    rnd.shuffle(out)
    return out


def brute(rows, modulo, relabel=lambda i, l: l, k=5, m=10, scale=256):
    own = [(i, relabel(i, l), [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, l, q) in enumerate(own):
        if i is None or i % modulo:
            continue
        scored = [(sum(x * y for x, y in zip(q, r)), j, lj == l) for b, (j, lj, r) in enumerate(own) if b != a and len(r) == len(q)]
        for p, j, _ in sorted((s for s in scored if s[2]), key=order)[:k]:
            fits = sorted((s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:m]
            out += [(i, j, r, s[1], p, s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("block_rows,run_rows,group", [(8, 40, 4), (64, 1000, 1000), (1, 500, 3)])
def test_as_brute_force(spark, block_rows, run_rows, group):
    rows = made(block_rows)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    want = brute(rows, 20)
    assert len(want) > 300 and any(r[1] is None or r[3] is None for r in want)
    assert got(N.mine(df, 20, block_rows=block_rows, run_rows=run_rows, group=group)) == want


def test_relabelled_and_clashing_names(spark):
    rows = made(9)
    df = spark.createDataFrame(rows, ROWS)
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    clash = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["x", "q", "block", "run", "rank", "dims", "_place", "grp", "salt"])])
    want = brute(rows, 10, lambda i, l: (l + 1) % 10 if i is not None and i % 7 == 0 else l)
    assert got(N.mine(clash, 10, relabel=relabel, block_rows=16, run_rows=100)) == want


def test_empty_and_alone(spark):
    assert got(N.mine(spark.createDataFrame([], ROWS))) == []
    assert got(N.mine(spark.createDataFrame([(0, [1.0], 1)], ROWS))) == []
    assert got(N.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], ROWS))) == []


def test_large_components_are_exact(spark):
    rows = [(0, [3.0e6, 1.0], 1), (1, [2.0e6, 5.0], 1), (2, [1.0e6, 7.0], 2), (3, [1.0e6, 7.00390625], 2), (4, [4.0e5, 0.0], 2)]
    assert got(N.mine(spark.createDataFrame(rows, ROWS), 100)) == brute(rows, 100)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 3))
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(np.unravel_index(np.arange(1 << dims * bits), (1 << bits,) * dims)).T
    places = [int.from_bytes(p.tobytes(), "big") >> (-dims * bits % 8) for p in N.hilbert(cells, bits)]
    path = cells[np.argsort(places)]
    assert sorted(places) == list(range(len(cells)))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([5, 1000, 2**30]))
def test_bounds_hold(seed, size):
    rnd = np.random.default_rng(seed)
    box, a = rnd.integers(-size, size, (20, 5)), rnd.integers(-size, size, (7, 5))
    least, most = N.bounds(a, box.min(0)[None], box.max(0)[None])
    exact = a.astype(object) @ box.T.astype(object)
    assert (N.product(a, box) == exact).all()
    assert (least[:, 0] <= exact.min(axis=1)).all() and (exact.max(axis=1) <= most[:, 0]).all()


def test_zone_maps_choose(spark):
    """Blocks of far clusters are not read."""
    rnd = random.Random(2)
    centres = [[10.0 * (k == i) for k in range(8)] for i in range(8)]
    rows = [(i, [x + rnd.gauss(0, 0.1) for x in centres[i % 8]], rnd.randint(0, 1)) for i in range(1600)]
    df = spark.createDataFrame(rows, ROWS)
    blocks, runs = N.write_blocks(N.quantised(df), 25, 200)
    anchors = blocks.drop("run").mapInArrow(N._anchors(100, 5, 8), N.ANCHORS)
    g, z = [N._Group(r.asDict()) for r in anchors.collect()], [r.asDict() for r in blocks.collect()]
    wanted = [N._wanted(x, N._zones(z), 30, 90, None)[0] for x in g]
    assert sum(w.sum() for w in wanted) < 0.4 * sum(w.size for w in wanted)
    assert got(N.mine(df, block_rows=25, run_rows=200, group=8)) == brute(rows, 100)
