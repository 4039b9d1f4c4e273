import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstat.llm import vptree

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dim=6, seed=0):
    rnd = random.Random(seed)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(dim)], 0) for i in range(n)]
    same = rows[0][1]
    rows += [(n + i, list(same), 1) for i in range(60)]
    rows += [(1000, None, 0), (1001, [0.0] * dim, 0), (1002, [1.0] * (dim - 1) + [None], 0), (1003, [math.nan] * dim, 0), (1004, [math.inf] * dim, 0), (1005, [], 0), (None, same, 0), (1100, [1.0, 2.0], 0), (rows[5][0], list(rows[5][1]), 0)]
    return rows


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def brute(rows, k=10):
    ok = [r[:2] for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    out = []
    for a, (q, own) in enumerate(ok):
        if q % 20:
            continue
        near = sorted((distance(v, own), i) for b, (i, v) in enumerate(ok) if a != b and len(v) == len(own))
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return sorted(out)


def test_rows_of_one_id(spark):
    """Each is a candidate for the other, and each query has its own answer."""
    rows = [(20, [1.0, 0.0], 0), (20, [5.0, 0.0], 0), (20, [5.0, 0.0], 0), (21, [2.0, 0.0], 0)]
    got = vptree.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2) and len(got) == 6 and min(r["score"] for r in got) == 0


@pytest.mark.parametrize("shard_rows, block_rows", [(1000, 1000), (70, 5)])
def test_as_brute_force(spark, shard_rows, block_rows):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("shard", F.lit(1))
    got = vptree.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows, block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_few_and_none(spark):
    few = spark.createDataFrame(vectors(3, 2)[:3], SCHEMA)
    assert vptree.nearest(few, F.col("vec_id") == 0).count() == 2
    assert vptree.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_factor_trades_recall_for_work():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 8)) * 4
    x = centres[rnd.integers(40, size=6000)] + rnd.normal(size=(6000, 8))
    ids = np.arange(6000)
    work, found = {}, {}
    for factor in (1.0, 1.5, 3.0):
        tree = vptree.VPTree(x, ids, 32)
        got, _ = tree.nearest(x[:200], ids[:200], 10, factor)
        work[factor], found[factor] = tree.seen, got
    hits = lambda f: np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found[f], found[1.0])])
    assert work[1.0] < 200 * 6000 * 0.9 and work[3.0] < work[1.5] < work[1.0]
    assert 0.9 <= hits(1.5) and hits(3.0) <= hits(1.5)
