import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstat.operators import similarity as SIM
from panelstat.operators import lsh
from panelstat.operators.lsh import all_meet, band_plan, near_duplicates_lsh

SCHEMA = "case_id string, embedding array<double>, rep string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], "x") for k, v in vectors], SCHEMA)


def rows(df):
    return {r.id: (r.nearest_id, round(r.similarity, 9), r.n_similar) for r in df.collect()}


def families(n, near, seed, dims=32):
    """Unrelated vectors, and beside each one at a cosine of ``near``."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b = rng.normal(size=dims), rng.normal(size=dims)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        out += [(f"a{i:04}", a), (f"b{i:04}", near * a + math.sqrt(1 - near * near) * b)]
    return out


def test_plan():
    bits, bands = band_plan(10**6, 0.8, 0.95)
    p = (1 - math.acos(0.8) / math.pi) ** bits
    assert bits == 13 and 1 - (1 - p) ** bands >= 0.95 > 1 - (1 - p) ** (bands - 1)
    assert band_plan(10, 1.0, 0.95)[1] == 1


def test_recall_and_exact_hits(spark):
    """At 0.80001, the least likely pairs, at least 0.9 of the exact join; no hit that it lacks, and equal values."""
    df = frame(spark, families(600, 0.80001, 3))
    exact, got = rows(SIM.near_duplicates(df, 0.8)), rows(near_duplicates_lsh(df, 0.8, bits=8))
    assert len(exact) >= 1200 and set(got) <= set(exact)
    assert sum(got.get(k) == v for k, v in exact.items()) >= 0.9 * len(exact)


def test_closer_pairs_are_nearly_all_found(spark):
    df = frame(spark, families(300, 0.95, 4))
    exact, got = rows(SIM.near_duplicates(df, 0.8)), rows(near_duplicates_lsh(df, 0.8))
    assert sum(got.get(k) == v for k, v in exact.items()) >= 0.995 * len(exact)


@pytest.mark.parametrize("bucket_rows", [7, 4096])
def test_hot_buckets_are_split_and_whole(spark, bucket_rows):
    """A third are copies, a third one family of different texts: as the exact join, however small the blocks."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    vectors = [(f"c{i:03}", base) for i in range(60)] + [(f"f{i:03}", base + 0.05 * rng.normal(size=16)) for i in range(60)]
    vectors += [(f"r{i:03}", rng.normal(size=16)) for i in range(60)]
    df = frame(spark, vectors)
    got = rows(near_duplicates_lsh(df, 0.8, bits=2, bands=24, bucket_rows=bucket_rows))
    assert got == rows(SIM.near_duplicates(df, 0.8))


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    odd = [("n", None), ("z", [0.0] * 3), ("i", [float("inf"), 0.0, 0.0]), ("q", [float("nan"), 0.0, 0.0])]
    df = frame(spark, [("a", v), ("a", v), ("b", v), ("d", [2.0, 4.0, 6.0]), ("far", [-1.0, 0.0, 0.0]), (None, v), *odd])
    assert rows(near_duplicates_lsh(df)) == {"a": ("b", 1.0, 2), "b": ("a", 1.0, 2), "d": ("a", 1.0, 2)}
    assert near_duplicates_lsh(df.filter(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        near_duplicates_lsh(df, 0.0)


def test_a_band_shuffles_rows_not_pairs(spark):
    plan = near_duplicates_lsh(frame(spark, families(20, 0.9, 6)))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_low_thresholds_send_no_vector_to_every_band(spark, monkeypatch):
    """At 0.35 each vector went to 394 bands, its 394 values beside it, on 100,000 vectors; now to 7 blocks, for the same rows."""
    bits, bands = band_plan(100_000, 0.35, 0.95)
    assert bands > 300 and all_meet(100_000, bits, bands) and not all_meet(10**6, *band_plan(10**6, 0.8, 0.95))
    df = frame(spark, families(400, 0.5, 7, dims=16) + [("copy1", [1.0] * 16), ("copy2", [1.0] * 16), ("zero1", [0.0] * 16), ("zero2", [0.0] * 16), ("nan1", [math.nan] * 16), ("nan2", [math.nan] * 16)])
    bits, bands = band_plan(802, 0.35, 0.95)
    by_bands = near_duplicates_lsh(df, 0.35, bits=bits, bands=bands)
    sent = near_duplicates_lsh(df, 0.35)
    assert "bands" in by_bands._jdf.queryExecution().toString() and "bands" not in sent._jdf.queryExecution().toString()
    expected = rows(by_bands)
    assert rows(sent) == expected and len(expected) > 700
    monkeypatch.setattr(lsh, "_BLOCK_NUMBERS", 0)
    monkeypatch.setattr(lsh, "_BLOCK_ROWS", 100)
    assert rows(near_duplicates_lsh(df, 0.35)) == expected
