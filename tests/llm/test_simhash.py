import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelstat.llm import simhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_as_brute_force(docs, clashing, rows):
    fp = {r: fingerprint(r[1]) for r in rows}
    root = brute_components(fp.values())
    least = {}
    for r in rows:
        least[root[fp[r]]] = min(least.get(root[fp[r]], 1 << 62), r[0])
    want = sorted((r[0], f"{fp[r]:016x}", least[root[fp[r]]]) for r in rows)
    for d in (docs, clashing):
        assert sorted(tuple(r)[:3] for r in simhash.near_duplicates(d).collect()) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("aé b c"))).first()[0] & (2**64 - 1) == int(simhash.shingle_hashes("Aé b\tC", 3)[0])


@pytest.mark.parametrize("radius, blanks", [(3, 3), (3, 2), (2, 1), (1, 4), (5, 4), (0, 1)])
def test_all_pairs_once(spark, radius, blanks):
    rnd = random.Random(radius)
    seeds = [0, (1 << 64) - 1, 1 << 63] + [rnd.getrandbits(64) for _ in range(3)]
    fps = sorted({s ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))}) for s in seeds for _ in range(12)} | {1 << b for b in range(60, 64)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    pairs = simhash.close_pairs(spark.createDataFrame([(s,) for s in signed], "fp long"), radius, blanks).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert sorted(tuple(p) for p in pairs) == sorted(want)


def test_empty_and_null_ids(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    out = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, "q")], "doc_id long, text string")).collect()
    assert {(r[0], r[2]) for r in out} == {(None, 7), (7, 7), (None, None)}


def test_long_chain(spark):
    from panelstat.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 2000), (2000, 1000), (5, 5)], "a long, b long")
    out = {r[0]: r[1] for r in components(edges).collect()}
    assert out == {**{i: 0 for i in range(301)}, 1000: 1000, 2000: 1000}
