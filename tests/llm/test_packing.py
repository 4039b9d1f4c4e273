import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelstat.llm import packing


def brute(sizes, sources, clusters, capacity, share):
    """Every bin is tried for every piece."""
    bins, out = [], []
    for z, s, c in zip(sizes, sources, clusters):
        ok = [i for i, b in enumerate(bins) if b["room"] >= z and b["room"] > 0 and not (c is not None and c in b["c"]) and not (s in b["w"] and b["w"][s] >= share * capacity)]
        i = min(ok, key=lambda i: (bins[i]["room"], i), default=None)
        if i is None:
            bins.append({"room": capacity, "c": set(), "w": Counter()})
            i = len(bins) - 1
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= z
        bins[i]["c"].add(c)
        bins[i]["w"][s] += z
    return out


@pytest.mark.parametrize("share", [0, 0.3, 0.5, 1])
def test_best_fit_as_brute_force(share):
    rnd = random.Random(3)
    for _ in range(30):
        n = rnd.randint(0, 80)
        args = [rnd.randint(0, 40) for _ in range(n)], [rnd.choice("aab") for _ in range(n)], [rnd.choice([None, 1, 1, 2]) for _ in range(n)], 50, share
        assert packing.best_fit(*args) == brute(*args)


def check(out, docs, capacity, share):
    rows = [r.asDict() for r in out.collect()]
    words = {}
    for r in docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).collect():
        words[r[0]] = words.get(r[0], 0) + r[1]
    got, bins = Counter(), defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["words"]
        bins[r["bin_id"]].append(r)
    assert dict(got) == words
    for b in bins.values():
        assert sum(r["words"] for r in b) == b[0]["bin_words"] <= capacity
        at = 0
        for r in sorted(b, key=lambda r: (r["bin_offset"], r["bin_offset"] + r["words"])):
            assert r["bin_offset"] == at
            at += r["words"]
        assert max(Counter(r["cluster"] for r in b).values()) == 1
        for s in {r["source"] for r in b}:
            own = sorted((r["bin_offset"], r["words"]) for r in b if r["source"] == s)
            assert sum(w for _, w in own[:-1]) < max(1, share * capacity)
    return rows


@pytest.mark.parametrize("capacity, group_rows", [(100, 4096), (2048, 7)])
def test_bins_hold(docs, clashing, capacity, group_rows):
    a = check(packing.pack(docs, capacity, group_rows=group_rows), docs, capacity, 0.5)
    b = check(packing.pack(clashing, capacity, group_rows=group_rows), clashing, capacity, 0.5)
    assert len(a) == len(b)


def test_hot_cluster_and_source(spark):
    docs = spark.createDataFrame([(i, "w " * 10 if i % 3 == 0 else f"x{i} " * (i % 20), None, "hot" if i % 3 else "b", 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = check(packing.pack(docs, 200, group_rows=100), docs, 200, 0.5)
    assert len({r["bin_id"] for r in rows if r["cluster"] == rows[0]["cluster"]}) == sum(r["cluster"] == rows[0]["cluster"] for r in rows)


def test_empty(no_docs):
    assert packing.pack(no_docs).count() == 0
