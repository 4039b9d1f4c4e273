import random

import pytest

from panelstat.llm import simhash


def shingles(words):
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def changed(rnd, words, kind, n):
    """``n`` words at one place appended, cut off or replaced, or single words replaced here and there."""
    fresh = [f"x{rnd.randrange(10**6)}" for _ in range(n)]
    if kind == "appended":
        return words + fresh
    if kind == "cut":
        return words[:-n]
    if kind == "replaced":
        at = rnd.randrange(len(words) - n)
        return words[:at] + fresh + words[at + n:]
    places = set(rnd.sample(range(len(words)), n))
    return [f"y{rnd.randrange(10**6)}" if i in places else w for i, w in enumerate(words)]


def pairs(low, high, each=40, seed=3):
    """Texts and changed ones by kind, their likeness between low and high."""
    rnd, out = random.Random(seed), []
    for kind in ("scattered", "replaced", "appended", "cut"):
        n = 0
        while n < each:
            words = [f"u{int(rnd.paretovariate(0.7)) % 9000}" for _ in range(rnd.randint(150, 500))]
            other = changed(rnd, words, kind, rnd.randint(1, len(words) // 3))
            if low <= likeness(words, other) < high:
                out.append((kind, words, other))
                n += 1
    return out


def linked(spark, made):
    rows = [(i, " ".join(a)) for i, (_, a, _) in enumerate(made)] + [(10**6 + i, " ".join(b)) for i, (_, _, b) in enumerate(made)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.alike(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    return [got[10**6 + i] == i for i in range(len(made))]


def test_edits_in_one_place_are_found(spark):
    made = pairs(0.8, 0.9)
    assert all(linked(spark, made))


def test_less_alike_texts_stay_apart(spark):
    made = pairs(0.6, 0.79)
    assert not any(linked(spark, made))


def test_families_as_brute_force(spark):
    """Texts of one template with likenesses on both sides of 0.8: refused pairs must not hide others."""
    rnd, texts = random.Random(11), []
    for _ in range(4):
        base = [f"t{rnd.randrange(5000)}" for _ in range(200)]
        texts += [changed(rnd, base, rnd.choice(["replaced", "appended", "scattered"]), rnd.randint(1, 30)) for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (None, " ".join(texts[0]))]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if likeness(texts[i], texts[j]) >= 0.8:
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    want = {i: find(i) for i in range(len(texts))} | {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1002, None: find(0)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in simhash.alike(df).collect()} == want
    assert 4 < len({want[i] for i in range(len(texts))}) < len(texts)
    assert sorted((r["doc_id"] for r in simhash.first_alike(df).collect()), key=str) == sorted({v for v in want.values()}, key=str)


def test_split_values_and_families(spark, monkeypatch):
    """Blocks that meet pairwise give what one task gives."""
    rnd, texts = random.Random(12), []
    for _ in range(3):
        base = [f"t{rnd.randrange(5000)}" for _ in range(120)]
        texts += [changed(rnd, base, rnd.choice(["replaced", "scattered"]), rnd.randint(1, 9)) for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    whole = {tuple(r) for r in simhash.alike(df).select("doc_id", "component_id").collect()}
    assert 3 < len({c for _, c in whole}) < len(texts)
    for name, value in (("MEMBERS", 7), ("FAMILY", 10), ("SHINGLES", 900), ("OFTEN", 3)):
        monkeypatch.setattr(simhash, name, value)
    assert {tuple(r) for r in simhash.alike(df).select("doc_id", "component_id").collect()} == whole


def test_large_family(spark):
    """20,000 near copies of one text, in families of a few thousand members a block."""
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(changed(rnd, base, "scattered", rnd.randint(1, 4)))) for i in range(20_000)] + [(50_000, " ".join(reversed(base)))]
    got = simhash.alike(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    # four edits of single words leave 180 of 216 shingles to the text that has one
    assert {r[0]: r[1] for r in got.groupBy("component_id").count().collect()} == {0: 20_000, 50_000: 1}


def test_no_documents(no_docs):
    assert simhash.first_alike(no_docs).count() == 0


def test_fingerprints_link_what_sets_do_not(spark):
    """A line that fills most of two texts decides their fingerprints; their sets of shingles have little in common."""
    line = ["red", "green", "blue", "black", "white"]
    own = [[f"{k}{i}" for i in range(30)] for k in "pq"]
    rows = [(i, " ".join(line * 100 + own[i])) for i in range(2)] + [(2, " ".join(own[0] + own[1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2}
    assert {r["doc_id"]: r["component_id"] for r in simhash.alike(df).collect()} == {0: 0, 1: 1, 2: 2}
    assert sorted(r["doc_id"] for r in simhash.first_alike(df).collect()) == [0, 2]
