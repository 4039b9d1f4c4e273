import hashlib
from collections import defaultdict

from panelstat.llm import sharding


def brute(rows, limit):
    """Split from the root: (shard, depth, rows, bytes) by row index."""
    bits = [f"{int(hashlib.sha256(('' if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16):060b}" for r in rows]
    size = [len((r[1] or "").encode()) for r in rows]
    out, todo = {}, [("", list(range(len(rows))))]
    while todo:
        prefix, own = todo.pop()
        total = sum(size[i] for i in own)
        if total <= limit or len(own) == 1:
            out |= {i: (prefix, len(prefix), len(own), total, total <= limit) for i in own}
        else:
            half = defaultdict(list)
            for i in own:
                half[bits[i][len(prefix)]].append(i)
            todo += [(prefix + b, x) for b, x in half.items()]
    return sorted(str((rows[i][0], size[i], *out[i])) for i in range(len(rows)))


def test_as_brute_force(docs, clashing, rows):
    own = [r for k, r in enumerate(rows) if r not in rows[:k]]
    for limit in (100, 1000, 30_000, 1 << 30):
        for d in (docs, clashing):
            d = d.dropDuplicates(["doc_id", "text", "lang", "source", "n_chars"])
            got = sharding.assign(d, limit=limit).select("doc_id", "n_bytes", "shard", "depth", "shard_rows", "shard_bytes", "fits").collect()
            assert sorted(str(tuple(r)) for r in got) == brute(own, limit)


def test_hot_key_splits(spark):
    docs = spark.createDataFrame([(7, "x" * 50)] * 200 + [(None, "y" * 30)] * 50 + [(i, "z" * 10) for i in range(100)], "doc_id long, text string")
    out = sharding.assign(docs, limit=500).collect()
    assert len(out) == 350 and all(r["fits"] and r["shard_bytes"] <= 500 for r in out)
    size, n = defaultdict(int), defaultdict(int)
    for r in out:
        size[r["shard"]] += r["n_bytes"]
        n[r["shard"]] += 1
    assert all(size[r["shard"]] == r["shard_bytes"] and n[r["shard"]] == r["shard_rows"] for r in out)
    assert not any(a != b and b.startswith(a) for a in size for b in size)


def test_empty_and_alone(spark, no_docs):
    assert sharding.assign(no_docs).count() == 0
    out = sharding.assign(spark.createDataFrame([(1, "x" * 900), (2, "y")], "doc_id long, text string"), limit=10).collect()
    assert {(r["doc_id"], r["fits"], r["shard_rows"]) for r in out} == {(1, False, 1), (2, True, 1)}
