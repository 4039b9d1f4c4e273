import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from panelstat.llm import packing, substring, toxicity
from panelstat.llm.catalog import learn_toxicity
from panelstat.llm.common import cut, table

FOLDER = os.environ.get("PANELSTAT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage gets and gives, written and read again."""
    base, docs, out = tmp_path_factory.mktemp("stages"), table(spark, FOLDER, "documents"), []
    for name, stage in P.STAGES:
        path = str(base / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {n: (a, b) for n, a, b in out}


def test_columns_and_order(spark, steps):
    assert list(steps) == ["toxicity", "near_dedup", "substring_dedup", "mix", "pack"]
    columns = table(spark, FOLDER, "documents").columns
    assert all(after.columns == columns for name, (_, after) in steps.items() if name != "pack")


def test_toxic_documents_go(spark, steps):
    before, after = steps["toxicity"]
    model = learn_toxicity(before, table(spark, FOLDER, "labels"))
    bad = {r[0] for r in toxicity.score(before, model).filter("predicted = 1").select("doc_id").collect()}
    assert {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()} == bad
    y = {r["doc_id"]: r["toxic"] for r in table(spark, FOLDER, "labels").collect()}
    assert sum(y.get(i) == 1 for i in bad) >= 0.7 * sum(i in y for i in bad) > 0


def shingles(text):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def firsts(rows):
    """The smallest ids of the groups that all pairs of shingle sets with a likeness of 0.8 or more join."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x == sets[j] or both >= 0.8 * (len(x) + len(sets[j]) - both) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def test_one_document_of_each_group_stays(steps):
    before, after = steps["near_dedup"]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    assert sorted(r[0] for r in after.select("doc_id").collect()) == firsts(rows)
    assert after.select("text").distinct().count() == after.count() < before.count()


def test_odd_documents(spark, tmp_path):
    """Nulls, repeated rows, a very long text and columns with names of the stages' own."""
    docs = table(spark, FOLDER, "documents").limit(60)
    long = " ".join(f"n{i % 7919}" for i in range(60_000))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "no id at all here today", "en", None, 1), (7, None, "en", "a", None), (8, "", "en", "a", 0), (9, long, "en", "a", 1), (9, long, "en", "a", 1), (10, long + " end", "en", "a", 1)], docs.schema)
    clash = [F.lit(i).alias(c) for i, c in enumerate(["node", "size", "value", "_row", "score", "copies", "kept", "root", "n", "bin_id"])]
    docs.unionByName(odd).select("*", *clash).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, FOLDER, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:2]:
        after = stage(spark, given, str(tmp_path))
        assert after.columns == given.columns
        given = cut(after, name)
    kept = [r["text"] for r in given.collect()]
    assert kept.count(long) == 1 and long + " end" not in kept
    assert P.run(spark, str(tmp_path)).count() > 50


def test_repeated_passages_go(steps):
    before, after = steps["substring_dedup"]
    found = {r["doc_id"]: r for r in substring.dedup(before).collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        f = found[r["doc_id"]]
        assert r["text"] == (f["kept"] if f["n_removed"] else texts[r["doc_id"]])
    assert after.count() == before.count() and any(f["n_removed"] for f in found.values())


def test_mix_and_bins(steps):
    before, after = steps["mix"]
    times = Counter(r[0] for r in after.select("doc_id").collect())
    assert max(times.values()) <= 3 and set(times) <= {r[0] for r in before.select("doc_id").collect()}
    mixed, packed = steps["pack"]
    words = lambda df: df.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    rows = packed.collect()
    assert sum(r["words"] for r in rows) == words(mixed)
    bins = Counter((r["bin_id"], r["cluster"]) for r in rows)
    assert max(bins.values()) == 1 and max(r["bin_words"] for r in rows) <= packing.CAPACITY


def test_run_is_the_stages(spark, steps):
    assert P.run(spark, FOLDER).count() == steps["pack"][1].count()


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        table(spark, FOLDER, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
