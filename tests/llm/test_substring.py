import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelstat.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=13):
    """(doc_id, n_words, n_removed, hash of the kept words) from all windows of all documents."""
    words = [WORD.findall(r[1] or "") for r in rows]
    big = 1 << 70
    first = defaultdict(lambda: big)
    for r, w in zip(rows, words):
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            first[k] = min(first[k], big - 1 if r[0] is None else r[0])
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < (big - 1 if r[0] is None else r[0]):
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()], key=str)


def test_as_brute_force(docs, rows):
    assert got(substring.dedup(docs)) == brute(rows)
    assert any(r[2] for r in brute(rows))


@pytest.mark.parametrize("seed", range(3))
def test_dense_repeats(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([i, i, None, 4]), " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))) for i in range(25)]
    assert got(substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_other_widths(docs, rows):
    assert got(substring.dedup(docs, width=9, period=3, cover=(0, 1))) == brute(rows, 9)
    with pytest.raises(ValueError):
        substring.dedup(docs, cover=(0, 1))


def test_empty_and_clashing(no_docs, clashing, rows):
    assert substring.dedup(no_docs).count() == 0
    assert got(substring.dedup(clashing)) == brute(rows)


def test_carried_rows(clashing, rows):
    out = substring.dedup(clashing, carry=True)
    assert out.columns == clashing.columns
    lost = {r[0]: r[2] for r in brute(rows)}
    before = {r["doc_id"]: r for r in clashing.collect()}
    for r in out.collect():
        want = before[r["doc_id"]].asDict()
        if lost[r["doc_id"]]:
            assert len(WORD.findall(r["text"])) == len(WORD.findall(want["text"])) - lost[r["doc_id"]]
            want["text"] = r["text"]
        assert r.asDict() == want
