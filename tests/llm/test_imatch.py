import hashlib
import random

import numpy as np

from panelstat.llm import imatch


def texts_of(rows):
    """(doc_id, text, following text) by plain sorting."""
    own = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return [(i, t, own[(k + 1) % len(own)][1]) for k, (i, t) in enumerate(own)]


def edited(t, f):
    half = len(t) // 2
    return t[:len(t) - half] + f[:half]


def check(spark, rows, df):
    lex = imatch.lexicon(df)
    make = imatch.Fingerprinter(lex)
    import pyarrow as pa
    slots = lambda t: make(next(iter(imatch._distinct(pa.array([t])))))
    want = []
    for i, t, f in texts_of(rows):
        e = edited(t, f)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), imatch._hex(slots(t)), imatch._hex(slots(e)), imatch.likeness(slots(t), slots(e)), imatch.likeness(slots(t), slots(f))))
    assert sorted(map(tuple, imatch.with_edits(df).collect()), key=str) == sorted(want, key=str)
    return want


def test_as_plain_python(spark, docs, clashing, rows):
    want = check(spark, rows, docs)
    assert check(spark, rows, clashing) == want
    assert sorted((w[0], w[3]) for w in want) == sorted(map(tuple, imatch.fingerprint(docs).collect()))


def test_lexicon_band(spark, docs, rows):
    df = {}
    for r in rows:
        for w in set((r[1] or "").encode().lower().split()):
            df[w] = df.get(w, 0) + 1
    n = len(rows)
    assert len(imatch.lexicon(docs, 0.1, 0.4)) == sum(0.1 * n <= c <= 0.4 * n for c in df.values())


def test_sparse_ids_nulls_and_one_row(spark, no_docs):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 7, rnd.randrange(10**12), -rnd.randrange(10**12)]), " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30)))) for _ in range(300)]
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    check(spark, [(3, "abé def")], spark.createDataFrame([(3, "abé def")], "doc_id long, text string"))
    nulls = [(None, "x y"), (None, "z")]
    check(spark, nulls, spark.createDataFrame(nulls, "doc_id long, text string"))
    assert imatch.with_edits(no_docs).count() == 0


def test_likeness_follows_the_edit():
    rnd = np.random.default_rng(1)
    lex = np.sort(rnd.integers(0, 2**63, 5000, dtype=np.uint64))
    make = imatch.Fingerprinter(lex)
    mean = []
    for changed in (0, 2, 30, 100, 200):
        got = []
        for _ in range(30):
            a = rnd.choice(lex, 200, replace=False)
            b = np.append(a[changed:], rnd.choice(lex, changed, replace=False))
            got.append(imatch.likeness(make(np.unique(a)), make(np.unique(b))))
        mean.append(np.mean(got))
    assert mean[0] == 1 and mean == sorted(mean, reverse=True) and mean[1] > 0.6 and mean[3] > 2 * mean[4]
