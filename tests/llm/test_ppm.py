import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelstat.llm import ppm

def trained():
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 1


def sequence(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


class Plain:
    """The model by dictionaries, with exclusion symbol by symbol."""

    def __init__(self, texts, order):
        seen = defaultdict(Counter)
        total = 0
        for t in texts:
            s = bytes(order) + sequence(t)
            for i in range(order, len(s)):
                total += 1
                for k in range(order + 1):
                    seen[s[i - k:i], k][s[i]] += 1
        self.order, self.total = order, total
        self.seen = seen

    def log10(self, text):
        s, out = bytes(self.order) + sequence(text), 0.0
        for i in range(self.order, len(s)):
            gone = set()
            for k in range(self.order, -1, -1):
                own = {b: n for b, n in self.seen.get((s[i - k:i], k), {}).items() if b not in gone}
                if not own:
                    continue
                context = s[i - k:i]
                kept = self.seen[context, k]
                times = self.total if not k else self.seen.get((context[:-1], k - 1), {}).get(context[-1], 0)
                dropped = max(0, times - sum(kept.values()))
                whole = sum(own.values()) + dropped
                if s[i] in own:
                    out += math.log10((own[s[i]] - 0.5) / whole)
                    break
                out += math.log10((len(own) / 2 + dropped) / whole)
                gone |= own.keys()
            else:
                out -= math.log10(256 - len(gone))
        return out


def brute(rows, order):
    model = Plain([r[1] for r in rows if not held(r[0])], order)
    c = Counter()
    for r in rows:
        if not held(r[0]):
            c.update((r[1] or "").encode().lower().split() + [None])
    n, v = sum(c.values()), len(c)
    out = []
    for r in rows:
        tokens = (r[1] or "").encode().lower().split() + [None]
        out.append((r[0], held(r[0]), len(tokens), sum(c[t] > 0 for t in tokens), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), model.log10(r[1])))
    return out


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    key = lambda r: (str(r[:5]), r[6])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("order", [6, 5, 4, 2, 1])
def test_as_plain_model(docs, rows, order):
    same(ppm.scores(docs, trained(), order).collect(), brute(rows, order))


def test_clashing_empty_and_untrained(clashing, no_docs, docs, rows):
    same(ppm.scores(clashing, trained()).collect(), brute(rows, 6))
    assert ppm.scores(no_docs).count() == 0
    out = ppm.scores(docs, F.lit(False)).collect()
    assert {r["train_tokens"] for r in out} == {0} and all(r["score"] == pytest.approx(-math.log10(256) * len(sequence(t))) for r in out for t in [next(x[1] for x in rows if x[0] == r["doc_id"])])


def test_probabilities_add_up():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc dé") for _ in range(200)) for _ in range(20)]
    m = Plain(texts, 3)
    by = [[], [], [], []]
    for (c, k), v in m.seen.items():
        by[k] += [(int.from_bytes(c + bytes([b]), "big"), n) for b, n in v.items()]
    trie = ppm.Trie([(np.array([g for g, _ in sorted(x)], np.uint64), np.array([n for _, n in sorted(x)])) for x in by], m.total)
    for context in (b"abc", b"zzz", b"\0\0\0", b"zab"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** trie.log10(keys)).sum() == pytest.approx(1, rel=1e-9)


def test_adaptive(spark):
    rows = [(1, "ab ab ab ab ab ab ab ab"), (2, "qwertyuiopasdfghjklzxcv"), (3, None)]
    out = {r[0]: r[1] for r in ppm.adaptive_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] > out[2] and out[3] == pytest.approx(-math.log10(256))
    assert ppm.adaptive_log10(b"aa", 2) == pytest.approx(math.log10(1 / 256) + math.log10(1 / 2))  # the empty context has seen one byte once


def test_hash_table():
    rnd = np.random.default_rng(0)
    keys = np.unique(np.append(rnd.integers(0, 5000, 1500), [0])).astype(np.uint64)
    table = ppm.HashTable(keys, keys.astype(float) * 2)
    x = np.arange(5000, dtype=np.uint64)
    got, missing = table(x)
    assert set(x[missing]) == set(x) - set(keys) and (got[keys.astype(int)] == keys * 2.0).all()
    assert ppm.HashTable(keys[:0], keys[:0].astype(float))(x)[1].tolist() == x.tolist()


def test_sequences():
    texts = [None, "", "Ab  C", " ", "x", "\t", "é É\n"]
    got = [out[first[i]:first[i + 1]].tobytes() for out, first in ppm.sequences(pa.array(texts)) for i in range(len(first) - 1)]
    assert got == [sequence(t) for t in texts]
