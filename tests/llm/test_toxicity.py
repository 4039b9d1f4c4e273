import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelstat.llm import toxicity

BAD = ["idiot", "scum", "moron", "lowei"]


def make(seed, n):
    rnd = random.Random(seed)
    part = ["an", "the", "or", "tion", "re", "st", "ing", "ha", "É", "ble"]
    word = lambda: "".join(rnd.choice(part) for _ in range(rnd.randint(1, 3)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 400))]
        y = int(rnd.random() < 0.3)
        for _ in range(2 * y):
            words[rnd.randrange(len(words))] = rnd.choice(BAD) + (word() if rnd.random() < 0.3 else "")
        out.append((i, " ".join(words), y))
    return out


@pytest.fixture(scope="module")
def model():
    rows = make(0, 800)
    return toxicity.train(pa.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def test_held_out_accuracy(model):
    rows = make(1, 400)
    s = model.scores(pa.array([r[1] for r in rows]))
    y = np.array([r[2] for r in rows])
    assert ((s >= toxicity.THRESHOLD) == y).mean() > 0.98 and s.min() >= 0 and s.max() <= 1


def test_misspellings_and_edges(model):
    near = model.scores(pa.array(["the orst " + w + " ing hare" for w in ("iddiot", "morons", "loweian", "idiots")]))
    far = model.scores(pa.array(["the orst " + w + " ing hare" for w in ("hatre", "restha")]))
    assert near.min() > far.max() and near.mean() > 0.7
    empty = model.scores(pa.array([None, "", " \n"]))
    assert len(set(empty)) == 1 and empty[0] < toxicity.THRESHOLD
    long = "the orha reing " * 50_000
    assert model.scores(pa.array([long]))[0] < 0.7 < model.scores(pa.array([long + "idiot scum"]))[0]


def test_scores_do_not_depend_on_the_batch(model):
    texts = [r[1] for r in make(2, 60)] + ["", None]
    alone = np.concatenate([model.scores(pa.array([t], pa.string())) for t in texts])
    assert model.scores(pa.array(texts)) == pytest.approx(alone, rel=1e-9)


def test_window_is_the_worst():
    rnd = np.random.default_rng(0)
    sums, counts, rows = rnd.normal(size=40), rnd.integers(1, 9, 40), np.array([0, 0, 3, 9, 40, 40])
    best, at = toxicity._worst(sums, counts, rows, 6)
    for i in range(5):
        spans = [(a, min(a + 6, rows[i + 1])) for a in range(rows[i], max(rows[i] + 1, rows[i + 1] - 5))]
        want = max((sums[a:b].sum() / counts[a:b].sum(), a) for a, b in spans) if rows[i] < rows[i + 1] else (0, -1)
        assert (best[i], at[i]) == pytest.approx(want)


def test_fit_and_filter(spark):
    rows = make(3, 500)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(None, None, 0), (9000, "", 0), (9001, "idiot scum moron", 0), (9001, "idiot scum moron", 0)], "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(None, 0, 1), (9000, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    again = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    assert (model.table() == again.table()).all()
    out = toxicity.score(docs, model).collect()
    y = {i: y for i, _, y in rows}
    held = [(r["predicted"], y[r["doc_id"]]) for r in out if r["doc_id"] in y and r["doc_id"] % 5 == 0]
    assert len(out) == 504 and sum(p == t for p, t in held) >= 0.97 * len(held)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 9001").count() == 0 and kept.filter("doc_id is null").count() == 1
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pieces():
    text = " ".join(f"wörd{i}" for i in range(300))
    got = toxicity.pieces(text, 100)
    words = text.split()
    assert {w for p in got for w in p.split()} == set(words) and all(len(p.encode()) <= 100 for p in got)
    for p in got:
        k = words.index(p.split()[0])
        assert p.split() == words[k: k + len(p.split())]
    runs = {tuple(p.split()[i: i + 4]) for p in got for i in range(len(p.split()) - 3)}
    assert {tuple(words[i: i + 4]) for i in range(297)} <= runs
    assert toxicity.pieces("", 5) == [""] and toxicity.pieces("short", 5) == ["short"]
    assert "".join(toxicity.pieces("é" * 50, 20)).strip("é") == ""


@pytest.mark.parametrize("some_short", [True, False])
def test_long_documents_teach_too(spark, some_short):
    """Toxic words that only long documents have are learnt if they stand near known ones, wherever in the text."""
    rnd = random.Random(8)
    filler = lambda n: [rnd.choice(["an", "the", "orha", "string", "table"]) for _ in range(n)]
    rows = []
    for i, text, y in make(5, 600):
        words = text.split()
        if i % 2 or not some_short:
            words = [w for w in words if not any(b in w for b in BAD)] + filler(600 if some_short else 80)
            if y:
                at = rnd.randrange(len(words))
                words[at:at] = ["scum", "zugqat", "idiot"]
        rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, longest=2_000 if some_short else 400)
    # where the three always come together, any of them may carry the label
    bad = model.scores(pa.array(["the orha scum ing string", "the orha zugqat an zugqat string"] if some_short else ["the orha scum zugqat idiot string"]))
    good = model.scores(pa.array(["the orha table an ing string", "re ble an the"]))
    assert bad.min() >= toxicity.THRESHOLD > good.max()


def test_a_long_document_gives_its_worst_piece(spark):
    rows = make(0, 400)
    model = toxicity.train(pa.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    texts = ["the orha reing " * n + "idiot scum " + "an ing ble " * (3000 - n) for n in (0, 1, 999, 3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, "short idiot", ""])], "_h long, text string, y int")
    got = {r[0]: r[1] for r in toxicity._excerpts(df, 500, model).collect()}
    assert all("idiot" in got[i] and len(got[i]) <= 500 for i in range(4)) and got[4] == "short idiot" and got[5] == ""


def test_scores_by_hand():
    """The score of a text is that of its worst window, by plain sums over hashed n-grams."""
    rnd = np.random.default_rng(5)
    model = toxicity.Model(rnd.normal(size=(1 << 10, 3)).astype(np.float32), rnd.normal(size=(3, 2)), rnd.normal(size=2), 6)
    for text in ("one", "one two two three", " ".join(f"w{i} x" for i in range(9)), "É é a"):
        low = [w.decode() for w in text.encode().lower().split()]
        words = [w for k, w in enumerate(low) if not k or low[k - 1] != w]
        bag = []
        for w in words:
            b = toxicity.bags(pa.array([w]), 10)
            bag.append(b.ids)
            n = len(w.encode()) + 2
            assert len(b.ids) == sum(max(0, n - g + 1) for g in toxicity.GRAMS) + 1
        spans = [bag[a: a + 6] for a in range(max(1, len(bag) - 5))]
        z = [model.embeddings[np.concatenate(s)].astype(float).mean(0) @ model.weights + model.bias for s in spans]
        want = max(np.exp(v[1]) / np.exp(v).sum() for v in z)
        assert model.scores(pa.array([text]))[0] == pytest.approx(want, rel=1e-6)


def test_training_holds_the_ids_once():
    """The ids of all words are four bytes each; looking them up, or putting them together, made two and three copies more."""
    texts = pa.array([" ".join(f"{i * k % 9973:07}{k:05}" for k in range(400)) for i in range(1000)])
    y, size = np.arange(len(texts)) % 2, sum(len(t.as_py()) for t in texts)
    tracemalloc.start()
    model = toxicity.train(texts, y, bits=10, whole_passes=1, rounds=1, passes=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.prior is None and peak < 20 * size + (48 << 20)


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_sums_of_words_do_not_depend_on_blocks(size):
    b, table = toxicity.bags(pa.array([r[1] for r in make(4, 40)] + ["", None, "a", "a bb a " * 9])), np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    assert (toxicity._word_sums(table, b, size) == np.add.reduceat(table[b.ids], b.words[:-1])).all()
    none = toxicity.bags(pa.array(["", None], pa.string()))
    assert len(none.ids) == 0 and len(toxicity._word_sums(table, none)) == 0
