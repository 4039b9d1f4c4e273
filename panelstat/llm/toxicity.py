"""Toxicity by subword bags: embeddings of character n-grams averaged into a linear softmax.

A word's bag holds the n-grams of its bytes between word marks and the word itself, each hashed to one of ``2**bits``
embeddings. A word that follows itself counts once. A window of ``width`` words is the average of its bags; a softmax over two classes makes it a
probability. A document is as toxic as its worst window, so a few words do not drown in a long text. As
n-grams are shared, a misspelt or inflected word is near the word it comes from.

Embeddings and softmax are trained jointly by gradient steps (AdaGrad) in NumPy, first on whole documents, then in
rounds on the window of each document that the model finds worst. Training reads a bounded sample: of each label
at most ``sample`` documents, those with the smallest hashes; equal rows teach once. A document of more than ``longest``
bytes teaches by one piece of that many bytes, cut between words: a clean one by any (its hash decides), a toxic one by the piece that a
model of the others finds worst, as its label may come from any place. The model has a fixed size; every document is scored in full.

Defined cases: a null or empty text scores as a window without words does; labels are 0 or 1, rows without doc_id or
label teach nothing, and of several labels of a document the largest counts; without examples of both labels every score
is the share of toxic ones (0 without any).
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.llm import words as W
from panelstat.llm.common import cut

BITS, DIM, WIDTH = 18, 8, 6
GRAMS = (3, 4, 5)
SAMPLE, LONGEST = (6000, 1500), 6_000
THRESHOLD = 0.7
_U = np.uint64
_MULTIPLIERS = W._mixed(np.arange(1, 9, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
_MARK = W._mixed(np.array([901, 902], _U))


@dataclass
class Bags:
    """N-grams of consecutive words: bucket ids by word, words by document."""

    ids: np.ndarray
    words: np.ndarray  # first id of each word, one more at the end
    docs: np.ndarray  # first word of each document, one more at the end


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words between marks as 64-bit numbers, where each word begins and ends in them, words by document."""
    data = W.lowered(data)
    starts, ends, rows = W.spans(data, offsets)
    same = W.hashes(data, starts, ends)
    new = np.ones(len(starts), bool)
    new[1:] = same[1:] != same[:-1]
    new[rows[:-1][rows[:-1] < len(starts)]] = True
    rows = np.append(0, np.cumsum(new))[rows]
    starts, ends = starts[new], ends[new]
    lengths = ends - starts
    begin = np.concatenate([[0], np.cumsum(lengths + 2)])
    letters = np.empty(int(begin[-1]), _U)
    at = np.arange(int(lengths.sum()))
    word = np.repeat(np.arange(len(starts)), lengths)
    inside = at + 2 * word + 1
    letters[inside] = W._LETTER[data[at - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[word]]]
    letters[begin[:-1]] = _MARK[0]
    letters[begin[1:] - 1] = _MARK[1]
    return letters, begin[:-1], begin[1:], rows


def _grams(letters: np.ndarray, begin: np.ndarray, end: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each n-gram length: bucket at every position and which positions hold one; last the whole words, one a word."""
    left = np.repeat(end, end - begin) - np.arange(len(letters))
    shift = _U(64 - bits)
    h = np.zeros(len(letters), _U)
    for n in range(max(GRAMS)):
        h[: max(0, len(letters) - n)] += letters[n:] * _MULTIPLIERS[n]
        if n + 1 in GRAMS:
            yield ((h * _U(0x9E3779B97F4A7C15 + 2 * n)) >> shift).astype(np.int64), left > n
    place = np.arange(len(letters)) - np.repeat(begin, end - begin)
    whole = np.add.reduceat(letters * W._powers(int((end - begin).max()))[place], begin)
    yield (W._mixed(whole) >> shift).astype(np.int64), None


def bags(texts: pa.Array, bits: int = BITS) -> Bags:
    words, docs, n_ids, n_words = [], [np.zeros(1, np.int64)], 0, 0
    # a word has at most three ids a byte; they are written in place, so there is no second copy of them all
    ids = np.empty(3 * sum(len(data) for _, _, data, _ in W.chunks(texts)), np.int32)
    for _, _, data, offsets in W.chunks(texts):
        letters, begin, end, rows = _padded(data, offsets)
        docs.append(rows[1:] + n_words)
        n_words += len(begin)
        if not len(begin):
            continue
        word = np.repeat(np.arange(len(begin)), end - begin)
        got, of = [], []
        for bucket, ok in _grams(letters, begin, end, bits):
            got.append(bucket if ok is None else bucket[ok])
            of.append(np.arange(len(begin)) if ok is None else word[ok])
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        ids[n_ids: n_ids + len(order)] = np.concatenate(got)[order]
        words.append(n_ids + np.searchsorted(of[order], np.arange(len(begin))))
        n_ids += len(order)
    return Bags(ids[:n_ids], np.append(np.concatenate(words or [np.zeros(0, np.int64)]), n_ids).astype(np.int64), np.concatenate(docs))


def _word_sums(table: np.ndarray, b: Bags, size: int = 1 << 20) -> np.ndarray:
    """What the ids of each word add up to; about ``size`` ids are looked up at a time."""
    out = np.zeros(len(b.words) - 1)
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(b.words, b.words[first] + size, "right")) - 1)
        out[first:last] = np.add.reduceat(table[b.ids[b.words[first]: b.words[last]]], b.words[first:last] - b.words[first])
        first = last
    return out


def _worst(sums: np.ndarray, counts: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the largest average over ``width`` consecutive words (all, if fewer) and its first word; none: 0, -1."""
    s, c = np.append(0.0, np.cumsum(sums)), np.append(0, np.cumsum(counts))
    n = rows[1:] - rows[:-1]
    best, at = np.zeros(len(n)), np.full(len(n), -1)
    short = np.flatnonzero((n > 0) & (n <= width))
    best[short] = (s[rows[short + 1]] - s[rows[short]]) / (c[rows[short + 1]] - c[rows[short]])
    at[short] = rows[short]
    if len(sums) >= width:
        average, n_ids = s[width:] - s[:-width], c[width:] - c[:-width]
        np.divide(average, np.maximum(n_ids, 1, out=n_ids), out=average)
        for i in np.flatnonzero(n > width):
            own = average[rows[i]: rows[i + 1] - width + 1]
            k = int(own.argmax())
            best[i], at[i] = own[k], rows[i] + k
    return best, at


@dataclass
class Model:
    embeddings: np.ndarray
    weights: np.ndarray  # (dim, 2)
    bias: np.ndarray  # (2,)
    width: int
    prior: float | None = None

    def table(self) -> np.ndarray:
        """What each bucket adds to the logit of toxic, before the average."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    def logits(self, texts: pa.Array) -> np.ndarray:
        bits, table = int(len(self.embeddings)).bit_length() - 1, self.table()
        out = []
        for _, _, data, offsets in W.chunks(texts):
            letters, begin, end, rows = _padded(data, offsets)
            if not len(begin):
                out.append(np.zeros(len(rows) - 1))
                continue
            total, n = np.zeros(len(letters)), np.zeros(len(letters), np.int32)
            for bucket, ok in _grams(letters, begin, end, bits):
                if ok is None:
                    sums, counts = np.add.reduceat(total, begin) + table[bucket], np.add.reduceat(n, begin) + 1
                else:
                    total += table[bucket] * ok
                    n += ok
            out.append(_worst(sums, counts, rows, self.width)[0])
        return np.concatenate(out or [np.zeros(0)]) + (self.bias[1] - self.bias[0])

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -500, 500)))


def _steps(model: Model, grad2: list[np.ndarray], b: Bags, first: np.ndarray, last: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, rnd, batch: int) -> None:
    """One pass of gradient steps over the spans of words [first, last), one span a document."""
    start, stop = b.words[first], b.words[last]
    order = rnd.permutation(len(y))
    for k in range(0, len(order), batch):
        rows = order[k: k + batch]
        sizes = stop[rows] - start[rows]
        rows, sizes = rows[sizes > 0], sizes[sizes > 0]
        if not len(rows):
            continue
        doc = np.repeat(np.arange(len(rows)), sizes)
        ids = b.ids[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[rows][doc]]
        used, ids = np.unique(ids, return_inverse=True)
        e = model.embeddings[used]
        mean = np.stack([np.bincount(doc, e[ids, j], len(rows)) for j in range(e.shape[1])], 1) / sizes[:, None]
        z = mean @ model.weights + model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = (p - np.stack([1 - y[rows], y[rows]], 1)) * weight[rows, None]
        g_mean = (err @ model.weights.T) / sizes[:, None]
        g_e = np.stack([np.bincount(ids, g_mean[doc, j], len(used)) for j in range(e.shape[1])], 1)
        for target, g, sq, at in ((model.embeddings, g_e, grad2[0], used), (model.weights, mean.T @ err, grad2[1], slice(None)), (model.bias, err.sum(0), grad2[2], slice(None))):
            sq[at] += g * g
            target[at] -= rate * g / (np.sqrt(sq[at]) + 1e-8)


def train(texts: pa.Array, labels: np.ndarray, bits: int = BITS, dim: int = DIM, width: int = WIDTH, whole_passes: int = 2, rounds: int = 8, passes: int = 3, rate: float = 0.3, seed: int = 7) -> Model:
    y = np.asarray(labels, np.float64)
    rnd = np.random.default_rng(seed)
    model = Model(rnd.normal(0, 0.1, (1 << bits, dim)), np.stack([-np.ones(dim), np.ones(dim)], 1) * 0.5, np.zeros(2), width)
    if not len(y) or not 0 < y.sum() < len(y):
        model.prior = float(y.mean()) if len(y) else 0.0
        return model
    b = bags(texts, bits)
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    grad2 = [np.zeros_like(model.embeddings), np.zeros_like(model.weights), np.zeros(2)]
    for _ in range(whole_passes):
        _steps(model, grad2, b, b.docs[:-1], b.docs[1:], y, weight, rate, rnd, 128)
    counts = np.diff(b.words)
    for _ in range(rounds):
        _, at = _worst(_word_sums(model.table(), b), counts, b.docs, width)
        some = np.flatnonzero(at >= 0)
        first = at[some]
        last = np.minimum(first + width, b.docs[1:][some])
        for _ in range(passes):
            _steps(model, grad2, b, first, last, y[some], weight[some], rate, rnd, 256)
    return model


_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def _piece(data: bytes, start: int, size: int) -> str:
    """Whole words among ``size`` bytes from ``start``; a part of a word only if it alone is longer."""
    part = data[start: start + size]
    spaces = [m.start() for m in _SPACES.finditer(part)]
    a, z = 0, len(part)
    if spaces and start and not _SPACES.match(data, start - 1):
        a = spaces[0]
    if spaces and start + size < len(data) and not _SPACES.match(data, start + size):
        z = spaces[-1]
    return part[a:max(a, z)].decode(errors="ignore")


def pieces(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` bytes that overlap by half; a text that is no longer is its only piece."""
    data = text.encode()
    return [text] if len(data) <= size else [_piece(data, a, size) for a in range(0, len(data) - size // 2, max(1, size // 2))]


def _excerpts(texts: DataFrame, longest: int, model: Model | None = None) -> DataFrame:
    """(_h, text, y) with each long text cut to its worst piece, or to the one its hash names if there is no model."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = pieces(text, longest)
                out.append(own[h % len(own) if model is None or len(own) == 1 else int(model.scores(pa.array(own, pa.string())).argmax())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2)], names=["_h", "text", "y"])

    if model is not None:
        sent = texts.sparkSession.sparkContext.broadcast((model.embeddings, model.weights, model.bias, model.width, model.prior))

        def by_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal model
            model = Model(*sent.value)
            yield from each(batches)

    return texts.select("_h", "text", "y").mapInArrow(each if model is None else by_model, "_h long, text string, y int")


def fit(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, sample: tuple[int, int] = SAMPLE, longest: int = LONGEST, **options) -> Model:
    """A model from labels (doc_id, toxic) of documents for which ``train_on`` (a condition on doc_id) holds.

    sample: at most so many clean and toxic documents. They are trained on in one task, each by at most ``longest`` bytes.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.filter(train_on) if train_on is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("y"))
    own_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    # the sample is chosen without its texts: at most sum(sample) hashes, by which each task then picks its texts
    rows = docs.select(own_id.alias("_id"), F.xxhash64(own_id, text).alias("_h")).join(known, "_id")
    chosen = [rows.filter(F.col("y") == k).select("_h", "_id", "y").distinct().orderBy("_h", "_id").limit(n) for k, n in enumerate(sample)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(own_id.alias("_i"), text.alias("text")).withColumn("_x", F.xxhash64("_i", "text"))
    texts = cut(texts.join(chosen, (F.col("_x") == F.col("_h")) & (F.col("_i") == F.col("_id"))).select("_h", "text", "y"), "toxicity-sample")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)})
        model = train(pa.array([r[1] for r in rows], pa.string()), np.array([r[2] for r in rows]), **options)
        kept = (model.embeddings.astype(np.float32), model.weights, model.bias, model.width, model.prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(kept)], pa.binary())], names=["model"])

    def model_of(examples: DataFrame) -> Model:
        found = examples.repartition(1).mapInArrow(learn, "model binary").collect()
        return Model(*pickle.loads(found[0][0])) if found else train(pa.array([], pa.string()), np.zeros(0))

    open_ = (F.col("y") == 1) & (F.octet_length("text") > longest)
    sure, hidden = _excerpts(texts.filter(~open_), longest), texts.filter(open_)
    model = model_of(sure)
    if hidden.isEmpty():
        return model
    if model.prior is not None:  # no toxic document is short enough to begin with
        model = model_of(sure.unionByName(_excerpts(hidden, longest)))
    return model_of(sure.unionByName(_excerpts(hidden, longest, model if model.prior is None else None)))


def scorer(spark: SparkSession, model: Model):
    """A function from a text column to its score."""
    sent = spark.sparkContext.broadcast((model.embeddings, model.weights, model.bias, model.width, model.prior))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(Model(*sent.value).scores(texts), pa.float64())

    return scored


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) of every row."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs.sparkSession, model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold."""
    return docs.filter(scorer(docs.sparkSession, model)("text") < threshold)
