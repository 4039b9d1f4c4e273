"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``order``. In a context, every distinct byte gives half a count to the escape
(PPM's method D), which leads to the next shorter context. In the shorter context the bytes of the longer one are excluded, because the escape has said it is
none of them. Below the empty context the bytes left are equally likely.

Pretrained: the counts of all (order + 1)-grams of the training documents are summed by Spark; counts of shorter
grams are sums of these. All grams are kept, so the
model grows with the corpus and no task holds it. It lies in partitions by the last KEY bytes of the context: a
partition has whatever follows its contexts of that length or longer. Blocks of documents send the distinct grams they
hold, partitions add them up and answer with their probabilities. Only grams of up to KEY bytes, of which no
corpus has more than 256 ** KEY, are sent to all tasks. Seen grams are looked up in a hash table; only the others go
through escapes. As a byte seen after a long context is seen after its suffixes too, exclusions are sums that the
model holds for each context.

Adaptive: each document alone, from an empty trie that learns as it goes.

Texts are lower-cased (A-Z), words joined by one space, and closed by an end byte. The word-level base score adds half a
count to every token. Its counts cannot be bounded, so blocks of documents send the distinct words they hold to
the word's partition and get the counts back.

Defined cases: a null or empty text is its end only; without training documents all counts are zero; rows without doc_id
teach and are not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.llm import words as W
from panelstat.llm.arrays import parts
from panelstat.llm.common import cut, n_blocks, text_bytes

ORDER = 6
KEY, PART_BYTES = 3, 16 << 20
BLOCK_BYTES, PART_WORDS = 16 << 20, 1 << 18
END = 10
_U = np.uint64


def sequences(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, first byte of each row and one more) of normalised texts with their ends, chunk by chunk."""
    for _, _, data, offsets in W.chunks(texts):
        data = W.lowered(data)
        starts, ends, rows = W.spans(data, offsets)
        # every word with one byte after it: a space, or the end after a row's last; rows without words have the end alone
        lengths = ends - starts + 1
        bare = rows[1:] == rows[:-1]
        at = np.append(0, np.cumsum(lengths))
        first = at[rows] + np.append(0, np.cumsum(bare))
        shift = np.repeat(np.cumsum(np.append(0, bare))[:-1], np.diff(rows))  # bare rows before each word
        out = np.full(int(first[-1]), 32, np.uint8)
        word = np.repeat(np.arange(len(starts)), lengths - 1)
        inner = np.arange(int((lengths - 1).sum())) - np.repeat(np.cumsum(lengths - 1) - (lengths - 1), lengths - 1)
        out[(at[:-1] + shift)[word] + inner] = data[starts[word] + inner]
        out[first[1:] - 1] = END
        yield out, first


def grams(data: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """Of each byte the number made of its ``order`` predecessors in its row (zeros before the row) and itself."""
    wide = data.astype(_U)
    out = wide.copy()
    place = np.arange(len(data)) - np.repeat(first[:-1], np.diff(first))
    for k in range(1, order + 1):
        out[k:] |= np.where(place[k:] >= k, wide[:-k], _U(0)) << _U(8 * k)
    return out


class HashTable:
    """Numbers to values by open addressing; lookups are array operations."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())  # between a quarter and half full
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.full, self.values = np.zeros(1 << bits, _U), np.zeros(1 << bits, bool), np.zeros(1 << bits)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.full[slot[left]]]
            at, one = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at], self.full[at] = keys[free[one]], values[free[one]], True
            left = left[(self.keys[slot[left]] != keys[left]) | ~self.full[slot[left]]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, which are not in the table)."""
        slot = self._slot(keys)
        hit = (self.keys[slot] == keys) & self.full[slot]
        out = self.values[slot]
        left = np.flatnonzero(~hit)
        missing = []
        slot = slot[left]
        while len(left):
            gone = ~self.full[slot]
            missing.append(left[gone])
            left, slot = left[~gone], (slot[~gone] + 1) & self.mask
            hit = (self.keys[slot] == keys[left]) & self.full[slot]
            out[left[hit]] = self.values[slot[hit]]
            left, slot = left[~hit], slot[~hit]
        return out, np.sort(np.concatenate(missing)) if missing else left


class Trie:
    """Contexts of each length with their counts, from sorted (gram, count) arrays by context length.

    ``seen`` has, for lengths whose contexts are not themselves among the shorter grams, all contexts and how often each was seen.
    """

    def __init__(self, by_order: list[tuple[np.ndarray, np.ndarray]], n_bytes: int, seen: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        self.order = len(by_order) - 1
        self.grams = by_order
        self.contexts = []
        for k, (g, c) in enumerate(by_order):
            ctx = g >> _U(8)
            at = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(g) else np.zeros(0, np.int64)
            kept = np.add.reduceat(c, at) if len(g) else c
            total = np.full(len(at), n_bytes)
            if seen and k in seen:
                total = seen[k][1][np.searchsorted(seen[k][0], ctx[at])]
            elif k:  # how often the context itself was seen, whatever followed
                where, found = self._find(by_order[k - 1][0], ctx[at])
                total = np.where(found, by_order[k - 1][1][where], 0) if len(by_order[k - 1][0]) else np.zeros(len(at), np.int64)
            total = np.maximum(total, kept)
            distinct = np.diff(np.append(at, len(g)))
            excluded = np.zeros(len(at), np.int64)
            if k and len(g):  # what the shorter context has for the bytes of this one
                shorter, counts = by_order[k - 1]
                low = counts[np.searchsorted(shorter, g & _U((1 << 8 * k) - 1))]
                excluded = np.add.reduceat(low, at)
            self.contexts.append((ctx[at], total, total - kept + distinct / 2, distinct, excluded))
        g, c = by_order[-1]
        _, total, _, distinct, _ = self.contexts[-1]
        self.table = HashTable(g, np.log10((c - 0.5) / np.repeat(total, distinct)) if len(g) else np.zeros(0))

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def log10(self, x: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's last byte after the others."""
        out, missing = self.table(x)
        if len(missing):
            out[missing] = self._escaped(x[missing])
        return out

    def _escaped(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        open_ = np.arange(len(x))
        less, fewer = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)  # excluded counts and bytes
        for k in range(self.order, -1, -1):
            keys, total, escape, distinct, excluded = self.contexts[k]
            own = x[open_] & _U((1 << 8 * (k + 1)) - 1)
            at, seen = self._find(keys, own >> _U(8))
            if not seen.any():
                continue
            whole = np.where(seen, total[at] - less[open_], 0)
            out_of = np.where(seen, escape[at] - fewer[open_] / 2, 0)
            g, c = self.grams[k]
            where, hit = self._find(g, own)
            out[open_[hit]] += np.log10((c[where[hit]] - 0.5) / whole[hit])
            on = seen & ~hit
            costs = on & (out_of > 0)  # a context whose bytes are all excluded says nothing
            out[open_[costs]] += np.log10(out_of[costs] / whole[costs])
            less[open_[on]], fewer[open_[on]] = excluded[at[on]], distinct[at[on]]
            open_ = open_[~hit]
        out[open_] -= np.log10(256 - fewer[open_])
        return out


def _squeezed(a: np.ndarray) -> bytes:
    """64-bit numbers deflated byte plane by byte plane; small ones cost little."""
    return zlib.compress(a.view(np.uint8).reshape(len(a), 8).T.tobytes(), 1)


def _spread(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def packed(by_order: list[tuple[np.ndarray, np.ndarray]], n_bytes: int) -> dict:
    """Short grams and the training bytes, small enough to send: differences of sorted grams, and counts, deflated."""
    return {"n": n_bytes, "grams": [(_squeezed(np.diff(g, prepend=_U(0))), _squeezed(c.astype(np.int64))) for g, c in by_order]}


def opened(sent: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """The grams of what ``packed`` made; a Python worker opens them once and keeps them beside what was sent."""
    if "open" not in sent:
        sent["open"] = [(np.cumsum(_spread(g, _U), dtype=_U), _spread(c, np.int64)) for g, c in sent["grams"]]
    return sent["open"]


def _shorter(g: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last ``size`` bytes of grams."""
    return _summed(g & _U((1 << 8 * size) - 1), n)


def _gram_parts(g: np.ndarray, bits: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of sorted grams by partition, the partitions that occur and where each begins (one end more)."""
    part = (W._mixed((g >> _U(8)) & _U((1 << 8 * key) - 1)) >> _U(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return order, part[at], np.append(at, len(part))


def _part_trie(g: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]], n_bytes: int, order: int) -> Trie:
    """The trie of the contexts of one partition, from all its grams of order + 1 bytes and the short grams of all partitions."""
    seen, by_order = {}, list(low)
    for k in range(len(low), order + 1):
        own, m = _shorter(g, n, k + 1)
        if k > len(low):
            ctx, times = _summed(own >> _U(8), m)
            seen[k] = ctx, np.where(ctx & _U(255), times, 0)  # the zeros before a row are not bytes
        by_order.append((own, m))
    return Trie(by_order, n_bytes, seen)


def adaptive_log10(data: bytes, order: int = ORDER) -> float:
    """log10 probability of a byte sequence under a trie that starts empty and learns each byte after it is coded."""
    contexts: dict[bytes, dict[int, int]] = {}
    total = 0.0
    for i, x in enumerate(data):
        excluded: set[int] = set()
        for k in range(min(order, i), -1, -1):
            seen = {b: n for b, n in contexts.get(data[i - k: i], {}).items() if b not in excluded}
            if not seen:
                continue
            whole = sum(seen.values())
            if x in seen:
                total += np.log10((seen[x] - 0.5) / whole)
                break
            total += np.log10(len(seen) / 2 / whole)
            excluded |= seen.keys()
        else:
            total -= np.log10(256 - len(excluded))
        for k in range(min(order, i) + 1):
            own = contexts.setdefault(data[i - k: i], {})
            own[x] = own.get(x, 0) + 1
    return float(total)


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, score): every document under its own adaptive model."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [adaptive_log10(out[first[i]: first[i + 1]].tobytes(), order) for out, first in sequences(b.column(1)) for i in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, score double")


def _block_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, words by row) chunk by chunk."""
    for _, _, data, offsets in W.chunks(texts):
        data = W.lowered(data)
        starts, ends, rows = W.spans(data, offsets)
        yield W.hashes(data, starts, ends), rows


def _count(bits: int, gram_bits: int, order: int):
    """Of one block: its distinct words and grams with their counts in training rows, and those of grams of KEY bytes.

    Rows of words have their block's number, rows of grams one less than its negative; short grams are of partition -1.
    """
    key = min(KEY, order)

    def count(t: pa.Table) -> pa.Table:
        train = np.asarray(t["train"].combine_chunks(), bool)
        block = t["_block"][0].as_py()
        hs, ns, done = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
        for h, rows in _block_words(t["text"]):
            known = np.repeat(train[done: done + len(rows) - 1], np.diff(rows))
            done += len(rows) - 1
            distinct, which = np.unique(h, return_inverse=True)
            hs.append(distinct)
            ns.append(np.bincount(which, known, len(distinct)).astype(np.int64))
        h, n = _summed(np.concatenate(hs), np.concatenate(ns))
        g, c = _folded(pair for known in (True, False) for pair in _chunk_grams(t["text"].filter(pa.array(train == known)), order, known))
        low, m = _shorter(g[c > 0], c[c > 0], key)
        place, which, at = _gram_parts(g, gram_bits, key)
        own = [(-1, low, m)] + [(p, g[place[x:y]], c[place[x:y]]) for p, x, y in zip(which.tolist(), at[:-1], at[1:], strict=True)]
        gram_rows = pa.table([
            pa.array([p for p, _, _ in own], pa.int64()), pa.array(np.full(len(own), -1 - block)),
            pa.array([_squeezed(np.diff(x, prepend=_U(0))) for _, x, _ in own], pa.binary()), pa.array([_squeezed(y) for _, _, y in own], pa.binary()),
        ], names=["_part", "_block", "_p0", "_p1"])
        which, at = parts(h, bits)
        word_rows = pa.table([
            pa.array(which, pa.int64()), pa.array(np.full(len(which), block)),
            pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([_squeezed(n[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        ], names=["_part", "_block", "_p0", "_p1"])
        out = pa.concat_tables([word_rows, gram_rows])
        tokens = np.zeros(out.num_rows, np.int64)
        ends, size = np.zeros(out.num_rows, np.int64), np.zeros(out.num_rows, np.int64)
        if len(tokens):
            tokens[0], ends[0], size[0] = n.sum(), train.sum(), c.sum()
        return out.append_column("_words", pa.array(tokens)).append_column("_ends", pa.array(ends)).append_column("_bytes", pa.array(size))

    return count


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(n, at)


def _chunk_grams(texts: pa.Array, order: int, known: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunk by chunk the distinct grams with their counts, or with 0 if the texts are not to be learned."""
    for data, first in sequences(texts):
        g, c = np.unique(grams(data, first, order), return_counts=True)
        yield g, c if known else np.zeros(len(g), np.int64)


def _folded(pairs: Iterable[tuple[np.ndarray, np.ndarray]], most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The sum of sorted counts, added up whenever ``most`` or more wait and they are half of what is known."""
    known, waiting, n = (np.zeros(0, _U), np.zeros(0, np.int64)), [], 0
    for pair in pairs:
        waiting.append(pair)
        n += len(pair[0])
        if n >= max(most, len(known[0]) // 2):
            known, waiting, n = _merged([known, *waiting]), [], 0
    return _merged([known, *waiting])


def _merged(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(*(np.concatenate(x) for x in zip(*pairs, strict=True)))


def _answer(t: pa.Table) -> pa.Table:
    """Of one partition of words: to each block the counts of its words over all blocks, and how many are known."""
    hs = [np.frombuffer(x.as_py(), _U) for x in t["_p0"]]
    h, n = _summed(np.concatenate(hs), np.concatenate([_spread(x.as_py(), np.int64) for x in t["_p1"]]))
    rows = [_squeezed(n[np.searchsorted(h, x)]) for x in hs]
    known = np.zeros(len(rows), np.int64)
    known[0] = (n > 0).sum()
    return pa.table([t["_block"].combine_chunks(), t["_part"].combine_chunks(), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary()), pa.array(known)], names=["_block", "_part", "_p0", "_p1", "_known"])


def _short_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    g, n = _folded((np.cumsum(_spread(x.as_py(), _U), dtype=_U), _spread(y.as_py(), np.int64)) for b in batches for x, y in zip(b.column(0), b.column(1), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])


def _gram_answer(sent, order: int):
    """Of one partition of grams: to each block the log10 probabilities of its grams, as numbers of distinct ones."""

    def answer(t: pa.Table) -> pa.Table:
        gs = [np.cumsum(_spread(x.as_py(), _U), dtype=_U) for x in t["_p0"]]
        g, n = _summed(np.concatenate(gs), np.concatenate([_spread(x.as_py(), np.int64) for x in t["_p1"]]))
        logs = _part_trie(g[n > 0], n[n > 0], opened(sent.value), sent.value["n"], order).log10(g)
        which, values = [], []
        for x in gs:
            v, own = np.unique(logs[np.searchsorted(g, x)], return_inverse=True)
            which.append(_squeezed(own.astype(np.int64)))
            values.append(_squeezed(v))
        block, part = (np.asarray(t[c].combine_chunks(), np.int64) for c in ("_block", "_part"))
        return pa.table([pa.array(-1 - block), pa.array(-1 - part), pa.array(which, pa.binary()), pa.array(values, pa.binary()), pa.array(np.zeros(len(gs), np.int64))], names=["_block", "_part", "_p0", "_p1", "_known"])

    return answer


def _score(ends_known: int, gram_bits: int, order: int):
    """Of one block: per row tokens, known tokens, the sum of log10(count + 0.5) over words, and the model's log10 probability."""

    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        asked = [h for h, _ in _block_words(t["text"])]
        distinct = np.unique(np.concatenate(asked or [np.zeros(0, _U)]))
        replies = sorted(zip(answers["_part"].to_pylist(), answers["_p0"].to_pylist(), answers["_p1"].to_pylist(), strict=True), key=lambda r: r[0])
        counts = np.concatenate([_spread(x, np.int64) for p, x, _ in replies if p >= 0] or [np.zeros(0, np.int64)])
        # one pass over the texts: the distinct grams of every chunk, and which of them each byte ends
        chunks = []
        for data, first in sequences(t["text"]):
            own, which = np.unique(grams(data, first, order), return_inverse=True)
            chunks.append((own, which.astype(np.uint32), first))
        g, _ = _folded((own, np.zeros(len(own), np.int64)) for own, _, _ in chunks)
        place, _, _ = _gram_parts(g, gram_bits, min(KEY, order))
        logs, done = np.zeros(len(g)), 0
        for _, x, v in reversed([r for r in replies if r[0] < 0]):
            own = _spread(v, np.float64)[_spread(x, np.int64)]
            logs[place[done: done + len(own)]] = own
            done += len(own)
        n_tokens, n_known, base, model = [], [], [], []
        for h, rows in _block_words(t["text"]):
            c = counts[np.searchsorted(distinct, h)] if len(h) else np.zeros(0, np.int64)
            words, known = np.append(0.0, np.log10(c + 0.5)), np.append(0, np.cumsum(c > 0))
            n_tokens.append(np.diff(rows) + 1)
            n_known.append(known[rows[1:]] - known[rows[:-1]] + int(ends_known > 0))
            base.append(np.array([words[a + 1: b + 1].sum() for a, b in zip(rows[:-1], rows[1:], strict=True)]))
        for own, which, first in chunks:
            model.append(np.add.reduceat(logs[np.searchsorted(g, own)][which], first[:-1]))
        cols = [np.concatenate(x or [np.zeros(0)]) for x in (n_tokens, n_known, base, model)]
        return pa.table([t["doc_id"], t["train"], pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(float)), pa.array(cols[3].astype(float))], names=["doc_id", "train", "n_tokens", "n_known", "_base", "score"])

    return score


def short_grams(counts: DataFrame, key: int, n_bytes: int) -> dict:
    """The packed grams of 1 to ``key`` bytes, from (g, n) of ``key`` bytes in any number of rows."""
    got = counts.groupBy("g").agg(F.sum("n").alias("n")).toArrow()  # at most 256 ** key
    g, n = (np.asarray(got[c].combine_chunks(), np.int64) if got.num_rows else np.zeros(0, np.int64) for c in ("g", "n"))
    return packed([_shorter(g.view(_U), n, k + 1) for k in range(key)], n_bytes)


def scores(docs: DataFrame, train: Column | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    train: which rows to learn from (a condition on doc_id; all by default).
    """
    if not 0 < order < 7:
        raise ValueError("order must be 1 to 6")
    spark, size = docs.sparkSession, text_bytes(docs)
    blocks = n_blocks(spark, size, BLOCK_BYTES)
    bits, gram_bits = max(5, int(size / 30 / PART_WORDS).bit_length()), max(5, int(size / PART_BYTES).bit_length())
    learn = F.coalesce(train, F.lit(False)) if train is not None else F.lit(True)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), learn.alias("train"))
    dealt = slim.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "_block")
    sent = cut(dealt.groupBy("_block").applyInArrow(_count(bits, gram_bits, order), "_part long, _block long, _p0 binary, _p1 binary, _words long, _ends long, _bytes long"), "ppm-counts")
    words, ends, n_bytes = sent.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("_words", "_ends", "_bytes")]).first()
    low = sent.filter("_part < 0").select("_p0", "_p1").mapInArrow(_short_counts, "g long, n long")
    short = spark.sparkContext.broadcast(short_grams(low, min(KEY, order), int(n_bytes)))
    reply = "_block long, _part long, _p0 binary, _p1 binary, _known long"
    scored = sent.filter("_block < 0 and _part >= 0").select("_part", "_block", "_p0", "_p1").groupBy("_part").applyInArrow(_gram_answer(short, order), reply)
    asked = sent.filter("_block >= 0").select("_part", "_block", "_p0", "_p1")
    words_known = cut(asked.groupBy("_part").applyInArrow(_answer, reply), "ppm-answers")
    answers = words_known.unionByName(scored)  # the grams' answers are read once and go straight to their blocks
    known = words_known.agg(F.coalesce(F.sum("_known"), F.lit(0))).first()[0] + (1 if ends else 0)
    n = words + ends
    out = dealt.groupBy("_block").cogroup(answers.drop("_known").groupBy("_block")).applyInArrow(_score(ends, gram_bits, order), "doc_id long, train boolean, n_tokens long, n_known long, _base double, score double")
    base = F.col("_base") + F.lit(float(np.log10(ends + 0.5))) - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (known + 1))))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
