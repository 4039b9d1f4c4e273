"""I-Match document fingerprints over randomised lexicons.

The lexicon is all terms whose share of documents lies within a band: terms in most documents say nothing, terms in
very few are names and typing errors. Of a document's distinct lexicon terms, sorted, each randomised subset of the
lexicon keeps some and hashes them. Subsets differ in how many terms they keep (``rates``): large
ones change with any edit, small ones survive the more of a text stays. A fingerprint is the subsets' hashes in
order, eight hex digits each, and the likeness of two is the share of subsets that agree among those that
kept a term of either.

A term that is in at least ``low`` of all documents is one of at most (mean distinct terms of a document) / low such
terms, however large the corpus; so the lexicon may be sent to all tasks. Its size is checked against ``max_lexicon``.

Defined cases: terms are words in lower case (A-Z). A null text is an empty one. If no subset keeps a term
(short texts, or none of their terms in the band) the slots hash all distinct terms of the text, so that equal texts still agree
and others do not; a text without words has all slots zero and is like another such text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.llm import words as W
from panelstat.llm.common import n_blocks

LOW, HIGH = 1 / 2000, 1 / 5
RATES = (1 / 64, 1 / 128, 1 / 256, 1 / 512)
PER_RATE = 8
MAX_LEXICON = 4_000_000
BLOCK_BYTES = 16 << 20
RANGES = 1 << 14  # at most so many ranges of ids; a range is sorted and read as a stream, so it may be long
_U = np.uint64
FLUSH = 1 << 20


def _distinct(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct term hashes of each text."""
    for _, _, data, offsets in W.chunks(texts):
        data = W.lowered(data)
        starts, ends, rows = W.spans(data, offsets)
        h = W.hashes(data, starts, ends)
        for i in range(len(rows) - 1):
            yield np.unique(h[rows[i]: rows[i + 1]])


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, max_lexicon: int = MAX_LEXICON) -> np.ndarray:
    """Sorted hashes of the terms that are in low to high of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts):
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        parts, size = [], 0
        for b in batches:
            for t in _distinct(b.column(0)):
                parts.append(t)
                size += len(t)
                if size >= FLUSH:
                    yield out(parts)
                    parts, size = [], 0
        if size:
            yield out(parts)

    n_docs = docs.count()
    terms = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    kept = terms.filter((F.col("n") >= low * n_docs) & (F.col("n") <= high * n_docs)).select("h").limit(max_lexicon + 1).toArrow()
    if kept.num_rows > max_lexicon:
        raise ValueError("the lexicon is larger than max_lexicon: raise low")
    return np.sort(np.asarray(kept["h"].combine_chunks(), np.int64).view(_U)) if kept.num_rows else np.zeros(0, _U)


class Fingerprinter:
    def __init__(self, lexicon_: np.ndarray, rates=RATES, per_rate: int = PER_RATE):
        self.lexicon = lexicon_
        self.limits = [_U(int(r * 2.0**64) - 1 if r < 1 else 2**64 - 1) for r in rates for _ in range(per_rate)]
        self.seeds = [W._mixed(np.array([i + 1], _U) * _U(0x9E3779B97F4A7C15))[0] for i in range(len(self.limits))]

    def __call__(self, terms: np.ndarray) -> np.ndarray:
        """The slots (uint32) of a text's sorted distinct terms; 0 where a subset keeps none."""
        out = np.zeros(len(self.limits), np.uint32)
        inside = terms
        if len(self.lexicon) and len(terms):
            at = np.minimum(np.searchsorted(self.lexicon, terms), len(self.lexicon) - 1)
            inside = terms[self.lexicon[at] == terms]
        elif not len(self.lexicon):
            inside = terms[:0]
        for i, (seed, limit) in enumerate(zip(self.seeds, self.limits, strict=True)):
            kept = inside[W._mixed(inside ^ seed) <= limit] if len(inside) else inside
            if len(kept):
                out[i] = xxhash.xxh32_intdigest(kept.tobytes(), i) or 1
        if len(terms) and not out.any():
            raw = terms.tobytes()
            out[:] = [xxhash.xxh32_intdigest(raw, i) or 1 for i in range(len(out))]
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = (a != 0) | (b != 0)
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else 1.0


def fingerprint(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    lex = docs.sparkSession.sparkContext.broadcast(lexicon(docs, low, high))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(lex.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_hex(make(t)) for t in _distinct(b.column(1))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fingerprint string")


def _hex(slots: np.ndarray) -> str:
    return slots.astype(">u4").tobytes().hex()


def _edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_edits(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The document that follows is the next in descending doc_id, null ids last, equal ids by text; after
    the last comes the first. Documents are dealt to ranges of ids whose first ids are real ones; a range's first row goes to the range
    before as well, so every row meets the one that follows it and texts are shuffled once. The ids that
    bound the ranges come from a sample of about 16 ids a range, which decides no more than how even the ranges are.
    Rows of one id are one range, whatever their number.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, size, top = own.agg(F.count(F.lit(1)), F.sum(F.octet_length("text")), F.max("doc_id")).first()
    blocks = min(RANGES, n_blocks(spark, size or 0, BLOCK_BYTES))
    every = 16
    sample = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (every * blocks)))) == 0).select("doc_id").dropna().distinct()
    ids = sorted((r[0] for r in sample.collect()), reverse=True)  # about 16 ids a range
    firsts = np.array(sorted({*ids[every // 2::every], *([top] if top is not None else [])}, reverse=True), np.int64)
    lex = spark.sparkContext.broadcast(lexicon(own, low, high))
    # range k holds ids from firsts[k] down to above firsts[k + 1]; null ids end the last range
    last = max(0, len(firsts) - 1)

    @F.pandas_udf("array<struct<r:int,trail:boolean>>")
    def ranges(ids_: pd.Series) -> pd.Series:
        out = []
        for x in ids_.astype("Int64"):
            if pd.isna(x):
                out.append([(last, False)] + ([(last, True)] if not len(firsts) else []))
                continue
            k = len(firsts) - int(np.searchsorted(firsts[::-1], x, "left")) - 1
            out.append([(k, False)] + ([(k - 1 if k else last, True)] if firsts[k] == x else []))
        return pd.Series(out)

    dealt = own.select("doc_id", "text", F.explode(ranges("doc_id")).alias("s")).select("doc_id", "text", "s.*")
    dealt = dealt.repartition(blocks, "r").sortWithinPartitions("r", "trail", F.col("doc_id").desc_nulls_last(), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(lex.value)
        held = None  # (range, doc_id, text, slots) that waits for the row after it
        for b in batches:
            col_ids, texts, rs, trails = (b.column(i) for i in range(4))
            sizes = np.cumsum(np.asarray(pa.compute.binary_length(texts), np.int64)) // W.CHUNK
            for a, z in zip(starts := np.flatnonzero(np.append(True, sizes[1:] != sizes[:-1])), [*starts[1:], b.num_rows], strict=True):
                part = texts.slice(a, z - a)
                slots = [make(t) for t in _distinct(part)]
                rows = []
                for i, (x, text, r, trail) in enumerate(zip(col_ids.slice(a, z - a).to_pylist(), part.to_pylist(), rs.slice(a, z - a).to_pylist(), trails.slice(a, z - a).to_pylist(), strict=True)):
                    if held and held[0] == r:
                        rows.append((held[1], held[2], held[3], text, slots[i]))
                    held = None if trail else (r, x, text, slots[i])
                if not rows:
                    continue
                edits = [_edited(t, f) for _, t, _, f, _ in rows]
                new = [make(t) for t in _distinct(pa.array(edits, pa.string()))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                    pa.array([_hex(r[2]) for r in rows], pa.string()), pa.array([_hex(s) for s in new], pa.string()),
                    pa.array([likeness(r[2], s) for r, s in zip(rows, new, strict=True)], pa.float64()),
                    pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
                ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
