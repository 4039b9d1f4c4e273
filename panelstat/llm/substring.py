"""Substring dedup with difference-cover anchors.

A run of ``width`` words that an earlier document (a smaller doc_id) has as well is cut from the later one.
Anchors are shorter windows, hashed only at word positions whose remainder modulo ``period`` lies in a
difference cover. For any two positions some shift below the period brings both to covered remainders,
so two copies of a run of ``anchor + period - 1`` words share an aligned anchor, whatever their positions. With
period 7, cover {0, 1, 3} and anchors of 7 words that is 13 words, from 3 of 7 positions.

1. Every block of documents sends its distinct anchor hashes to the hash's partition, which returns those that
   another document has too.
2. Shared anchors extend to the runs of ``width`` words around them. Blocks send these runs' hashes
   with the smallest doc_id they have; the partition returns those that another block has from a smaller one.
3. Blocks mark the words of such runs, and of runs that repeat between their own documents, and cut them.

Blocks and hash partitions exchange sorted arrays, each hash once per block, so a passage that a third of all
documents share costs one entry a block. Blocks are hash partitions of documents and the texts are shuffled once:
the three steps read the same exchange. Windows are told apart by 64-bit hashes.

Defined cases: a null or empty text has no words. Rows with equal doc_id are no smaller than each other, so
neither loses words to the other. A null doc_id is larger than all others. Runs are judged on the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstat.llm import words as W
from panelstat.llm.arrays import blobs, grouped, ids_of, member
from panelstat.llm.common import n_blocks, text_bytes

WIDTH, PERIOD, COVER = 13, 7, (0, 1, 3)
BLOCK_BYTES, PART_ANCHORS = 8 << 20, 1 << 18
_U = np.uint64


def _anchors(hashed: np.ndarray, rows: np.ndarray, anchor: int, period: int, cover: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows at covered positions that lie within a row."""
    h = W.windows(hashed, anchor)
    place = np.arange(len(h))
    row = np.searchsorted(rows, place, "right") - 1
    covered = np.zeros(period, bool)
    covered[list(cover)] = True
    at = np.flatnonzero(covered[(place - rows[row]) % period] & (place + anchor <= rows[row + 1])) if len(h) else place
    return at, h[at]


def _send_anchors(bits: int, anchor: int, period: int, cover: tuple):
    def send(t: pa.Table) -> pa.Table:
        ids = ids_of(t["doc_id"])
        hs, ds = [], []
        for a, b, data, offsets in W.chunks(t["text"]):
            starts, ends, rows = W.spans(data, offsets)
            at, h = _anchors(W.hashes(data, starts, ends), rows, anchor, period, cover)
            hs.append(h)
            ds.append(ids[a:b][np.searchsorted(rows, at, "right") - 1])
        h, low, high = grouped(np.concatenate(hs or [np.zeros(0, _U)]), np.concatenate(ds or [np.zeros(0, np.int64)]))
        # 32 bits below the partition's: chance matches are sorted out by the next step
        short = (h >> _U(32 - bits)).astype(np.uint32)
        return blobs(t["_block"][0].as_py(), bits, h, short, low != high)

    return send


def _shared_anchors(t: pa.Table) -> pa.Table:
    """Of one partition of anchors: to each block those of its anchors that it or others have in two documents."""
    parts = [np.frombuffer(x.as_py(), np.uint32) for x in t["_p0"]]
    several = np.concatenate([np.frombuffer(x.as_py(), bool) for x in t["_p1"]])
    h = np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    # a match within one block that its flag denies is a chance match of shortened hashes and does no harm
    twice = several[order] | np.append(False, same) | np.append(same, False)
    shared = np.unique(s[twice])
    kept = [p[member(p, shared)] for p in parts]
    return pa.table([t["_block"].combine_chunks(), t["_part"].combine_chunks(), pa.array([k.tobytes() for k in kept], pa.binary())], names=["_block", "_part", "_p0"]).filter(pa.array([len(k) > 0 for k in kept], pa.bool_()))


def _send_runs(bits: int, width: int, anchor: int, period: int, cover: tuple):
    def send(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return blobs(0, bits, np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))
        parts = zip(answers["_part"].to_pylist(), answers["_p0"], strict=True)
        shared = np.sort(np.concatenate([(_U(p) << _U(32)) | np.frombuffer(x.as_py(), np.uint32).astype(_U) for p, x in parts]))
        ids = ids_of(t["doc_id"])
        hs, ds = [], []
        for a, b, data, offsets in W.chunks(t["text"]):
            starts, ends, rows = W.spans(data, offsets)
            hashed = W.hashes(data, starts, ends)
            at, h = _anchors(hashed, rows, anchor, period, cover)
            at = at[member(h >> _U(32 - bits), shared)]
            if not len(at):
                continue
            # an anchor at p can lie in the runs that begin from p - (period - 1) to p
            mark = np.zeros(len(hashed) + 1, np.int32)
            np.add.at(mark, np.maximum(at - (period - 1), rows[np.searchsorted(rows, at, "right") - 1]), 1)
            np.add.at(mark, at + 1, -1)
            runs = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            row = np.searchsorted(rows, runs, "right") - 1
            ok = runs + width <= rows[row + 1]
            runs, row = runs[ok], row[ok]
            hs.append(W.windows(hashed, width)[runs])
            ds.append(ids[a:b][row])
        h, low, _ = grouped(np.concatenate(hs or [np.zeros(0, _U)]), np.concatenate(ds or [np.zeros(0, np.int64)]))
        return blobs(t["_block"][0].as_py(), bits, h, h, low)

    return send


def _earlier_runs(t: pa.Table) -> pa.Table:
    """Of one partition of runs: to each block those of its runs that a smaller doc_id of another block has."""
    hs = [np.frombuffer(x.as_py(), _U) for x in t["_p0"]]
    ds = [np.frombuffer(x.as_py(), np.int64) for x in t["_p1"]]
    h, low, _ = grouped(np.concatenate(hs), np.concatenate(ds))
    kept = [x[low[np.searchsorted(h, x)] < d] for x, d in zip(hs, ds, strict=True)]
    return pa.table([t["_block"].combine_chunks(), pa.array([k.tobytes() for k in kept], pa.binary())], names=["_block", "_p0"]).filter(pa.array([len(k) > 0 for k in kept], pa.bool_()))


def _cut_runs(width: int, carried: list[str]):
    def cut(t: pa.Table, answers: pa.Table) -> pa.Table:
        ids = ids_of(t["doc_id"]) if t.num_rows else np.zeros(0, np.int64)
        earlier = np.sort(np.concatenate([np.frombuffer(x.as_py(), _U) for x in answers["_p0"]])) if answers.num_rows else np.zeros(0, _U)
        seen, hs, ds = [], [], []
        for a, b, data, offsets in W.chunks(t["text"]):
            starts, ends, rows = W.spans(data, offsets)
            h = W.windows(W.hashes(data, starts, ends), width)
            row = np.searchsorted(rows, np.arange(len(h)), "right") - 1
            runs = np.flatnonzero(np.arange(len(h)) + width <= rows[row + 1]) if len(h) else np.zeros(0, np.int64)
            seen.append((data, starts, ends, rows, runs))
            hs.append(h[runs])
            ds.append(ids[a:b][row[runs]])
        all_h, all_d = np.concatenate(hs or [np.zeros(0, _U)]), np.concatenate(ds or [np.zeros(0, np.int64)])
        gone = member(all_h, earlier)
        # runs that repeat between documents of this block
        order = np.argsort(all_h)
        s = all_h[order]
        begin = np.append(True, s[1:] != s[:-1])
        at = np.flatnonzero(begin)
        if len(s):
            low = np.minimum.reduceat(all_d[order], at)
            gone[order] |= all_d[order] > low[np.cumsum(begin) - 1]
        kept, n_all, n_gone, done = [], [], [], 0
        for data, starts, ends, rows, runs in seen:
            mark = np.zeros(len(starts) + 1, np.int32)
            own = runs[gone[done: done + len(runs)]]
            done += len(runs)
            np.add.at(mark, own, 1)
            np.add.at(mark, own + width, -1)
            out = np.cumsum(mark)[:-1] > 0
            lost = np.append(0, np.cumsum(out))
            raw = data.tobytes()
            for i in range(len(rows) - 1):
                a, b = rows[i], rows[i + 1]
                n_all.append(int(b - a))
                n_gone.append(int(lost[b] - lost[a]))
                if not n_gone[-1]:
                    kept.append(b" ".join(raw[starts[a]: ends[b - 1]].split()) if b > a else b"")
                else:
                    stay = np.flatnonzero(~out[a:b]) + a
                    kept.append(b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
        new = {"_n": pa.array(n_all, pa.int64()), "_gone": pa.array(n_gone, pa.int64()), "_kept": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table([t[c] for c in ["doc_id", *carried]] + list(new.values()), names=["doc_id", *carried, *new])

    return cut


def dedup(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple = COVER, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space).

    With ``carry`` the input's rows instead, in their columns: text is the kept words where any went, and else as it was.
    """
    anchor = width - period + 1
    if anchor < 1 or any(not any((a - b) % period == d for a in cover for b in cover) for d in range(period)):
        raise ValueError("cover must be a difference cover of the period, and the period no longer than the width")
    spark, size = docs.sparkSession, text_bytes(docs)
    blocks = 4 * n_blocks(spark, size, 4 * BLOCK_BYTES)
    bits = max(6, int(size / 6 * len(cover) / period / PART_ANCHORS).bit_length())
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([F.struct("*").dropFields("text").alias("_row"), F.col("text").isNull().alias("_null")] if carry else []))
    slim = slim.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    dealt = slim.repartition(blocks // 4, "_block")
    texts = dealt.select("doc_id", "text", "_block")
    args = (anchor, period, tuple(cover))
    blob = "_part long, _block long, _p0 binary, _p1 binary"
    sent = texts.groupBy("_block").applyInArrow(_send_anchors(bits, *args), blob)
    shared = sent.groupBy("_part").applyInArrow(_shared_anchors, "_block long, _part long, _p0 binary")
    runs = texts.groupBy("_block").cogroup(shared.groupBy("_block")).applyInArrow(_send_runs(bits, width, *args), blob)
    earlier = runs.groupBy("_part").applyInArrow(_earlier_runs, "_block long, _p0 binary")
    if not carry:
        out = texts.groupBy("_block").cogroup(earlier.groupBy("_block")).applyInArrow(_cut_runs(width, []), "doc_id long, _n long, _gone long, _kept string")
        return out.select("doc_id", F.col("_n").alias("n_words"), F.col("_gone").alias("n_removed"), F.col("_kept").alias("kept"))
    schema = T.StructType([dealt.schema[c] for c in ("doc_id", "text", "_null", "_row")]).add("_n", "long").add("_gone", "long").add("_kept", "string")
    out = dealt.groupBy("_block").cogroup(earlier.groupBy("_block")).applyInArrow(_cut_runs(width, ["text", "_null", "_row"]), schema)
    text = F.when(F.col("_gone") > 0, F.col("_kept")).when(~F.col("_null"), F.col("text"))
    return out.select(*[(text if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
