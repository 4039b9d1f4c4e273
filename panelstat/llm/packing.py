"""Conflict-constrained best-fit packing of documents into bins of ``capacity`` words.

Documents are dealt to groups of about ``group_rows`` by a hash, so a source or a cluster that holds a third of all rows
spreads over all groups; each group fills bins of its own, largest piece first. The open bins of a group are a list
in the order of their room. A piece goes to its successor in that list, the bin with the least room that still
holds it; if that bin conflicts, the search goes on to the next larger room until a bin agrees, and else opens a new one.

Every bin carries two bitmaps: the duplicate clusters it has, and the sources that are full in it. Two documents of a
cluster never share a bin. A source is full in a bin once it has ``source_share`` of the capacity there (0: after its
first piece), and then conflicts.

A document longer than the capacity is cut into pieces: whole bins, which are closed at once, and a rest that is packed.

Defined cases: a null text has no words; documents without words take no room but a place; null sources are one source;
documents with a null cluster conflict with none; equal rows are packed each; an empty table has no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstat.llm.common import cut, n_words

CAPACITY, GROUP_ROWS, SOURCE_SHARE = 2048, 4096, 0.5


def best_fit(sizes: Iterable[int], sources: Iterable, clusters: Iterable, capacity: int, source_share: float = SOURCE_SHARE) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the order given. Sources are any keys; a cluster may be None."""
    limit = source_share * capacity
    number: dict = {}
    of_source: dict = {}
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    has_clusters: list[int] = []
    full_sources: list[int] = []
    words: list[dict[int, int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        c = 0 if cluster is None else 1 << number.setdefault(cluster, len(number))
        s = of_source.setdefault(source, len(of_source))
        bit = 1 << s
        at = bisect_left(room, (size, -1))
        while at < len(room) and (has_clusters[room[at][1]] & c or full_sources[room[at][1]] & bit):
            at += 1
        if at < len(room):
            left, bin_ = room.pop(at)
        else:
            left, bin_ = capacity, len(words)
            has_clusters.append(0)
            full_sources.append(0)
            words.append({})
        out.append((bin_, capacity - left))
        has_clusters[bin_] |= c
        words[bin_][s] = words[bin_].get(s, 0) + size
        if words[bin_][s] >= limit:
            full_sources[bin_] |= bit
        if left > size:
            insort(room, (left - size, bin_))
    return out


def _pack(capacity: int, source_share: float, id_type: pa.DataType):
    def pack(t: pa.Table) -> pa.Table:
        cols = {c: t[c].to_pylist() for c in ("_id", "_source", "_cluster", "_size", "_h", "_row")}
        pieces = []  # (row, piece, first word, words)
        bins: list[tuple[int, int]] = []
        order = sorted(range(t.num_rows), key=lambda i: (cols["_size"][i], cols["_h"][i], cols["_row"][i]), reverse=True)
        rests, whole = [], []
        for i in order:
            n = cols["_size"][i] // capacity if cols["_size"][i] > capacity else 0
            whole += [(i, p, p * capacity, capacity) for p in range(n)]
            if cols["_size"][i] > n * capacity or not n:
                rests.append((i, n, n * capacity, cols["_size"][i] - n * capacity))
        rests.sort(key=lambda p: -p[3])
        # only clusters with several documents here need a bit
        many, counts = np.unique([c for c in cols["_cluster"] if c is not None], return_counts=True)
        several = set(many[counts > 1].tolist())
        found = best_fit([p[3] for p in rests], [cols["_source"][p[0]] for p in rests], [c if (c := cols["_cluster"][p[0]]) in several else None for p in rests], capacity, source_share)
        used = max((b for b, _ in found), default=-1) + 1
        bins = found + [(used + k, 0) for k in range(len(whole))]
        pieces = rests + whole
        group = t["_group"][0].as_py()
        take = lambda c: t[c].take(pa.array([p[0] for p in pieces], pa.int64()))
        fill: dict[int, int] = {}
        for (b, _), p in zip(bins, pieces, strict=True):
            fill[b] = fill.get(b, 0) + p[3]
        num = lambda x: pa.array(x, pa.int64())
        return pa.table([
            take("_id").cast(id_type), take("_source"), take("_cluster"), take("_size"), num([p[1] for p in pieces]), num([p[2] for p in pieces]), num([p[3] for p in pieces]),
            num([(group << 24) + b for b, _ in bins]), num([o for _, o in bins]), num([fill[b] for b, _ in bins]),
        ], names=["doc_id", "source", "cluster", "n_words", "piece", "first_word", "words", "bin_id", "bin_offset", "bin_words"])

    return pack


def text_cluster(text: Column) -> Column:
    """Texts that are equal but for case (A-Z) and white space are one cluster."""
    plain = F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    return F.xxhash64(plain)


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, group_rows: int = GROUP_ROWS, source_share: float = SOURCE_SHARE) -> DataFrame:
    """One row per piece: doc_id, source, cluster, n_words (of the document), piece, first_word, words, bin_id, bin_offset, bin_words.

    cluster: a number that near or exact copies share; by default that of the text.
    """
    cluster = text_cluster(F.coalesce("text", F.lit(""))) if cluster is None else cluster.cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"), cluster.alias("_cluster"), n_words(F.col("text")).alias("_size"), F.monotonically_increasing_id().alias("_row"))
    slim = cut(slim.withColumn("_h", F.xxhash64("_id", "_cluster", "_source")), "pack-sizes")
    groups = max(1, -(-slim.count() // group_rows))
    # equal rows go to different groups
    dealt = slim.withColumn("_group", F.pmod(F.xxhash64("_h", "_row"), F.lit(groups)))
    schema = T.StructType().add("doc_id", "long").add("source", "string").add("cluster", "long")
    for c in ("n_words", "piece", "first_word", "words", "bin_id", "bin_offset", "bin_words"):
        schema = schema.add(c, "long")
    return dealt.groupBy("_group").applyInArrow(_pack(capacity, source_share, pa.int64()), schema)
