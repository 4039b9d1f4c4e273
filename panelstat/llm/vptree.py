"""Nearest neighbours with a vantage-point tree per shard.

Vectors are dealt to shards by a hash of their place, so a shard holds about ``shard_rows`` vectors whatever repeats.
Queries are dealt to blocks the same way. Every (shard, block) pair is one group: it builds the
shard's tree, takes the block's queries through it together, and returns each query's nearest there. The best of
all shards are the answer. Queries meet all rows, but pairs are never rows.

A tree node splits its vectors at the median distance from a vantage point and keeps the span of distances
on either side. By the triangle inequality a side is no nearer than the gap between a query's own distance and that
span. A side is left out if gap * factor is over the distance of the k-th nearest so far: factor 1 is
exact, a larger one leaves out more.

Distances are Euclidean, summed over the components in order in double precision; ties go to the smaller id.
Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no
part; only vectors of a query's own dimension are its candidates; rows that share an id are
rows of their own, each a candidate for the others and, if a query, with an answer of its own; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstat.llm.common import cut

SHARD_ROWS, BLOCK_ROWS, LEAF = 16_384, 32_768, 128
K = 10
FACTOR = 1.0


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, rows) Euclidean distances, components summed in order."""
    out = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        d = q[:, j, None] - x[None, :, j]
        out += d * d
    return np.sqrt(out)


class VPTree:
    """Nodes as tuples: a leaf has its rows, an inner node its vantage point, two children and their spans of distances."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF, places: np.ndarray | None = None):
        self.x, self.ids, self.leaf, self.places = x, ids, leaf, ids if places is None else places
        self.seen = 0
        self.root = self._node(np.arange(len(x)))

    def _node(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        far = distances(self.x[rows[:1]], self.x[rows])[0]
        at = rows[int(far.argmax())]
        d = distances(self.x[at:at + 1], self.x[rows])[0]
        order = np.argpartition(d, len(rows) // 2)
        near, far = order[: len(rows) // 2], order[len(rows) // 2:]
        return at, self._node(rows[near]), self._node(rows[far]), (d[near].min(), d[near].max()), (d[far].min(), d[far].max())

    def nearest(self, q: np.ndarray, q_places: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of each query's k nearest rows at another place; missing ones are at infinity."""
        self.best_d = np.full((len(q), k), np.inf)
        self.best_i = np.full((len(q), k), np.iinfo(np.int64).max)
        self.q, self.q_places, self.k, self.factor = q, q_places, k, factor
        self._visit(self.root, np.arange(len(q)))
        return self.best_i, self.best_d

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            step = max(1, (1 << 20) // max(1, len(node)))
            for a in range(0, len(who), step):
                self._leaf(node, who[a: a + step])
            return
        at, near, far, near_span, far_span = node
        d = distances(self.q[who], self.x[at:at + 1])[:, 0]
        inside = d <= (near_span[1] + far_span[0]) / 2
        for first, second, span, mine in ((near, far, far_span, inside), (far, near, near_span, ~inside)):
            w, own = who[mine], d[mine]
            self._visit(first, w)
            gap = np.maximum(0, np.maximum(span[0] - own, own - span[1]))
            # rounding must not prune what is exactly as near
            self._visit(second, w[gap * self.factor * (1 - 1e-12) - 1e-12 <= self.best_d[w, -1]])

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        self.seen += len(rows) * len(who)
        d = distances(self.q[who], self.x[rows])
        d[self.q_places[who][:, None] == self.places[rows][None, :]] = np.inf
        better = (d <= self.best_d[who, -1:]).any(axis=1)
        who, d = who[better], d[better]
        if not len(who):
            return
        all_d = np.concatenate([self.best_d[who], d], axis=1)
        all_i = np.concatenate([self.best_i[who], np.broadcast_to(self.ids[rows], d.shape)], axis=1)
        all_i[np.isinf(all_d)] = np.iinfo(np.int64).max
        order = np.lexsort((all_i, all_d), axis=1)[:, : self.k]
        self.best_d[who] = np.take_along_axis(all_d, order, 1)
        self.best_i[who] = np.take_along_axis(all_i, order, 1)


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t["v"].combine_chunks().flatten()
    return np.asarray(flat, np.float64).reshape(t.num_rows, -1)


def _cell(k: int, factor: float):
    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, found = np.zeros(0, np.int64), np.zeros((0, k))
        who, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if queries.num_rows and rows.num_rows:
            who, place = (np.asarray(queries[c].combine_chunks(), np.int64) for c in ("id", "place"))
            tree = VPTree(_matrix(rows), np.asarray(rows["id"].combine_chunks(), np.int64), places=np.asarray(rows["place"].combine_chunks(), np.int64))
            ids, found = tree.nearest(_matrix(queries), place, k, factor)
        ok = np.isfinite(found).ravel()
        return pa.table([pa.array(np.repeat(place, k)[ok]), pa.array(np.repeat(who, k)[ok]), pa.array(ids.ravel()[ok]), pa.array(found.ravel()[ok])], names=["place", "query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is a query its k nearest other rows, nearest first."""
    v = F.col("v")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    own = own.filter(F.col("id").isNotNull() & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)))
    # a row's place is its number in the written table, so it is the same on both sides of the search
    own = cut(own.withColumn("place", F.monotonically_increasing_id()), "vectors")
    n, n_queries = own.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / block_rows))
    deal = lambda parts: F.pmod(F.xxhash64("place"), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))
    cell = ["dim", "shard", "block"]
    rows = own.select("place", "id", "v", F.size("v").alias("dim"), deal(shards).alias("shard"), every(blocks).alias("block"))
    queries = own.filter("q").select("place", "id", "v", F.size("v").alias("dim"), every(shards).alias("shard"), deal(blocks).alias("block"))
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of its own, not those of the other side
    found = queries.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(_cell(k, float(factor)), "place long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("place").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
