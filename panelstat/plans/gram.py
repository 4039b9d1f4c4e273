"""Pairwise moments of many raters without emitting the pairs of every case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_OUT = "item_a string, item_b string, n bigint, sx double, sy double, sxx double, syy double, sxy double"


def _flatten(col: pa.ListArray):
    """Row number, item and value of every entry of a list<struct<item, value>> column."""
    lengths = np.diff(col.offsets.to_numpy())
    flat = col.flatten()
    rows = np.repeat(np.arange(len(col)), lengths)
    return rows, flat.field(0), flat.field(1).to_numpy(zero_copy_only=False)


class _Side:
    """Grows a task-wide index of the items seen so far."""

    def __init__(self):
        self.index: dict[str, int] = {}

    def dense(self, col: pa.ListArray, n_rows: int) -> np.ndarray:
        rows, items, values = _flatten(col)
        enc = items.dictionary_encode()
        local = np.array(
            [self.index.setdefault(x, len(self.index)) for x in enc.dictionary.to_pylist()], dtype=np.int64
        )
        out = np.full((n_rows, len(self.index)), np.nan)
        if len(values):
            out[rows, local[enc.indices.to_numpy()]] = values
        return out


def _grow(total, shape):
    if total is None:
        return np.zeros((6,) + shape)
    if total.shape[1:] == shape:
        return total
    bigger = np.zeros((6,) + shape)
    bigger[:, : total.shape[1], : total.shape[2]] = total
    return bigger


def _add_short_rows(total: np.ndarray, codes, values, starts, lengths) -> None:
    """Add the pairs of rows with few entries one by one; both orders, as the products do."""
    k = total.shape[1]
    flat = total.reshape(6, -1)
    for length in np.unique(lengths[lengths > 1]):
        at = starts[lengths == length][:, None] + np.arange(length)
        i, j = np.triu_indices(length, 1)
        a, b = codes[at][:, i].ravel(), codes[at][:, j].ravel()
        x, y = values[at][:, i].ravel(), values[at][:, j].ravel()
        a, b, x, y = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([x, y]), np.concatenate([y, x])
        cell = a * k + b
        for m, w in enumerate((None, x, y, x * x, y * y, x * y)):
            flat[m] += np.bincount(cell, w, minlength=k * k)


def _same_block(side: _Side, total, col: pa.ListArray):
    """Add one batch of rows to the moments of a block with itself.

    Rows that hold a small part of the items are cheaper pair by pair than as a dense product.
    """
    _, items, values = _flatten(col)
    lengths = np.diff(col.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    enc = items.dictionary_encode()
    local = np.array([side.index.setdefault(x, len(side.index)) for x in enc.dictionary.to_pylist()], dtype=np.int64)
    k = len(side.index)
    total = _grow(total, (k, k))
    codes = local[enc.indices.to_numpy()] if len(values) else np.zeros(0, dtype=np.int64)
    short = lengths * lengths * 16 < k * k
    _add_short_rows(total, codes, values, starts[short], lengths[short])
    rest = np.nonzero(~short)[0]
    if len(rest):
        x = np.full((len(rest), k), np.nan)
        row = np.repeat(np.arange(len(rest)), lengths[rest])
        at = np.concatenate([np.arange(starts[r], starts[r] + lengths[r]) for r in rest])
        x[row, codes[at]] = values[at]
        _add_products(total, x, x)
    return total


def _add_products(total: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x0, y0 = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    for m, (p, q) in enumerate(((mx, my), (x0, my), (mx, y0), (x0**2, my), (mx, y0**2), (x0, y0))):
        total[m] += p.T @ q


def _lines(left: "_Side", right: "_Side", t: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
    """The moments of one block pair, one line per pair of items."""
    a = np.array(list(left.index), dtype=object)
    b = a if same else np.array(list(right.index), dtype=object)
    i, j = np.nonzero(t[0])
    if same:
        keep = a[i] < b[j]
        i, j = i[keep], j[keep]
    swap = a[i] > b[j]
    n, sx, sy, sxx, syy, sxy = (m[i, j] for m in t)
    cols = [
        np.where(swap, b[j], a[i]), np.where(swap, a[i], b[j]), n.astype(np.int64),
        np.where(swap, sy, sx), np.where(swap, sx, sy), np.where(swap, syy, sxx), np.where(swap, sxx, syy), sxy,
    ]
    names = ["item_a", "item_b", "n", "sx", "sy", "sxx", "syy", "sxy"]
    types = [pa.string(), pa.string(), pa.int64()] + [pa.float64()] * 5
    for start in range(0, len(i), 50_000):
        arrays = [pa.array(c[start : start + 50_000], t_) for c, t_ in zip(cols, types)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one block pair at a time: rows come in the order of their pair, so a task never holds two."""
    now, left, right, total = None, _Side(), _Side(), None
    for batch in batches:
        pair_ids = np.stack([batch.column(c).to_numpy() for c in ("lo", "hi")], axis=1)
        for lo, hi in np.unique(pair_ids, axis=0).tolist():
            if (lo, hi) != now:
                if total is not None:
                    yield from _lines(left, right, total, now[0] == now[1])
                now, left, right, total = (lo, hi), _Side(), _Side(), None
            part = batch.filter(pa.array((pair_ids == (lo, hi)).all(axis=1)))
            for start in range(0, part.num_rows, 4096):
                piece = part.slice(start, 4096)
                col = pa.concat_arrays([piece.column("a")])
                if lo == hi:
                    total = _same_block(left, total, col)
                    continue
                x = left.dense(col, piece.num_rows)
                y = right.dense(pa.concat_arrays([piece.column("b")]), piece.num_rows)
                total = _grow(total, (len(left.index), len(right.index)))
                _add_products(total, x, y)
    if total is not None:
        yield from _lines(left, right, total, now[0] == now[1])


# entries of a group whose pairs are added one by one where the items fill several blocks; sums of pairs a task holds
SHORT_GROUP, PAIR_SUMS = 128, 1_000_000


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (pairs, 6) of equal keys added up, in the order of the keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[heads], np.add.reduceat(sums[order], heads, axis=0) if len(heads) else sums


def _pairs_of(codes: np.ndarray, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (both codes, the smaller first) and moments of the pairs of different items inside rows, a bounded number at a time."""
    for length in np.unique(lengths[lengths > 1]):
        i, j = np.triu_indices(length, 1)
        own = starts[lengths == length]
        step = max(1, PAIR_SUMS // 4 // len(i))
        for lo in range(0, len(own), step):
            at = own[lo : lo + step, None] + np.arange(length)
            a, b = codes[at][:, i].ravel(), codes[at][:, j].ravel()
            x, y = values[at][:, i].ravel(), values[at][:, j].ravel()
            swap, other = a > b, a != b
            a, b, x, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, y, x), np.where(swap, x, y)
            moments = np.stack([np.ones(len(x)), x, y, x * x, y * y, x * y], axis=1)
            yield _summed((a << 32 | b)[other], moments[other])


def _short_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over short groups, pair by pair; they are handed on and started anew when they grow past the limit."""
    index: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        return _summed(np.concatenate([k for k, _ in held]), np.concatenate([s for _, s in held]))

    def lines(keys, sums):
        names = pa.array(list(index), pa.string())
        rank = np.empty(len(index), np.int64)
        rank[sorted(range(len(index)), key=list(index).__getitem__)] = np.arange(len(index))
        for lo in range(0, len(keys), 50_000):
            a, b, s = keys[lo : lo + 50_000] >> 32, keys[lo : lo + 50_000] & 0xFFFFFFFF, sums[lo : lo + 50_000]
            swap = rank[a] > rank[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            s = np.where(swap[:, None], s[:, [0, 2, 1, 4, 3, 5]], s)
            cols = [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(s[:, 0].astype(np.int64))]
            cols += [pa.array(np.ascontiguousarray(s[:, m])) for m in range(1, 6)]
            yield pa.RecordBatch.from_arrays(cols, names=["item_a", "item_b", "n", "sx", "sy", "sxx", "syy", "sxy"])

    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            col = pa.concat_arrays([batch.column("a").slice(start, 4096)])
            _, items, values = _flatten(col)
            lengths = np.diff(col.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            enc = items.dictionary_encode()
            local = np.array([index.setdefault(x, len(index)) for x in enc.dictionary.to_pylist()], dtype=np.int64)
            codes = local[enc.indices.to_numpy()] if len(values) else np.zeros(0, np.int64)
            for part in _pairs_of(codes, values, starts, lengths):
                held.append(part)
                if sum(len(k) for k, _ in held) > PAIR_SUMS:
                    held = [merged()]
                    if len(held[0][0]) > PAIR_SUMS // 2:
                        yield from lines(*held[0])
                        held = []
        if not held:
            index = {}
    if held:
        yield from lines(*merged())


# items whose moments with each other one task holds: 6 x 1000 x 1000 numbers, 48 MB
BLOCK_ITEMS = 1000


def item_blocks(cells: DataFrame, item: str) -> int:
    """Blocks of about BLOCK_ITEMS items each."""
    return max(1, -(-cells.select(item).distinct().count() // BLOCK_ITEMS))


def pair_moments(cells: DataFrame, by: str, item: str, value: str, n_blocks: int | None = None) -> DataFrame:
    """For every pair of items a < b, moments of their values over the groups that hold both.

    Each group becomes one row of a sparse matrix and every task adds up the products of its rows,
    so what is shuffled is one line per pair and task rather than one line per pair and group.
    ``n_blocks`` splits the items by hash, by default into blocks of about a thousand as counted; the
    products of the block pairs together cover every pair of items exactly once. With several blocks, groups of
    at most SHORT_GROUP entries are added pair by pair instead: blocks would grow with the square of the items, however
    few pairs the groups hold.
    """
    if n_blocks is None:
        n_blocks = item_blocks(cells, item)
    block = F.pmod(F.xxhash64(item), F.lit(n_blocks)).cast("int")
    # a fixed number of partitions keeps the products parallel however few bytes the rows have
    entries = (
        cells.filter(F.col(value).isNotNull())
        .select(by, F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"), block.alias("block"))
        .repartition(shuffle_partitions(cells), by)
    )
    listed = F.collect_list(F.struct("item", "value"))
    if n_blocks == 1:
        rows = entries.groupBy(by, "block").agg(listed.alias("v"))
        pairs = rows.select(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.col("v").alias("a"))
        pairs = pairs.withColumn("b", F.slice("a", 1, 0))
    else:
        sized = entries.filter(F.col(by).isNotNull()).withColumn("size", F.count("*").over(Window.partitionBy(by)))
        short = sized.filter(F.col("size") <= SHORT_GROUP).groupBy(by).agg(listed.alias("a")).select("a")
        rows = sized.filter(F.col("size") > SHORT_GROUP).groupBy(by, "block").agg(listed.alias("v"))
        l = rows.select(by, F.col("block").alias("lo"), F.col("v").alias("a"))
        r = rows.select(by, F.col("block").alias("hi"), F.col("v").alias("b"))
        pairs = l.join(r, by).filter("lo <= hi").select("lo", "hi", "a", "b").sortWithinPartitions("lo", "hi")
    parts = pairs.mapInArrow(_moments, _OUT)
    if n_blocks > 1:
        parts = parts.unionByName(short.mapInArrow(_short_moments, _OUT))
    return parts.groupBy("item_a", "item_b").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("sx", "sy", "sxx", "syy", "sxy")]
    )
