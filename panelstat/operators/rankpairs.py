"""Kendall's tau from inversions that are counted in sorted blocks, without a row per pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.functions.tails import kendall_p
from panelstat.plans.reuse import materialise

# points that a block is meant to hold, most blocks a side has, and keys looked at for each of its bounds
BLOCK_POINTS, MOST_BLOCKS, _LOOK = 50_000, 256, 16


def _dense(*keys: np.ndarray) -> np.ndarray:
    """0..n-1 in the order of the keys, the first key leading."""
    rank = np.empty(len(keys[0]), np.int64)
    rank[np.lexsort(keys[::-1])] = np.arange(len(rank))
    return rank


def inversions(rank: np.ndarray, weight: np.ndarray) -> int:
    """Sum of w_i w_j over i < j with rank_i > rank_j, for a permutation 0..n-1; one stable sort for each bit of a rank."""
    total = 0
    for bit in reversed(range(max(1, int(len(rank) - 1).bit_length()))):
        node = rank >> (bit + 1)
        order = np.argsort(node, kind="stable")
        rank, weight, node = rank[order], weight[order], node[order]
        upper = (rank >> bit) & 1 == 1
        before = np.cumsum(np.where(upper, weight, 0))
        starts = np.nonzero(np.append(True, node[1:] != node[:-1]))[0]
        base = np.where(starts > 0, before[starts - 1], 0)
        seen = before - np.repeat(base, np.diff(np.append(starts, len(rank))))
        total += int((seen[~upper] * weight[~upper]).sum())
    return total


def _discordant(group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Weighted pairs of one group with x and y in opposite order; equal x or equal y count nothing."""
    order = np.lexsort((y, x, group))
    return inversions(_dense(group, y, x)[order], w[order])


def _block_sums(own: str, other: str, by: list[str]):
    """Discordant pairs of one block; those whose points share both blocks are counted by the x side alone."""

    def run(table: pa.Table) -> pa.Table:
        x, y, w, cell = (table.column(c).to_numpy() for c in ("x", "y", "w", other))
        total = _discordant(np.zeros(len(x), np.int64), x, y, w)
        if own == "yb":
            total -= _discordant(cell, x, y, w)
        keys = [table.column(c).slice(0, 1) for c in by]
        return pa.table([*keys, pa.array([float(total)])], names=[*by, "d"])

    return run


def _cell_sums(by: list[str]):
    """Discordant pairs of points that differ in both blocks, from the weights of the cells."""

    def run(table: pa.Table) -> pa.Table:
        xb, yb, w = (table.column(c).to_numpy() for c in ("xb", "yb", "w"))
        grid = np.zeros((int(xb.max()) + 1, int(yb.max()) + 1))
        np.add.at(grid, (xb, yb), w)
        # weight at smaller x blocks and greater y blocks of each cell
        above = np.zeros_like(grid)
        above[1:, :-1] = np.cumsum(grid, axis=0)[:-1, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        return pa.table([*[table.column(c).slice(0, 1) for c in by], pa.array([float((grid * above).sum())])], names=[*by, "d"])

    return run


def _block(points: DataFrame, by: list[str], first: str, second: str, n_blocks: int) -> Column:
    """Number of the bounds at or below a point in the order of (by, first, second); bounds only decide how even blocks are.

    Bounds come from the points with the smallest hashes, at most _LOOK a block.
    """
    key = F.struct(*by, first, second)
    if n_blocks < 2:
        return F.lit(0)
    seen = points.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(_LOOK * n_blocks)
    bounds = sorted(tuple(r.k) for r in seen.collect())[_LOOK::_LOOK]
    if not bounds:
        return F.lit(0)
    kinds = points.select(key.alias("k")).schema["k"].dataType
    literal = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kinds.fields)]) for b in bounds])
    return F.size(F.filter(literal, lambda b: b <= key))


def kendall_tau(values: DataFrame, by: list[str], x: str, y: str, n_blocks: int | None = None) -> DataFrame:
    """(*by, tau, p, n, n_pairs): Kendall's tau-b between two scores in each group.

    Equal points become one with a weight. Points are cut into blocks twice, in the order of (x, y) and of (y, x), so that a
    value that many points share is cut as well. A discordant pair is counted once: in its x block, or in its y block, or,
    if it differs in both, from the weights of the cells, at most MOST_BLOCKS squared. Two shuffles of the points, no pair
    rows; a block grows with the points only beyond MOST_BLOCKS times BLOCK_POINTS of them.

    Rows with a null or NaN score take no part. A group with one row or a constant score has no tau and no p. The p is
    exact without ties up to 33 items, else normal with the tie-corrected variance. Group columns must not be null.
    """
    rows = values.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    rows = rows.withColumn("x", F.col("x") + F.lit(0.0)).withColumn("y", F.col("y") + F.lit(0.0))  # -0 is 0
    points = materialise(rows.groupBy(*by, "x", "y").agg(F.count("*").alias("w")), "rank_points")
    if n_blocks is None:
        n_blocks = min(MOST_BLOCKS, max(1, -(-points.count() // BLOCK_POINTS)))
    cut = points.withColumn("xb", _block(points, by, "x", "y", n_blocks).cast("bigint"))
    cut = cut.withColumn("yb", _block(points, by, "y", "x", n_blocks).cast("bigint"))
    out = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields if f.name in by] + ["d double"])
    in_x = cut.groupBy(*by, "xb").applyInArrow(_block_sums("xb", "yb", by), out)
    in_y = cut.groupBy(*by, "yb").applyInArrow(_block_sums("yb", "xb", by), out)
    cells = cut.groupBy(*by, "xb", "yb").agg(F.sum("w").alias("w"))
    apart = cells.groupBy(*by).applyInArrow(_cell_sums(by), out)
    discordant = in_x.unionByName(in_y).unionByName(apart).groupBy(*by).agg(F.sum("d").alias("d"))

    def ties(c: str) -> DataFrame:
        t = F.col("t")
        return points.groupBy(*by, c).agg(F.sum("w").cast("double").alias("t")).groupBy(*by).agg(
            F.sum(t * (t - 1) / 2).alias(f"t{c}"), F.sum(t * (t - 1) * (t - 2)).alias(f"{c}0"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{c}1"))

    w = F.col("w").cast("double")
    whole = points.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * (w - 1) / 2).alias("txy"))
    s = whole.join(ties("x"), by).join(ties("y"), by).join(discordant, by)
    s = s.withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)
    s = s.withColumn("s", F.col("pairs") - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d"))
    spread = F.sqrt((F.col("pairs") - F.col("tx")) * (F.col("pairs") - F.col("ty")))
    return s.select(
        *by, F.try_divide("s", F.nullif(spread, F.lit(0.0))).alias("tau"),
        kendall_p("n", "d", "s", "tx", "ty", "x0", "y0", "x1", "y1").alias("p"),
        F.col("n").cast("bigint").alias("n"), F.col("pairs").cast("bigint").alias("n_pairs"),
    )
