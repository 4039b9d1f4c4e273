"""Softmax profiles and the divergences between them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstat.plans.blocks import block_pairs
from panelstat.schema import ATTRIBUTES


def check_temperature(t) -> None:
    if isinstance(t, (int, float)) and t <= 0:
        raise ValueError("temperature must be positive")


def softmax(beta, temperature=1.0) -> Column:
    """Softmax of an array column; shifted by its maximum so that it cannot overflow."""
    check_temperature(temperature)
    b = F.col(beta) if isinstance(beta, str) else beta
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform(b, lambda x: x / t)
    e = F.transform(scaled, lambda x: F.exp(x - F.array_max(scaled)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def softmax_long(df: DataFrame, by: list[str], value: str, temperature: float = 1.0) -> DataFrame:
    """Softmax over the rows of a group, for any number of attributes."""
    check_temperature(temperature)
    w = Window.partitionBy(*by)
    scaled = F.col(value) / F.lit(float(temperature))
    e = df.withColumn("_s", scaled).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return e.withColumn("share", F.col("_e") / F.sum("_e").over(w)).drop("_s", "_e")


def jsd(p, q) -> Column:
    """Base-2 Jensen-Shannon divergence of two array columns, clamped at 0; 0 log 0 is 0."""
    p = F.col(p) if isinstance(p, str) else p
    q = F.col(q) if isinstance(q, str) else q

    def term(a, b):
        m = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0) + F.when(b > 0, b * F.log2(b / m)).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda acc, x: acc + x)
    return F.greatest(total / 2, F.lit(0.0))


def value_profiles(fits: DataFrame, temperature: float = 1.0, column: str = "beta") -> DataFrame:
    """Profile per fitted row."""
    return fits.withColumn("profile", softmax(column, temperature))


def long_profiles(profiles: DataFrame, keys: list[str], attributes: list[str] = ATTRIBUTES) -> DataFrame:
    names = F.array(*[F.lit(a) for a in attributes])
    rows = profiles.select(*keys, F.explode(F.arrays_zip(names.alias("attribute"), F.col("profile").alias("share"))).alias("z"))
    return rows.select(*keys, "z.attribute", "z.share")


def jsd_matrix(profiles: DataFrame, key: str = "rater", n_blocks: int = 4) -> DataFrame:
    """Divergence of every pair of profiles; the matrix is symmetric with a zero diagonal."""
    pairs = block_pairs(profiles.select(key, "profile"), key, n_blocks)
    return pairs.select(
        F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), jsd("a.profile", "b.profile").alias("jsd")
    )


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Base-2 Jensen-Shannon divergence of every row of p with every row of q."""
    out = np.zeros((len(p), len(q)))
    for k in range(p.shape[1]):
        a, b = p[:, k, None], q[None, :, k]
        m = (a + b) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(a > 0, a * np.log2(a / m), 0.0) + np.where(b > 0, b * np.log2(b / m), 0.0)
    return np.maximum(out / 2, 0.0)


def row_divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Base-2 Jensen-Shannon divergence of each row of p with the same row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return np.maximum(out.sum(axis=1) / 2, 0.0)


# items of a block whose divergences from another block a task adds up; rows of them held at a time
TOTAL_BLOCK, TOTAL_ROWS = 4096, 256


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``_divergence`` a strip of rows at a time."""
    return np.concatenate([_divergence(p[at : at + TOTAL_ROWS], q) for at in range(0, len(p), TOTAL_ROWS)])


# divergences are given back to this; profiles that need more factors have none
FACTOR_ERROR, FACTORS = 1e-11, 512


def factors(p: np.ndarray) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]] | None:
    """Function of rows lo..hi-1 to (a, F), so that D_ij is a_i + a_j - F_i . F_j within FACTOR_ERROR for all rows; None if that takes many factors.

    The root of the divergence is a distance of a Hilbert space, so K_ij = D_io + D_jo - D_ij is positive semidefinite for any o. Its pivoted
    Cholesky factors leave a remainder with the same property, none of whose entries exceeds the largest on its diagonal: the bound
    is known, not assumed. Only the pivots and the diagonal are held.
    """
    if not np.isfinite(p).all() or (p < 0).any():
        return None
    centre = p.mean(axis=0)[None]

    def against(rows, to):
        return divergences(rows, to) if len(rows) else np.zeros((0, len(to)))

    a = against(p, centre)[:, 0]
    left, pivots = 2 * a, []
    chol = np.zeros((FACTORS, FACTORS))
    pending = 16
    while left.max(initial=0.0) > FACTOR_ERROR:
        if len(pivots) >= min(FACTORS, len(p)):
            return None
        # a block of pivots, each the largest remainder among a few hundred of the largest; then the diagonal of all rows is made anew
        some = np.argsort(-left, kind="stable")[: 16 * pending]
        kernel = a[some][:, None] + a[some] - against(p[some], p[some])
        if pivots:
            old = _solved(chol[: len(pivots), : len(pivots)], a[some][:, None] + a[pivots] - against(p[some], p[pivots]))
            kernel -= old @ old.T
        rest, fresh = left[some].copy(), []
        for _ in range(pending):
            k = int(rest.argmax())
            if rest[k] <= FACTOR_ERROR or len(pivots) + len(fresh) >= FACTORS:
                break
            column = kernel[:, k] / np.sqrt(rest[k])
            fresh.append(int(some[k]))
            kernel -= np.outer(column, column)
            rest = np.maximum(np.minimum(rest, np.diag(kernel)), 0.0)
            rest[k] = 0.0
        if not fresh:
            return None
        pivots += fresh
        m = len(pivots)
        square = a[pivots][:, None] + a[pivots] - divergences(p[pivots], p[pivots])
        try:
            chol[:m, :m] = np.linalg.cholesky(square)
        except np.linalg.LinAlgError:
            return None
        for lo in range(0, len(p), TOTAL_BLOCK):
            f = _solved(chol[:m, :m], a[lo : lo + TOTAL_BLOCK, None] + a[pivots] - divergences(p[lo : lo + TOTAL_BLOCK], p[pivots]))
            left[lo : lo + TOTAL_BLOCK] = 2 * a[lo : lo + TOTAL_BLOCK] - (f * f).sum(axis=1)
        left[pivots] = 0.0
    m = len(pivots)

    def of(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if not m:
            return a[lo:hi], np.zeros((len(a[lo:hi]), 1))
        return a[lo:hi], _solved(chol[:m, :m], a[lo:hi, None] + a[pivots] - divergences(p[lo:hi], p[pivots]))

    return of


def _solved(lower: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows @ inverse(lower).T"""
    return np.linalg.solve(lower, rows.T).T


def _cell_totals(n_keys: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, cell: pa.Table) -> pa.Table:
        lo, hi = key[-2].as_py(), key[-1].as_py()
        block = cell.column("block").to_numpy()
        out = []

        def side(which):
            t = cell.filter(pa.array(block == which)).combine_chunks()
            p = t.column("profile").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return t.column("item"), p.reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))

        (names, p), (others, q) = side(lo), side(hi)
        totals, theirs = np.zeros(len(p)), np.zeros(len(q))
        if len(p) and len(q):
            for at in range(0, len(p), TOTAL_ROWS):
                d = _divergence(p[at : at + TOTAL_ROWS], q)
                totals[at : at + TOTAL_ROWS] = d.sum(axis=1)
                theirs += d.sum(axis=0)
        out = [(names, totals)] if lo == hi else [(names, totals), (others, theirs)]
        item = pa.chunked_array([c for n, _ in out for c in n.chunks], names.type)
        n = len(item)
        ons = [pa.array([k.as_py()] * n, k.type) for k in key[:n_keys]]
        return pa.table(ons + [item, pa.array(np.concatenate([x for _, x in out]))], names=[f"k{i}" for i in range(n_keys)] + ["item", "total"])

    return run


def divergence_totals(items: DataFrame, key: str, on: list[str] = (), n_blocks: int | None = None) -> DataFrame:
    """(on..., key, total): the sum of each item's divergences from all others with equal ``on``; items have a ``profile``.

    Blocks of items meet two by two, in strips of a block's rows: a task holds two blocks of profiles, and what it hands
    on is one line per item. The divergences, whose number is the square of the items', are never rows.
    """
    if n_blocks is None:
        n_blocks = max(8, -(-items.count() // TOTAL_BLOCK))
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    spread = items.select(*on, block.alias("block"), F.col(key).alias("item"), "profile", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_o"))
    cells = spread.select(*on, F.least("block", "_o").alias("_lo"), F.greatest("block", "_o").alias("_hi"), "block", "item", "profile")
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = "".join(f"k{i} {types[c]}, " for i, c in enumerate(on)) + f"item {types[key]}, total double"
    parts = cells.groupBy(*on, "_lo", "_hi").applyInArrow(_cell_totals(len(on)), schema)
    for i, c in enumerate(on):
        parts = parts.withColumnRenamed(f"k{i}", c)
    return parts.groupBy(*on, F.col("item").alias(key)).agg(F.sum("total").alias("total"))


def mean_within_group(matrix: DataFrame, members: DataFrame) -> DataFrame:
    """Mean divergence over the pairs inside each group of (group, member).

    ``matrix`` has a line per pair, or is a table of profiles (rater, profile): then pairs are sums in blocks and never rows.
    """
    if "profile" in matrix.columns:
        items = members.join(matrix.select(F.col("rater").alias("member"), "profile"), "member")
        sums = divergence_totals(items, "member", ["group"]).groupBy("group").agg(F.sum("total").alias("s"), F.count("*").alias("n"))
        n_pairs = F.expr("n * (n - 1) div 2")
        return sums.filter("n > 1").select("group", (F.col("s") / 2 / n_pairs).alias("mean_jsd"), n_pairs.alias("n_pairs"))
    ga = members.select(F.col("member").alias("a"), "group")
    gb = members.select(F.col("member").alias("b"), "group")
    return matrix.join(ga, "a").join(gb, ["b", "group"]).groupBy("group").agg(
        F.avg("jsd").alias("mean_jsd"), F.count("*").alias("n_pairs")
    )


def to_reference(profiles: DataFrame, reference: str, key: str = "rater") -> DataFrame:
    """Divergence of each profile from one reference profile."""
    ref = profiles.filter(F.col(key) == reference).select(F.col("profile"))
    others = profiles.filter(F.col(key) != reference)
    return others.withColumn("_ref", ref.scalar()).select(key, jsd("profile", "_ref").alias("jsd"))


def significance(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Bonferroni threshold over all tests and the class of each."""
    n = tests.agg(F.count("*")).scalar()
    out = tests.withColumn("bonferroni", F.lit(alpha) / n)
    cls = F.when(F.col(p) < F.col("bonferroni"), "corrected").when(F.col(p) < alpha, "nominal").otherwise("none")
    return out.withColumn("significance", cls)


def temperature_sweep(agents: DataFrame, temperatures: list[float], group: str | None = None) -> DataFrame:
    """Mean, spread and standard error of the divergence between true and recovered profiles per temperature.

    ``agents`` has arrays ``weights`` (true shares) and ``beta`` (recovered); population spread.
    """
    for t in temperatures:
        check_temperature(t)
    rows = agents.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    scored = rows.withColumn("jsd", jsd(F.col("weights"), softmax("beta", F.col("temperature"))))
    keys = ([group] if group else []) + ["temperature"]
    out = scored.groupBy(*keys).agg(
        F.avg("jsd").alias("mean_jsd"), F.stddev_pop("jsd").alias("std_jsd"), F.count("*").alias("n")
    )
    return out.withColumn("se_jsd", F.col("std_jsd") / F.sqrt("n"))


def best_temperature(sweep: DataFrame, group: str | None = None) -> DataFrame:
    keys = [group] if group else []
    return sweep.groupBy(*keys).agg(
        F.min_by("temperature", F.struct("mean_jsd", "temperature")).alias("temperature"),
        F.min("mean_jsd").alias("mean_jsd"),
    )
