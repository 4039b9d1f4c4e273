"""Near-duplicate join of unit vectors by bands of random projections, every hit checked exactly (K7)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.operators.similarity import BLOCK_ROWS, _units
from panelstat.schema import NEAR_DUPLICATE

_HITS = "rep string, other string, similarity double, n_over bigint"
# rows of a bucket that meet the whole bucket at a time, and the rows that buckets have on average
_STEP, _BUCKET = 128, 128
# numbers that a block of vectors and its bands hold, and the rows of a block at most
_BLOCK_NUMBERS, _BLOCK_ROWS = 1 << 24, 1 << 14


def band_plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a band, number of bands) for n vectors.

    Vectors at cosine c agree in a bit with p = 1 - acos(c) / pi, so a pair at the threshold meets in one of L bands of k
    bits with 1 - (1 - p^k)^L. Bits grow with log2 n, so that buckets of unlike vectors keep about _BUCKET rows; the bands
    follow from the wanted recall and grow as n^(log p / log 0.5), n^0.33 at 0.80. Closer pairs meet more often.
    """
    p = 1 - math.acos(threshold) / math.pi
    bits = min(24, max(4, math.ceil(math.log2(max(n, 1) / _BUCKET)) if n > _BUCKET else 4))
    meet = p**bits
    return bits, 1 if meet >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def all_meet(n: int, bits: int, bands: int) -> bool:
    """Whether the bands together compare every vector with a quarter of all or more, as low thresholds make them."""
    return 4 * bands * max(1.0, n / 2**bits) >= n


def _planes(dims: int, bits: int, bands: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, bits * bands))


def _band_values(units: np.ndarray, planes: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The value of every vector in every band."""
    out = np.empty((len(units), bands), np.int32)
    step = max(1, (1 << 22) // (bits * bands))
    for k in range(0, len(units), step):
        set_bits = (units[k : k + step] @ planes > 0).reshape(-1, bands, bits)
        out[k : k + step] = (set_bits * (1 << np.arange(bits, dtype=np.int32))).sum(axis=2, dtype=np.int32)
    return out


def _signer(bits: int, bands: int, seed: int):
    """Adds the bands' values to batches of (rep, weight, embedding); unusable vectors get none."""

    def run(batches):
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(pa.chunked_array([batch.column("embedding")]))
            if planes is None:
                planes = _planes(units.shape[1], bits, bands, seed)
            offsets = np.arange(len(units) + 1, dtype=np.int32) * bands
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_band_values(units, planes, bits, bands).ravel()))
            used = np.abs(units).sum(axis=1) > 0
            out = pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("weight"), batch.column("embedding"), lists], names=["rep", "weight", "embedding", "bands"])
            yield out.filter(pa.array(used))

    return run


def _runs(*columns: np.ndarray):
    """(order, starts, ends) of the runs of equal tuples."""
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), bool)
    for c in columns:
        change[1:] |= c[order][1:] != c[order][:-1]
    starts = np.concatenate(([0], np.nonzero(change)[0])) if len(order) else np.zeros(0, int)
    return order, starts, np.append(starts[1:], len(order))


def _bucket_hits(threshold: float):
    """Per vector of the cell: its best partner and the weight of all partners whose first common band is this one."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("rep").to_pylist(), dtype=object)
        units, weight = _units(table.column("embedding")), table.column("weight").to_numpy()
        sign = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        band, value, lo, hi, block = (table.column(c).to_numpy() for c in ("band", "value", "lo", "hi", "block"))
        out: list[list] = [[], [], [], []]
        order, starts, ends = _runs(band, value, lo, hi)
        for s, e in zip(starts, ends):
            at = order[s:e]
            at = at[np.argsort(ids[at])]  # equal similarities are taken in id order
            cross = lo[at[0]] != hi[at[0]]
            for k in range(0, len(at), _STEP):
                mine = at[k : k + _STEP]
                sims = units[mine] @ units[at].T
                sims[np.arange(len(mine)), k + np.arange(len(mine))] = -np.inf
                if cross:  # the pairs inside a block have a cell of their own
                    sims[block[mine][:, None] == block[at][None, :]] = -np.inf
                row, col = np.nonzero(sims >= threshold)
                same = sign[mine[row]] == sign[at[col]]
                first = same.argmax(axis=1) == band[at[0]]
                row, col = row[first], col[first]
                if not len(row):
                    continue
                near = np.round(sims[row, col], 12)
                by = np.lexsort((col, -near, row))
                head = np.append(True, row[by][1:] != row[by][:-1])
                mass = np.bincount(row, weights=weight[at[col]], minlength=len(mine))
                found = row[by][head]
                out[0].extend(ids[mine[found]])
                out[1].extend(ids[at[col[by][head]]])
                out[2].extend(sims[found, col[by][head]])
                out[3].extend(mass[found].astype(np.int64))
        types = [pa.string(), pa.string(), pa.float64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["rep", "other", "similarity", "n_over"])

    return run


def _usable(batches):
    """Batches of (rep, weight, embedding) without zero and non-finite vectors."""
    for batch in batches:
        if batch.num_rows:
            yield batch.filter(pa.array(np.abs(_units(pa.chunked_array([batch.column("embedding")]))).sum(axis=1) > 0))


def _block_hits(threshold: float, bits: int, bands: int, seed: int):
    """Per vector of a pair of blocks: its best partner in the other block and the weight of all, of those it shares a band with."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("rep").to_pylist(), dtype=object)
        order = np.argsort(ids)  # equal similarities are taken in id order
        ids, units = ids[order], _units(table.column("embedding"))[order]
        weight, block = table.column("weight").to_numpy()[order], table.column("block").to_numpy()[order]
        sign = _band_values(units, _planes(units.shape[1], bits, bands, seed), bits, bands)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        out: list[list] = [[], [], [], []]
        for a, b in {(lo, hi), (hi, lo)}:
            left, at = np.flatnonzero(block == a), np.flatnonzero(block == b)
            corpus = units[at]
            for k in range(0, len(left), _STEP):
                mine = left[k : k + _STEP]
                sims = units[mine] @ corpus.T
                if a == b:
                    sims[np.arange(len(mine)), k + np.arange(len(mine))] = -np.inf
                row, col = np.nonzero(sims >= threshold)
                met = np.zeros(len(row), bool)
                step = max(1, (1 << 22) // bands)
                for j in range(0, len(row), step):
                    met[j : j + step] = (sign[mine[row[j : j + step]]] == sign[at[col[j : j + step]]]).any(axis=1)
                row, col = row[met], col[met]
                if not len(row):
                    continue
                near = np.round(sims[row, col], 12)
                by = np.lexsort((col, -near, row))
                head = np.append(True, row[by][1:] != row[by][:-1])
                mass = np.bincount(row, weights=weight[at[col]], minlength=len(mine))
                found = row[by][head]
                out[0].extend(ids[mine[found]])
                out[1].extend(ids[at[col[by][head]]])
                out[2].extend(sims[found, col[by][head]])
                out[3].extend(mass[found].astype(np.int64))
        types = [pa.string(), pa.string(), pa.float64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["rep", "other", "similarity", "n_over"])

    return run


def _by_blocks(reps: DataFrame, n: int, dims: int, threshold: float, bits: int, bands: int, seed: int) -> DataFrame:
    """Hits of all pairs that share a band, with every vector sent once to each block of others instead of once to each band."""
    rows = min(_BLOCK_ROWS, max(1024, _BLOCK_NUMBERS // (dims + bands)))
    blocks = max(-(-n // rows), min(8, -(-n // 1024)), 1)
    own = reps.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = own.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    cells = own.select("rep", "weight", "embedding", "block", "lo", "hi").repartition(min(4096, blocks * (blocks + 1) // 2), "lo", "hi")
    return cells.groupBy("lo", "hi").applyInArrow(_block_hits(threshold, bits, bands, seed), _HITS)


def near_duplicates_lsh(
    corpus: DataFrame, threshold: float = NEAR_DUPLICATE, key: str = "case_id", recall: float = 0.95, seed: int = 42,
    bits: int | None = None, bands: int | None = None, bucket_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, nearest_id, similarity, n_similar) as ``similarity.near_duplicates``, by locality-sensitive hashing (K7).

    Equal vectors become one representative with a weight, so a group of copies of any size costs one row per band. A
    representative goes once to each band; buckets of a band value meet as matrix products and every reported similarity is
    exact. A pair counts in the first band its two signatures share, so nothing is counted twice. Buckets over
    ``bucket_rows`` are split into blocks that meet two by two in cells of their own, none is cut short. What can be missing
    are pairs that meet in no band: ``recall`` is the expected share found at exactly the threshold, more above it.

    Low thresholds need so many bands that buckets spare few comparisons (``all_meet``). Unless ``bits`` or ``bands`` ask for
    buckets, blocks of vectors then meet two by two, and a pair counts if it shares a band: the same pairs, but a vector goes
    once to each of n / 16,384 blocks, without its bands, instead of to hundreds of bands.

    Null, zero and non-finite vectors are like nothing and do not appear; vectors of different lengths fail the job; rows
    that repeat an id and a vector count once, vectors under one id are not told apart; an empty corpus gives no rows; other
    columns are ignored.
    """
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must be in (0, 1] and recall in (0, 1)")
    items = corpus.filter(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), "embedding").distinct()
    reps = items.groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    n, dims = reps.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocked = bits is None and bands is None
    planned = band_plan(n, threshold, recall)
    bits = bits or planned[0]
    if bands is None:
        p = (1 - math.acos(threshold) / math.pi) ** bits
        bands = planned[1] if bits == planned[0] else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p))) if p < 1 else 1
    element = reps.schema["embedding"].dataType.simpleString()
    if blocked and all_meet(n, bits, bands):
        usable = reps.select("rep", "weight", "embedding").mapInArrow(_usable, f"rep string, weight bigint, embedding {element}")
        return _report(items, usable, _by_blocks(usable, n, dims, threshold, bits, bands, seed))
    signed = reps.select("rep", "weight", "embedding").mapInArrow(
        _signer(bits, bands, seed), f"rep string, weight bigint, embedding {element}, bands array<int>")

    keys = signed.select(F.posexplode("bands").alias("band", "value"))
    hot = keys.groupBy("band", "value").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows)
    hot = hot.select("band", "value", F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks"))
    rows = signed.select("rep", "weight", "embedding", "bands", F.posexplode("bands").alias("band", "value"))
    rows = rows.join(hot, ["band", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    slots = max(1, -(-n * bands // (4 * bucket_rows)))
    bucket = F.xxhash64("band", "value")
    slot = F.when(F.col("blocks") > 1, F.xxhash64(bucket, "lo", "hi")).otherwise(F.pmod(bucket, F.lit(slots)))
    cells = rows.select("rep", "weight", "embedding", "bands", "band", "value", "block", "lo", "hi", slot.alias("slot"))
    hits = cells.groupBy("slot").applyInArrow(_bucket_hits(threshold), _HITS)
    return _report(items, signed, hits)


def _report(items: DataFrame, reps: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per item of ``items`` that has a near one, from the hits of the representatives."""
    best = F.min(F.struct((-F.round("similarity", 12)).alias("far"), "other", "similarity")).alias("best")
    found = hits.groupBy("rep").agg(best, F.sum("n_over").alias("n_over"))
    # members of a group of copies have each other besides
    members = items.join(reps.select("rep", "weight", "embedding"), "embedding").select("id", "rep", "weight")
    second = members.filter((F.col("weight") > 1) & (F.col("id") != F.col("rep"))).groupBy("rep").agg(F.min("id").alias("second"))
    out = members.join(found, "rep", "left").join(second, "rep", "left")
    copy = F.when(F.col("weight") > 1, F.when(F.col("id") != F.col("rep"), F.col("rep")).otherwise(F.col("second")))
    own = F.when(copy.isNotNull(), F.struct(F.lit(-1.0).alias("far"), copy.alias("other"), F.lit(1.0).alias("similarity")))
    nearest = F.least("best", own)
    total = F.coalesce("n_over", F.lit(0)) + F.col("weight") - 1
    return out.withColumn("near", nearest).filter("near is not null").select(
        "id", F.col("near.other").alias("nearest_id"), F.col("near.similarity").alias("similarity"), total.alias("n_similar"))
