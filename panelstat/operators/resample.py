"""Bootstrap and permutation inference from counter-based draws.

A draw is a function of (seed, draw number, slot) alone: results do not depend on partitioning and
the same expression can be evaluated by another engine. Taking the 32-bit number modulo n favours
low positions by less than n / 2**32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstat.functions import digests, irls
from panelstat.functions.scalar import hash_u32
from panelstat.operators import profiles
from panelstat.plans import counts
from panelstat.plans.gram import shuffle_partitions
from panelstat.plans.positions import dense_position
from panelstat.plans.reuse import materialise
from panelstat.schema import ATTRIBUTES

# Two null statistics closer than this count as equal; sums differ in the last bits by order.
TIE = 1e-12


def _check(n_samples: int) -> None:
    if n_samples <= 0:
        raise ValueError("n_samples must be positive")


# chunks of draws, and positions of a block, that meet when the draws of a position are gathered
DRAW_CHUNKS, DRAW_BLOCK = 128, 1024
# numbers a task holds while it draws or unpacks draws
HELD = 8_000_000


def _slots(n: int, n_samples: int, chunk: int, seed):
    """Arrow function: per chunk of draws and block of positions, how often each draw has each position, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_blocks = -(-n // DRAW_BLOCK)
        for batch in batches:
            for lo in batch.column(0).to_pylist() if n else ():
                draws = range(lo * chunk, min((lo + 1) * chunk, n_samples))
                step = max(1, HELD // n)
                times = np.zeros((n_blocks * DRAW_BLOCK, len(draws)), np.uint8)
                for first in range(0, len(draws), step):
                    some = draws[first : first + step]
                    for i, drawn in enumerate(digests.numbered([f"{seed}|{b}|".encode() for b in some], n)):
                        own = np.bincount(drawn % np.uint32(n))
                        if own.max() > np.iinfo(times.dtype).max:
                            times = times.astype(np.int64)
                        times[: len(own), first + i] = own
                for k in range(0, n_blocks, 64):
                    some = times[k * DRAW_BLOCK : (k + 64) * DRAW_BLOCK].reshape(-1, DRAW_BLOCK * len(draws))
                    cols = [pa.array(np.arange(k, k + len(some)), pa.int32()), pa.array([lo] * len(some), pa.int32()), pa.array(counts.pack(some), pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["block", "chunk", "times"])

    return run


def _gather(key: str, n_samples: int, chunk: int):
    """Cogrouped Arrow function: the items of a block that any draw has, with how often each draw has them, packed."""

    def run(names: pa.Table, parts: pa.Table) -> pa.Table:
        held: list[tuple[int, np.ndarray]] = []
        for lo, packed in zip(parts["chunk"].to_pylist(), parts["times"], strict=True):
            size = min((lo + 1) * chunk, n_samples) - lo * chunk
            held.append((lo * chunk, counts.unpack(pa.array([packed.as_py()], pa.binary()), DRAW_BLOCK * size).reshape(DRAW_BLOCK, size)))
        times = np.zeros((DRAW_BLOCK, n_samples), np.result_type(np.uint8, *[t.dtype for _, t in held]))
        for lo, t in held:
            times[:, lo : lo + t.shape[1]] = t
        at = names["pos"].to_numpy() % DRAW_BLOCK
        used = np.flatnonzero(times.any(axis=1)[at])
        packed = [x for lo in range(0, len(used), 64) for x in counts.pack(times[at[used[lo : lo + 64]]])]
        return pa.table({key: names[key].take(pa.array(used)), "draws": pa.array(packed, pa.binary())})

    return run


def _with_draws(positions: DataFrame, n_samples: int, seed, key: str) -> DataFrame:
    """(key, draws): how often each draw has the item (see ``plans.counts``), of items that any has; every position serves as one slot of every draw.

    A draw needs only the number of positions. Tasks make a chunk of draws each and hand on counts, one text of bytes a block of
    positions, so neither slots nor draws of a position are rows, and a draw of an item takes some 2.3 bits.
    """
    _check(n_samples)
    n = positions.agg(F.max("n")).first()[0] or 0
    chunk = -(-n_samples // DRAW_CHUNKS)
    n_chunks = -(-n_samples // chunk)
    n_tasks = shuffle_partitions(positions)
    chunks = positions.sparkSession.range(0, n_chunks, 1, min(n_chunks, 4 * n_tasks)).withColumn("id", F.col("id").cast("int"))
    parts = chunks.mapInArrow(_slots(n, n_samples, chunk, seed), "block int, chunk int, times binary").repartition(n_tasks, "block")
    names = positions.select(key, F.col("pos").cast("bigint").alias("pos"), F.expr(f"int(pos div {DRAW_BLOCK})").alias("block")).repartition(n_tasks, "block")
    out = f"`{key}` {positions.schema[key].dataType.simpleString()}, draws binary"
    return names.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(_gather(key, n_samples, chunk), out)


def _times(n_samples: int):
    """Arrow function: a row for each draw that an item is in, with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 65536 // n_samples)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                times = counts.unpack(piece.column(1), n_samples)
                row, b = np.nonzero(times)
                cols = [pa.array(b.astype(np.int32)), piece.column(0).take(pa.array(row)), pa.array(times[row, b].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["b", batch.schema.names[0], "weight"])

    return run


def bootstrap_draws(positions: DataFrame, n_samples: int, seed: int, key: str = "case_id") -> DataFrame:
    """(b, key, weight): how often each item was drawn, n draws with replacement per sample."""
    drawn = _with_draws(positions, n_samples, seed, key)
    return drawn.mapInArrow(_times(n_samples), f"b int, `{key}` {drawn.schema[key].dataType.simpleString()}, weight bigint")


# numbers a task holds at a time while it sums values over draws; items of a block of values
SUM_LIMIT, BLOCK = 10_000_000, 512


def add_products(sums: np.ndarray, local: np.ndarray, code: np.ndarray, case: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
    """Add x and 1 of the entries (item ``local[code]``, case), weighted by the draws ``w`` (cases, draws), to ``sums`` (2, items, draws).

    A block of items by cases, mostly filled where raters answer most cases, is two matrix products. Entries of thinly
    filled blocks are added one by one.
    """
    if not len(case):
        return
    low = case.min()
    w = w[low : case.max() + 1]
    order = np.argsort(code, kind="stable")
    code, case, x = code[order], case[order] - low, x[order]
    for first in range(0, len(local), BLOCK):
        lo, hi = np.searchsorted(code, [first, first + BLOCK])
        item, at, own = code[lo:hi] - first, case[lo:hi], x[lo:hi]
        names = local[first : first + BLOCK]
        if (hi - lo) * 64 >= len(names) * len(w):
            block = np.zeros((2, len(names), len(w)))
            np.add.at(block[0], (item, at), own)
            np.add.at(block[1], (item, at), 1.0)
            for m in range(2):
                sums[m][names] += block[m] @ w
        else:
            for part in range(0, hi - lo, BLOCK):
                i, a, v = item[part : part + BLOCK], at[part : part + BLOCK], own[part : part + BLOCK]
                heads = np.flatnonzero(np.diff(i, prepend=-1))
                sums[0][names[i[heads]]] += np.add.reduceat(v[:, None] * w[a], heads, axis=0)
                sums[1][names[i[heads]]] += np.add.reduceat(w[a], heads, axis=0)


# an item with fewer values among a piece of cases hands on its values with the counts of their draws, else its sums
FEW = 12


def _weighted_sums(n_samples: int):
    """Arrow function: per item, sums of weight * value and of weight over its rows for every draw, or single values with their weights.

    Items with few values here hand on each value with how often its case was drawn, packed; of others the sums are
    held, handed on and started anew when they grow past the limit. All are added up afterwards, so memory does not depend on
    how many items there are.
    """

    def lines(names, values, weights, totals):
        cols = [pa.array(names, pa.string()), pa.array(values, pa.float64()), pa.array(weights, pa.binary()), pa.array(totals, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["item", "value", "weights", "totals"])

    def emit(index, sums):
        names = list(index)
        for lo in range(0, len(names), 256):
            some = range(lo, min(lo + 256, len(names)))
            yield lines([names[i] for i in some], [None] * len(some), [sums[1][i].tobytes() for i in some], [sums[0][i].tobytes() for i in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        sums = np.zeros((2, 0, n_samples))
        step = max(1 << 16, SUM_LIMIT // n_samples)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                piece = batch.slice(start, 2048)
                values, packed = pa.concat_arrays([piece.column("v")]), piece.column("draws").to_pylist()
                w = counts.unpack(piece.column("draws"), n_samples).astype(np.float64)
                flat = values.flatten()
                rows = np.repeat(np.arange(piece.num_rows), np.diff(values.offsets.to_numpy()))
                for lo in range(0, len(rows), step):
                    part = pa.concat_arrays([flat.slice(lo, step).field(0)]).dictionary_encode()
                    names, code = part.dictionary.to_pylist(), part.indices.to_numpy()
                    x, case = flat.slice(lo, step).field(1).to_numpy(zero_copy_only=False), rows[lo : lo + step]
                    few = np.bincount(code, minlength=len(names))[code] < FEW
                    alone = np.flatnonzero(few)
                    for at in range(0, len(alone), 4096):
                        some = alone[at : at + 4096]
                        yield lines([names[i] for i in code[some]], x[some], [packed[c] for c in case[some]], [None] * len(some))
                    own = np.flatnonzero(~few)
                    used, code = np.unique(code[own], return_inverse=True)
                    local = np.array([index.setdefault(names[i], len(index)) for i in used], dtype=np.int64)
                    if len(index) > sums.shape[1]:
                        grown = np.zeros((2, 2 * len(index), n_samples))
                        grown[:, : sums.shape[1]] = sums
                        sums = grown
                    add_products(sums, local, code, case[own], x[own], w)
                if len(index) * n_samples > SUM_LIMIT:
                    yield from emit(index, sums)
                    index, sums = {}, np.zeros((2, 0, n_samples))
        yield from emit(index, sums)

    return run


def _lines(table: pa.Table, n_samples: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, counts of their draws) of lines with packed counts, some at a time."""
    alone = np.flatnonzero(table["totals"].is_null().to_numpy())
    step = max(1, HELD // 8 // n_samples)
    for lo in range(0, len(alone), step):
        some = alone[lo : lo + step]
        yield some, counts.unpack(table["weights"].take(pa.array(some)), n_samples)


def _means(n_samples: int):
    """Grouped Arrow function: an item's mean in every draw that has any of its values."""

    def run(table: pa.Table) -> pa.Table:
        sums = np.zeros((2, n_samples))
        values = table["value"].to_numpy()
        for some, w in _lines(table, n_samples):
            w = w.astype(np.float64)
            sums[0] += values[some] @ w
            sums[1] += w.sum(axis=0)
        for w, t in zip(table["weights"], table["totals"], strict=True):
            if t.is_valid:
                sums += np.stack([np.frombuffer(t.as_buffer()), np.frombuffer(w.as_buffer())])
        b = np.flatnonzero(sums[1])
        return pa.table({
            "item": table["item"].slice(0, 1), "b": pa.array([b.astype(np.int32)], pa.list_(pa.int32())),
            "mean": pa.array([sums[0, b] / sums[1, b]], pa.list_(pa.float64())),
        })

    return run


def bootstrap_means(
    values: DataFrame, positions: DataFrame, keys: list[str], n_samples: int, seed: int, key: str = "case_id", value: str = "value", n_blocks: int = 1
) -> DataFrame:
    """(keys..., b, mean): mean of a per-case metric over the drawn cases that have a value (R2).

    Values and draws meet once per case. Tasks sum the values of items with many, and hand on those of items with
    few, with the packed counts of their draws; an item's lines meet in one group. ``n_blocks`` splits the values of one
    case by key, for cases with very many raters.
    """
    by_case = _with_draws(positions, n_samples, seed, key)
    label = F.to_json(F.struct(*keys))
    items = (
        values.filter(F.col(value).isNotNull())
        .select(key, F.struct(label.alias("item"), F.col(value).cast("double").alias("value")).alias("c"))
        .groupBy(key, F.pmod(F.xxhash64("c.item"), F.lit(n_blocks)))
        .agg(F.collect_list("c").alias("v"))
    )
    parts = items.join(by_case, key).select("v", "draws").mapInArrow(_weighted_sums(n_samples), "item string, value double, weights binary, totals binary")
    summed = parts.groupBy("item").applyInArrow(_means(n_samples), "item string, b array<int>, mean array<double>")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*keys).schema.fields)
    rows = summed.select(F.from_json("item", schema).alias("k"), F.explode(F.arrays_zip("b", "mean")).alias("z"))
    return rows.select("k.*", "z.b", "z.mean")


def summarise(samples: DataFrame, keys: list[str], value: str, level: float = 95.0) -> DataFrame:
    """Mean, sample spread, median and percentile interval of bootstrap samples."""
    lo, hi = (1 - level / 100) / 2, 1 - (1 - level / 100) / 2
    q = F.percentile(value, F.array(F.lit(lo), F.lit(0.5), F.lit(hi)))
    out = samples.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), q.alias("q"), F.count(value).alias("n_samples")
    )
    return out.select(
        *keys, "mean", "std", F.col("q")[1].alias("median"), F.col("q")[0].alias("ci_low"), F.col("q")[2].alias("ci_high"), "n_samples"
    )


def paired_difference(samples: DataFrame, key: str, a: str, b: str, value: str, rest: list[str]) -> DataFrame:
    """Difference of two raters' samples over shared draws."""
    one = lambda r, n: samples.filter(F.col(key) == r).select("b", *rest, F.col(value).alias(n))
    return one(a, "va").join(one(b, "vb"), ["b", *rest]).select("b", *rest, (F.col("va") - F.col("vb")).alias("difference"))


def _short(sums: np.ndarray) -> bytes:
    """Sums in two bytes each if that is all there is to them."""
    short = sums.astype(np.uint16) if np.isfinite(sums).all() and sums.min(initial=0.0) >= 0 and sums.max(initial=0.0) < 1 << 16 else sums
    return short.tobytes() if (short == sums).all() else sums.tobytes()


def _long(data: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if data.size == 8 * n else np.uint16).astype(np.float64)


def _cell_draws(n_samples: int, n_attributes: int):
    """Arrow function: per (rater, cell), trials and successes summed over its cases for every draw, or of single cases with their draws.

    Raters with few cases among a piece of cases hand on each with how often it was drawn, packed; of others the sums are held, handed
    on and started anew when they grow past the limit.
    """
    step = max(1, SUM_LIMIT // n_samples)
    names = ["rater", "cell", "trials", "successes", "weights", "totals"]

    def lines(raters, cells, n, s, weights, totals):
        ends = pa.array(np.arange(len(raters) + 1, dtype=np.int32) * n_attributes)
        cells = pa.ListArray.from_arrays(ends, pa.array(np.asarray(cells, np.float64).ravel()))
        cols = [pa.array(raters, pa.string()), cells, pa.array(n, pa.float64()), pa.array(s, pa.float64()), pa.array(weights, pa.binary()), pa.array(totals, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def emit(index, sums):
        for lo in range(0, len(index), 256):
            keys = list(index)[lo : lo + 256]
            part, none = sums[:, lo : lo + len(keys)], [None] * len(keys)
            yield lines([r for r, _ in keys], [c for _, c in keys], none, none, [_short(x) for x in part[0]], [_short(x) for x in part[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict = {}
        sums = np.zeros((2, 0, n_samples))
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                piece = batch.slice(start, 2048)
                values, packed = pa.concat_arrays([piece.column("v")]), piece.column("draws").to_pylist()
                flat, case = values.flatten(), np.repeat(np.arange(piece.num_rows), np.diff(values.offsets.to_numpy()))
                cells = flat.field(1).flatten().to_numpy().reshape(len(flat), n_attributes)
                n, s = (flat.field(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                part = flat.field(0).dictionary_encode("encode")
                raters, code = part.dictionary.to_pylist(), part.indices.to_numpy()
                few = np.bincount(code, minlength=len(raters))[code] < FEW
                alone = np.flatnonzero(few)
                for at in range(0, len(alone), 4096):
                    some = alone[at : at + 4096]
                    yield lines([raters[i] for i in code[some]], cells[some], n[some], s[some], [packed[c] for c in case[some]], [None] * len(some))
                own = np.flatnonzero(~few)
                # a piece of entries at a time, sorted by sum
                for at in range(0, len(own), max(1, HELD // n_samples)):
                    some = own[at : at + max(1, HELD // n_samples)]
                    keys = [(raters[c], tuple(x)) for c, x in zip(code[some], cells[some].tolist(), strict=True)]
                    k = np.array([index.setdefault(x, len(index)) for x in keys])
                    if len(index) > sums.shape[1]:
                        sums = np.concatenate([sums, np.zeros((2, max(64, len(index)), n_samples))], axis=1)
                    order = np.argsort(k, kind="stable")
                    k, some = k[order], some[order]
                    used, of = np.unique(case[some], return_inverse=True)
                    w = counts.unpack(pa.array([packed[c] for c in used], pa.binary()), n_samples).astype(np.float64)
                    heads = np.flatnonzero(np.diff(k, prepend=-1))
                    for m, x in enumerate((n, s)):
                        for lo in range(0, len(heads), 256):
                            first, last = heads[lo], heads[lo + 256] if lo + 256 < len(heads) else len(k)
                            sums[m, k[heads[lo : lo + 256]]] += np.add.reduceat(x[some[first:last], None] * w[of[first:last]], heads[lo : lo + 256] - first, axis=0)
                    if len(index) >= step:
                        yield from emit(index, sums)
                        index, sums = {}, np.zeros((2, 0, n_samples))
        yield from emit(index, sums)

    return run


def _fit_draws(n_samples: int, step: int = 128):
    """Grouped Arrow function: one rater's fits for all draws that have data."""

    def run(table: pa.Table) -> pa.Table:
        cells, which = np.unique(np.array(table["cell"].to_pylist()), axis=0, return_inverse=True)
        sums, which = np.zeros((2, len(cells), n_samples)), which.ravel()
        votes = [table[name].to_numpy() for name in ("trials", "successes")]
        for some, w in _lines(table, n_samples):
            for i, own in zip(some, w, strict=True):
                for m in range(2):
                    sums[m, which[i]] += votes[m][i] * own
        for i in np.flatnonzero(table["totals"].is_valid().to_numpy()):
            for m, name in enumerate(("weights", "totals")):
                sums[m, which[i]] += _long(table[name][int(i)].as_buffer(), n_samples)
        draws = np.nonzero(sums[0].sum(axis=0))[0]
        beta, apart, done = np.zeros((len(draws), cells.shape[1])), np.zeros(len(draws), bool), np.zeros(len(draws), bool)
        share = sums[1].sum(axis=0) / np.maximum(sums[0].sum(axis=0), 1)
        for lo in range(0, len(draws), step):
            own = draws[lo : lo + step]
            x, n = np.broadcast_to(cells, (len(own), *cells.shape)), sums[0][:, own].T
            beta[lo : lo + step], info, _, done[lo : lo + step] = irls.fit(x, n, sums[1][:, own].T)
            apart[lo : lo + step] = irls.separated(x, n, info)
        constant = (share[draws] <= 0) | (share[draws] >= 1)
        varies = ((sums[0][:, draws] > 0) & (cells != 0).any(axis=1)[:, None]).any(axis=0)
        status = np.select([constant, ~varies, apart, done], ["constant_outcome", "constant_design", "separated", "converged"], "not_converged")
        beta[constant | ~varies | apart] = 0.0
        rater = table["rater"][0].as_py()
        return pa.table({"rater": pa.array([rater] * len(draws), pa.string()), "b": pa.array(draws, pa.int32()), "beta": pa.array(list(beta), pa.list_(pa.float64())), "status": pa.array(status.tolist(), pa.string())})

    return run


def bootstrap_weights(
    design: DataFrame, positions: DataFrame, n_samples: int, seed: int, attributes: list[str] = ATTRIBUTES
) -> DataFrame:
    """(rater, b, beta, status): value weights refitted on every draw; draws without data drop out.

    A case meets its draws once. Tasks sum trials and successes per rater, cell and draw for raters with many cases, and hand on
    the cases of others with their packed draws; one rater's cells meet in one fit: draws never become rows before they
    are results. Constant answers give zeros.
    """
    by_case = _with_draws(positions, n_samples, seed, "case_id")
    cell = F.array(*[F.col(f"d_{a}").cast("double") for a in attributes])
    entry = F.struct(F.col("rater"), cell.alias("cell"), F.col("n").cast("double").alias("n"), F.col("c1").cast("double").alias("c1"))
    rows = design.groupBy("case_id").agg(F.collect_list(entry).alias("v")).join(by_case, "case_id").select("v", "draws")
    parts = rows.mapInArrow(_cell_draws(n_samples, len(attributes)), "rater string, cell array<double>, trials double, successes double, weights binary, totals binary")
    return parts.groupBy("rater").applyInArrow(_fit_draws(n_samples), "rater string, b int, beta array<double>, status string")


def _member_positions(members: DataFrame, group: str) -> DataFrame:
    """Positions of the members of one group; groups of fewer than two fail the job."""
    p = dense_position(members.filter(F.col("group") == group), "member")
    n = F.when(F.col("n") >= 2, F.col("n")).otherwise(
        F.raise_error(F.lit("a group needs at least two members")).cast("bigint")
    )
    return p.withColumn("n", n)


# items of a block of pairs, draws whose weights a task holds at a time, and items whose divergences from all others it holds
PAIR_BLOCK, PAIR_DRAWS, PAIR_ROWS = 2048, 512, 128


def _cell_sums(n_draws: int, n_keys: int):
    def dense(side, lo, hi, n):
        row, d, w = side
        x, y = np.searchsorted(d, [lo, hi])
        out = np.zeros((n, hi - lo))
        out[row[x:y], d[x:y] - lo] = w[x:y]
        return out

    def listed(p, left, q, right, same):
        """Items' draws as lists of (draw, weight)."""
        total = np.zeros(n_draws)
        per = [np.bincount(s[1], minlength=n_draws) for s in (left, right)]
        n_met = per[0] * per[1]
        at = [np.append(0, np.cumsum(c)) for c in per]
        if n_met.sum() * 4 < len(p) * len(q):
            # only the pairs that meet in some draw
            ends = np.append(0, np.cumsum(n_met))
            first = 0
            while first < n_draws:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + HELD // 16, "right")) - 1)
                d = np.repeat(np.arange(first, last), n_met[first:last])
                k = np.arange(ends[first], ends[last]) - ends[d]
                i, j = at[0][d] + k // np.maximum(per[1][d], 1), at[1][d] + k % np.maximum(per[1][d], 1)
                gaps = profiles.row_divergences(p[left[0][i]], q[right[0][j]])
                total[first:last] = np.bincount(d - first, left[2][i] * gaps * right[2][j], last - first)
                first = last
            return total
        gaps = profiles.divergences(p, q)
        sparse = n_met.sum() * 256 < gaps.size * n_draws
        for b in np.flatnonzero(n_met) if sparse else ():
            x, y = (slice(a[b], a[b + 1]) for a in at)
            total[b] = left[2][x] @ gaps[np.ix_(left[0][x], right[0][y])] @ right[2][y]
        for b in () if sparse else range(0, n_draws, PAIR_DRAWS):
            end = min(b + PAIR_DRAWS, n_draws)
            wq = dense(right, b, end, len(q))
            total[b:end] = ((gaps @ wq) * (wq if same else dense(left, b, end, len(p)))).sum(axis=0)
        return total

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        lo, hi = key[-2].as_py(), key[-1].as_py()
        block = cell.column("block").to_numpy()

        def side(which):
            t = cell.filter(pa.array(block == which)).combine_chunks()
            if t.num_rows == 0:
                return np.zeros((0, 1)), None
            prof, draws = (t.column(c).combine_chunks() for c in ("profile", "draws"))
            p = prof.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            flat = draws.flatten()
            rows = np.repeat(np.arange(t.num_rows), np.diff(draws.offsets.to_numpy()))
            d, w = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            order = np.argsort(d, kind="stable")
            return p, (rows[order], d[order], w[order])

        p, left = side(lo)
        q, right = (p, left) if lo == hi else side(hi)
        total = np.zeros(n_draws)
        if len(p) and len(q):
            total = listed(p, left, q, right, lo == hi)
            total *= 0.5 if lo == hi else 1.0
        d = np.nonzero(total)[0]
        ons = [pa.array([k.as_py()] * len(d), k.type) for k in key[:n_keys]]
        names = [f"k{i}" for i in range(n_keys)] + ["d", "s"]
        return pa.table(ons + [pa.array(d.astype(np.int32)), pa.array(total[d])], names=names)

    return run


def paired_sums(items: DataFrame, key: str, n_draws: int, on: list[str] = (), n_blocks: int | None = None) -> DataFrame:
    """(on..., d, s): per draw d, the sum over pairs of items of both weights times their divergence.

    Items carry ``profile`` and ``draws``, a list of (draw, weight). They meet block against block;
    a cell multiplies its divergence matrix with the weights of all draws at once, so neither the
    pairs nor pairs times draws are ever rows, and no cell holds more than two blocks.
    """
    if n_blocks is None:
        n_blocks = max(8, -(-items.count() // PAIR_BLOCK))
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    spread = items.select(
        *on, block.alias("block"), "profile", "draws", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_o")
    )
    cells = spread.select(
        *on, F.least("block", "_o").alias("_lo"), F.greatest("block", "_o").alias("_hi"), "block", "profile", "draws"
    )
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = "".join(f"k{i} {types[c]}, " for i, c in enumerate(on)) + "d int, s double"
    parts = cells.groupBy(*on, "_lo", "_hi").applyInArrow(_cell_sums(n_draws, len(on)), schema)
    for i, c in enumerate(on):
        parts = parts.withColumnRenamed(f"k{i}", c)
    return parts.groupBy(*on, "d").agg(F.sum("s").alias("s"))


def _with_profiles(items: DataFrame, profs: DataFrame) -> DataFrame:
    return items.join(profs.select(F.col("rater").alias("member"), "profile"), "member")


# draws of a group that one task makes; members whose factors, and draws whose counts, it holds at a time
MEAN_CHUNK, MEAN_ROWS, MEAN_DRAWS = 256, 8192, 128


def _draw_sums(n_samples: int, seed, chunk: int):
    """Grouped Arrow function: for a chunk of draws, the sum over pairs of positions of their divergence; the task holds all profiles.

    With the factors of ``profiles.factors`` the sum over all pairs (i, j) of w_i w_j D_ij is 2 n sum(w a) - |F' w|^2, in steps that
    grow with members times draws. Profiles without such factors are summed pair by pair.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.num_rows
        p = table["profile"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        at, size = table["pos"].to_numpy(), table["n"][0].as_py()
        lo = key[0].as_py() * chunk
        draws = range(lo, min(lo + chunk, n_samples))
        total = np.zeros(len(draws))
        found = profiles.factors(p)
        step = max(1, min(MEAN_DRAWS, 2 * HELD // n))
        for first in range(0, len(draws), step):
            some = draws[first : first + step]
            times = np.zeros((len(some), n), np.float32)
            for i, b in enumerate(some):
                times[i] = np.bincount(digests.numbered([f"{seed}|{b}|".encode()], size)[0] % np.uint32(size), minlength=size)[at]
            own = slice(first, first + len(some))
            if found is None:
                for start in range(0, n, PAIR_ROWS):
                    gaps = profiles.divergences(p[start : start + PAIR_ROWS], p[start:])
                    gaps[:, : len(gaps)] *= 0.5
                    total[own] += (times[:, start : start + PAIR_ROWS].astype(np.float64) * (times[:, start:].astype(np.float64) @ gaps.T)).sum(axis=1)
                continue
            weight, reach, sides = np.zeros(len(some)), np.zeros(len(some)), 0.0
            for start in range(0, n, MEAN_ROWS):
                w = times[:, start : start + MEAN_ROWS].astype(np.float64)
                a, f = found(start, start + MEAN_ROWS)
                weight += w.sum(axis=1)
                reach += w @ a
                sides = sides + w @ f
            total[own] = np.maximum(weight * reach - 0.5 * (sides**2).sum(axis=1), 0.0)
        return pa.table({"b": pa.array(draws, pa.int32()), "s": total})

    return run


def bootstrap_mean_jsd(profs: DataFrame, members: DataFrame, groups: tuple[str, str], n_samples: int, seed: int) -> DataFrame:
    """(b, mean_a, mean_b, difference): mean within-group divergence of resampled groups.

    Copies of one member are at distance zero, so a draw's mean over position pairs equals the sum
    over member pairs weighted with both counts. A task makes a chunk of draws itself and holds the group's profiles.
    """
    _check(n_samples)
    out = profs.sparkSession.range(n_samples).select(F.col("id").cast("int").alias("b"))
    n_chunks = -(-n_samples // MEAN_CHUNK)
    for g, name in zip(groups, ("mean_a", "mean_b")):
        pos = _member_positions(members, g)
        n = pos.agg(F.max("n")).scalar()
        rows = _with_profiles(pos, profs).select("pos", "n", "profile").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
        # profiles are few bytes and their sums much work: without a number of partitions one task would make them all
        rows = rows.repartition(2 * n_chunks, "_chunk")
        sums = rows.groupBy("_chunk").applyInArrow(_draw_sums(n_samples, f"{seed}|{g}", MEAN_CHUNK), "b int, s double")
        joined = out.join(sums, "b", "left").withColumn("_n", n)
        out = joined.withColumn(name, F.coalesce("s", F.lit(0.0)) / (F.col("_n") * (F.col("_n") - 1) / 2)).drop("s", "_n")
    return out.withColumn("difference", F.col("mean_a") - F.col("mean_b"))


# leading values of a hash that a permutation's histogram tells apart; permutations whose histograms are added up together
BINS, PERM_CHUNK = 64, 500


def _position_hashes(members: pa.RecordBatch, n_permutations: int, seed) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece (permutations, rows, high, low): the digests (permutations, rows) as two 64-bit numbers; nulls are left out of the hashed text."""
    heads = [f"{seed}|{p}|".encode() for p in range(n_permutations)]
    pairs = zip(members.column(0).to_pylist(), members.column(1).to_pylist(), strict=True)
    return digests.digests(heads, [(group if member is None else f"{group}|{member}").encode() for group, member in pairs])


def _bin_of(high: np.ndarray) -> np.ndarray:
    return (high >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def _histograms(n_permutations: int, seed):
    """Arrow function: per chunk of permutations, how many of the task's positions are in each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_permutations, BINS), np.int64)
        for batch in batches:
            for perm, _, high, _ in _position_hashes(batch, n_permutations, seed):
                cell = _bin_of(high) + np.arange(len(perm))[:, None] * BINS
                total[perm] += np.bincount(cell.ravel(), minlength=len(perm) * BINS).reshape(-1, BINS)
        parts = [total[lo : lo + PERM_CHUNK].ravel() for lo in range(0, n_permutations, PERM_CHUNK)] if total.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["chunk", "counts"])

    return run


def _open_bins(n_first: int):
    """Grouped Arrow function: of each permutation of a chunk, the bin that holds its ``n_first``-th position and how many come before."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.asarray(c.values).reshape(-1, BINS) for c in table["counts"])
        upto = total.cumsum(axis=1)
        at = (upto >= n_first).argmax(axis=1)
        every = np.arange(len(total))
        perm = every + table["chunk"][0].as_py() * PERM_CHUNK
        return pa.table({"perm": pa.array(perm, pa.int32()), "bin": pa.array(at, pa.int32()), "before": (upto - total)[every, at]})

    return run


def _in_bins(bins: np.ndarray, seed):
    """Arrow function: (perm, at) of the positions in each permutation's open bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for perm, rows, high, low in _position_hashes(batch, len(bins), seed):
                p, r = np.nonzero(_bin_of(high) == bins[perm][:, None])
                order = np.stack([high[p, r], low[p, r]], axis=1).astype(">u8").tobytes().hex()
                own = pa.array(rows[r])
                cols = [pa.array(perm[p], pa.int32()), pa.array([order[i : i + 32] for i in range(0, len(order), 32)], pa.string()), batch.column(0).take(own), batch.column(1).take(own)]
                yield pa.RecordBatch.from_arrays(cols, names=["perm", "order", "group", "member"])

    return run


def _up_to(last: list[tuple], seed):
    """Arrow function: (group, member, perms) with the permutations in which a position comes no later than ``last``."""
    n = len(last)
    bound = np.frombuffer(bytes.fromhex("".join(x[0] for x in last)), ">u8").reshape(-1, 2).astype(np.uint64)
    key = lambda group, member: (group, member is not None, member or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                # of each row, the permutations that have come up
                found: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
                for perm, rows, high, low in _position_hashes(batch, n, seed):
                    to, rest = bound[perm, 0][:, None], bound[perm, 1][:, None]
                    less = (high < to) | ((high == to) & (low < rest))
                    for p, r in zip(*np.nonzero((high == to) & (low == rest)), strict=True):
                        own = (batch.column(c)[int(rows[r])].as_py() for c in (0, 1))
                        less[p, r] = key(*own) <= key(*last[perm[p]][1:])
                    r, p = np.nonzero(less.T)
                    for i, part in zip(rows, np.split(perm[p], np.searchsorted(r, np.arange(1, len(rows)))), strict=True):
                        if len(part):
                            found[i].append(part)
                perms = [np.sort(np.concatenate(f)).astype(np.int32) if f else np.zeros(0, np.int32) for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(perms, pa.list_(pa.int32()))], names=["group", "member", "perms"])

    return run


def _first_group(members: DataFrame, groups: tuple[str, str], n_permutations: int, seed: int) -> tuple[DataFrame, int, int]:
    """(group, member, perms) with the permutations in which a position falls to the first group, and the sizes of both groups.

    The pooled positions are split at random into groups of the old sizes; a member that is in both groups occupies two.
    The first group gets the positions with the smallest hashes, those up to a threshold that is found by selection: a
    histogram of the leading bits tells which bin holds it, and only that bin's positions, a 64th, become rows. Positions
    times permutations are numbers in a task, never rows; thresholds, one a permutation, go to every task.
    """
    _check(n_permutations)
    pool = members.filter(F.col("group").isin(*groups)).select("group", "member")
    sizes = {r[0]: r[1] for r in pool.groupBy("group").count().collect()}
    n_first, n_second = (sizes.get(g, 0) for g in groups)
    # in this order of the keys, as Spark drops a repetition of the shuffle that made the members distinct
    pool = pool.repartition(shuffle_partitions(members), "member", "group")
    if not n_first:
        return pool.withColumn("perms", F.array().cast("array<int>")), n_first, n_second
    counts = pool.mapInArrow(_histograms(n_permutations, seed), "chunk int, counts array<bigint>")
    opened = counts.groupBy("chunk").applyInArrow(_open_bins(n_first), "perm int, bin int, before bigint").sort("perm").collect()
    inside = pool.mapInArrow(_in_bins(np.array([r.bin for r in opened]), seed), "perm int, order string, group string, member string")
    kept = inside.groupBy("perm").agg(F.array_sort(F.collect_list(F.struct("order", "group", "member"))).alias("at"))
    places = members.sparkSession.createDataFrame([(r.perm, n_first - 1 - r.before) for r in opened], "perm int, place int")
    last = kept.join(places, "perm").select("perm", F.get("at", "place").alias("last")).sort("perm").collect()
    return pool.mapInArrow(_up_to([tuple(r.last) for r in last], seed), "group string, member string, perms array<int>"), n_first, n_second


def _relabelled(members: DataFrame, groups: tuple[str, str], n_permutations: int, seed: int) -> DataFrame:
    """(perm, group, member, first): the labels of ``_first_group`` as rows."""
    lists, _, _ = _first_group(members, groups, n_permutations, seed)
    rows = lists.select(F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("perm"), "group", "member", "perms")
    return rows.select("perm", "group", "member", F.array_contains("perms", F.col("perm")).alias("first"))


def _mean_gap(sums: DataFrame, members: DataFrame, groups: tuple[str, str], by: str) -> DataFrame:
    """|mean of the first - mean of the second| from pair sums flagged ``first``, per ``by``."""
    size = lambda g: members.filter(F.col("group") == g).agg(F.count("*")).scalar()
    s = sums.withColumn("_a", size(groups[0])).withColumn("_b", size(groups[1]))
    k = F.when(F.col("first"), F.col("_a")).otherwise(F.col("_b"))
    mean = F.col("s") / (k * (k - 1) / 2)
    return s.groupBy(by).agg(F.abs(F.sum(F.when(F.col("first"), mean).otherwise(-mean))).alias("statistic"))


def _sums_over_draws(n_draws: int):
    """Arrow function: per draw, the sum of ``total`` over the task's items that are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_draws)
        for batch in batches:
            lists = pa.concat_arrays([batch.column("perms")])
            per = np.diff(lists.offsets.to_numpy())
            sums += np.bincount(lists.flatten().to_numpy(), np.repeat(batch.column("total").to_numpy(), per), n_draws)
        d = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(sums[d])], names=["perm", "r"])

    return run


def permutation_null_jsd(profs: DataFrame, members: DataFrame, groups: tuple[str, str], n_permutations: int, seed: int) -> DataFrame:
    """(perm, statistic): |difference of mean within-group divergence| under random labels.

    Pairs inside the smaller group are summed. Those inside the larger one are all pairs, less every pair with an item of
    the smaller group: the sum of such items' totals over all others counts the pairs inside the smaller group twice.
    """
    lists, n_first, n_second = _first_group(members, groups, n_permutations, seed)
    if n_first > n_second:
        every = F.sequence(F.lit(0), F.lit(n_permutations - 1))
        lists = lists.withColumn("perms", F.array_except(every, "perms"))
    items = _with_profiles(lists, profs).withColumn("position", F.concat_ws("|", "group", "member"))
    items = materialise(items.groupBy("position").agg(F.first("profile").alias("profile"), F.first("perms").alias("perms")), "labels")
    totals = materialise(profiles.divergence_totals(items, "position"), "totals")
    inside = items.filter(F.size("perms") > 0).withColumn("draws", F.transform("perms", lambda p: F.struct(p.alias("d"), F.lit(1.0).alias("w"))))
    small = paired_sums(inside.select("position", "profile", "draws"), "position", n_permutations).select(F.col("d").alias("perm"), "s")
    touched = items.join(totals, "position").select("perms", "total").mapInArrow(_sums_over_draws(n_permutations), "perm int, r double")
    touched = touched.groupBy("perm").agg(F.sum("r").alias("r"))
    every = profs.sparkSession.range(n_permutations).select(F.col("id").cast("int").alias("perm"))
    all_ = every.withColumn("t", totals.agg(F.coalesce(F.sum("total") / 2, F.lit(0.0))).scalar()).join(small, "perm", "left").join(touched, "perm", "left")
    s, r = F.coalesce("s", F.lit(0.0)), F.coalesce("r", F.lit(0.0))

    def mean(total, k):
        return total / (k * (k - 1) / 2) if k > 1 else F.lit(0.0)

    few, many = sorted((n_first, n_second))
    return all_.select("perm", F.abs(mean(s, few) - mean(F.greatest(F.col("t") - r + s, F.lit(0.0)), many)).alias("statistic"))


def observed_gap_jsd(profs: DataFrame, members: DataFrame, groups: tuple[str, str]) -> DataFrame:
    """(statistic): |difference of the two groups' mean within-group divergence|."""
    own = members.filter(F.col("group").isin(*groups)).withColumn(
        "draws", F.array(F.struct(F.lit(0).alias("d"), F.lit(1.0).alias("w")))
    )
    sums = paired_sums(_with_profiles(own, profs), "member", 1, ["group"])
    flagged = sums.select("d", (F.col("group") == groups[0]).alias("first"), "s")
    return _mean_gap(flagged, members, groups, "d").select("statistic")


def permutation_test_jsd(
    profs: DataFrame, members: DataFrame, groups: tuple[str, str], n_permutations: int, seed: int, add_one: bool = False
) -> DataFrame:
    """Observed difference and the share of the null at least as large."""
    observed = observed_gap_jsd(profs, members, groups).scalar()
    null = permutation_null_jsd(profs, members, groups, n_permutations, seed).withColumn("observed", observed)
    hits = F.count_if(F.col("statistic") >= F.col("observed") - TIE)
    extra = 1 if add_one else 0
    return null.agg(
        F.max("observed").alias("observed_diff"),
        ((hits + extra) / (F.count("*") + extra)).alias("p_value"),
        F.count("*").alias("n_permutations"),
    )


def permutation_test_means(values: DataFrame, groups: tuple[str, str], n_permutations: int, seed: int) -> DataFrame:
    """Per attribute, test of the difference of the two group means of (group, member, attribute, share)."""
    v = values.select("group", "member", "attribute", "share").filter(F.col("group").isin(*groups))
    lists, _, _ = _first_group(v.select("group", "member").distinct(), groups, n_permutations, seed)
    rows = lists.join(v, ["group", "member"]).filter("share is not null").select("attribute", "share", "perms")
    # the sums of the first group by permutation; the second group has the rest of all
    parts = rows.mapInArrow(_attribute_sums(n_permutations), "attribute string, perm int, s double, n bigint")
    every = v.sparkSession.range(n_permutations).select(F.col("id").cast("int").alias("perm"))
    first = parts.groupBy("attribute", "perm").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = v.groupBy("attribute").agg(F.sum("share").alias("all_s"), F.count("share").alias("all_n"))
    null = whole.crossJoin(every).join(first, ["attribute", "perm"], "left").na.fill(0, ["s", "n"])
    mean = lambda s, n: F.try_divide(s, F.nullif(n, F.lit(0)))
    null = null.select("attribute", (mean(F.col("s"), F.col("n")) - mean(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n"))).alias("d"))

    def own_mean(g):
        return F.avg(F.when(F.col("group") == g, F.col("share")))

    own = v.groupBy("attribute").agg((own_mean(groups[0]) - own_mean(groups[1])).alias("observed"))
    return null.join(own, "attribute").groupBy("attribute").agg(
        F.first("observed").alias("observed_diff"),
        F.avg((F.abs("d") >= F.abs("observed") - TIE).cast("double")).alias("p_value"),
    )


def _attribute_sums(n_permutations: int):
    """Arrow function: per attribute and permutation, the sum and number of the task's shares that are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lists = pa.concat_arrays([batch.column("perms")])
            at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            shares = batch.column("share").to_numpy()
            for i, name in enumerate(batch.column("attribute").to_pylist()):
                own = sums.setdefault(name, np.zeros((2, n_permutations)))
                some = flat[at[i] - at[0] : at[i + 1] - at[0]]
                own[0, some] += shares[i]
                own[1, some] += 1
        for name, own in sums.items():
            perm = np.flatnonzero(own[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(perm), pa.string()), pa.array(perm.astype(np.int32)), pa.array(own[0, perm]), pa.array(own[1, perm].astype(np.int64))],
                names=["attribute", "perm", "s", "n"],
            )

    return run


# draws of panels that one task fits; members whose cells it holds densely, and fits that it holds, at a time
PANEL_CHUNK, PANEL_DENSE, PANEL_LINES = 250, 512, 100_000


def _panel_fits(n_samples: int, seed, chunk: int, n_attributes: int):
    """Grouped Arrow function: one chunk of draws of a panel, with the cells of all its members.

    A draw's pooled votes are the sums over its distinct members, so leaving one out subtracts that member's cells: steps from
    the whole panel's fit that read the member's own cells only, or, where it weighs much, a fit of what is left. Draws
    with the same distinct members are fitted once.
    """

    def fits(cells: np.ndarray, n: np.ndarray, s: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        beta = irls.fit_shared(cells, n, s, start)
        hits, total = s.sum(axis=1), n.sum(axis=1)
        varies = ((n > 0) & (cells != 0).any(axis=1)).any(axis=1)
        beta[(hits <= 0) | (hits >= total) | ~varies] = 0.0
        return beta

    def without(cells: np.ndarray, whole: np.ndarray, who: np.ndarray, at: np.ndarray, votes: np.ndarray, n_own: int) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients without each member and of all, and the trials that are left."""
        full = fits(cells, whole[:1], whole[1:])
        beta, settled = irls.fit_without(cells, *whole, full[0], who, at, *votes, n_own)
        n, s = (np.append(w.sum() - np.bincount(who, v, n_own), w.sum()) for w, v in zip(whole, votes, strict=True))
        beta[((s <= 0) | (s >= n))[:-1]] = 0.0
        rest = np.flatnonzero(~settled)
        for first in range(0, len(rest), PANEL_DENSE):
            some = rest[first : first + PANEL_DENSE]
            own = np.isin(who, some)
            left = np.repeat(whole[:, None], len(some), axis=1)
            for m in range(2):
                np.subtract.at(left[m], (np.searchsorted(some, who[own]), at[own]), votes[m, own])
            # a panel without one member is near the whole panel
            beta[some] = fits(cells, *np.maximum(left, 0.0), full)
        return np.concatenate([beta, full]), n

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        members = table.select(["member", "pos"]).group_by(["member", "pos"]).aggregate([]).sort_by("pos")
        names, n_members = members["member"].combine_chunks(), members.num_rows
        flat = table["cell"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, n_attributes)
        cells, which = np.unique(flat, axis=0, return_inverse=True)
        votes = np.stack([table[c].to_numpy() for c in ("trials", "successes")])
        used = votes[0] > 0
        who, at, votes = table["pos"].to_numpy()[used], which.ravel()[used], votes[:, used]
        lo = key[0].as_py() * chunk
        draws = range(lo, min(lo + chunk, n_samples))
        copies = np.zeros((len(draws), n_members), np.int64)
        for i, b in enumerate(draws):
            drawn = digests.numbered([f"{seed}|{b}|".encode()], n_members)[0]
            copies[i] = np.bincount(drawn % np.uint32(n_members), minlength=n_members)
        panels, panel_of = np.unique(copies > 0, axis=0, return_inverse=True)
        del table, flat, which

        def lines(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            b, j, times, beta = (np.concatenate(c) for c in zip(*out, strict=True))
            ends = np.arange(0, beta.size + 1, n_attributes, dtype=np.int32)
            cols = [pa.array(b), names.take(pa.array(j, mask=j < 0)), pa.array(times), pa.ListArray.from_arrays(ends, pa.array(beta.ravel()))]
            return pa.RecordBatch.from_arrays(cols, names=["b", "member", "copies", "beta"])

        out: list[tuple[np.ndarray, ...]] = []
        for k, has in enumerate(panels):
            own = np.flatnonzero(has)
            mine = has[who]
            whole = np.stack([np.bincount(at[mine], v[mine], len(cells)) for v in votes])
            some = whole[0] > 0
            beta, n = without(cells[some], whole[:, some], (np.cumsum(has) - 1)[who[mine]], (np.cumsum(some) - 1)[at[mine]], votes[:, mine], len(own))
            kept = np.flatnonzero(n > 0)
            for i in np.flatnonzero(panel_of.ravel() == k):
                out.append((np.full(len(kept), lo + i, np.int32), np.append(own, -1)[kept], np.append(copies[i, own], 1)[kept], beta[kept]))
                if sum(len(x[0]) for x in out) >= PANEL_LINES:
                    yield lines(out)
                    out = []
        if out:
            yield lines(out)

    return run


def panel_fits(member_cells: DataFrame, panel: DataFrame, n_samples: int, seed: int, attributes: list[str] = ATTRIBUTES, chunk: int = PANEL_CHUNK) -> DataFrame:
    """(b, member, copies, beta): the fits of every drawn panel without any copy of each member, and of the whole panel (member null).

    A task fits a chunk of draws. It holds the design cells of all members (at most 5 ** attributes each) and makes its draws itself,
    so no draws, members of draws or their cells are rows. A panel that one member alone makes up has no fit without it.
    """
    _check(n_samples)
    pos = dense_position(panel, "member").select("member", "pos")
    cell = F.array(*[F.col(f"d_{a}").cast("double") for a in attributes])
    own = member_cells.select(F.col("rater").alias("_rater"), cell.alias("cell"), F.col("trials").cast("double").alias("trials"), F.col("successes").cast("double").alias("successes"))
    rows = pos.join(own, F.col("member") == F.col("_rater"), "left").select(
        "member", "pos", F.coalesce("cell", F.array(*[F.lit(0.0) for _ in attributes])).alias("cell"),
        F.coalesce("trials", F.lit(0.0)).alias("trials"), F.coalesce("successes", F.lit(0.0)).alias("successes"),
    )
    n_chunks = -(-n_samples // chunk)
    spread = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    # the cells are few bytes and their fits much work: without a number of partitions one task would make them all
    spread = spread.repartition(4 * n_chunks, "_chunk")
    return spread.groupBy("_chunk").applyInArrow(_panel_fits(n_samples, seed, chunk, len(attributes)), "b int, member string, copies bigint, beta array<double>")


def panel_reference(
    member_cells: DataFrame, profiles_by_member: DataFrame, panel: DataFrame, raters: DataFrame,
    n_samples: int, seed: int, temperature: float, attributes: list[str] = ATTRIBUTES,
) -> DataFrame:
    """Leave-one-out panel bootstrap (R8): (b, kind, id, copies, jsd).

    Every member of a drawn panel is compared with the consensus of the panel without any copy of
    that member, and every rater with the consensus of the whole drawn panel.
    """
    fits = panel_fits(member_cells, panel, n_samples, seed, attributes)
    consensus = materialise(fits.select("b", "member", "copies", profiles.softmax("beta", temperature).alias("panel")), "panels")
    mine = profiles_by_member.select(F.col("rater").alias("id"), "profile")
    left_out = consensus.filter("member is not null").withColumnRenamed("member", "id").join(mine, "id")
    loo = left_out.select("b", F.lit("member").alias("kind"), "id", "copies", profiles.jsd("profile", "panel").alias("jsd"))
    full = consensus.filter("member is null").select("b", "panel")
    theirs = raters.select(F.col("rater").alias("id"), "profile", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("b"))
    vs_full = theirs.join(full, "b").select(
        "b", F.lit("rater").alias("kind"), "id", F.lit(1).cast("bigint").alias("copies"), profiles.jsd("profile", "panel").alias("jsd")
    )
    return loo.unionByName(vs_full)


def calibration(reference: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed distance, percentile interval over draws and share of the reference at least as far.

    The reference distribution is reduced to cumulative counts per distinct value and each observed
    distance looks up its place, so it is never crossed with the raters.
    """
    ci = reference.filter("kind = 'rater'").groupBy("id").agg(
        F.percentile("jsd", F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    )
    # merge the observed values into the reference and read the running weight of everything beyond
    marks = reference.filter("kind = 'member'").groupBy(F.round("jsd", 12).alias("jsd")).agg(F.sum("copies").alias("w"))
    total = marks.agg(F.sum("w")).scalar()
    obs = observed.select("id", F.round("jsd", 12).alias("jsd"))
    tagged = marks.select("jsd", "w", F.lit(None).cast("string").alias("id")).unionByName(
        obs.select("jsd", F.lit(0).cast("bigint").alias("w"), "id")
    )
    bucket = F.floor(F.col("jsd") * 1024)
    tagged = tagged.withColumn("bucket", bucket)
    # 1025 buckets at most, because the divergence lies in [0, 1]
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = tagged.groupBy("bucket").agg(F.sum("w").alias("bw")).select(
        "bucket", F.coalesce(F.sum("bw").over(later), F.lit(0)).alias("beyond")
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("jsd")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tagged.withColumn("at_least", F.sum("w").over(inside)).filter("id is not null").join(beyond, "bucket")
    share = (F.col("at_least") + F.col("beyond")) / total
    p = ranked.select("id", share.alias("p_value"))
    return observed.join(ci, "id").join(p, "id").select(
        "id", F.col("jsd").alias("observed_jsd"), F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "p_value"
    )


# buckets that the values of a percentile are counted in
CUT_BINS = 16_384


def _weighted_percentile(rows: DataFrame, value: str, weight: str, level: float) -> DataFrame:
    """(cut): the percentile of values that count ``weight`` times, between the two ranks around it, as ``percentile`` has it.

    Values are counted in buckets between the least and the largest; only those of the buckets that hold the two ranks are
    ordered. So no task holds all distinct values, nor is there one that reads them all.
    """
    v = rows.select(F.col(value).alias("v"), F.col(weight).alias("w")).filter("v is not null and w > 0")
    finite = v.filter(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))
    ends = finite.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, width = (ends.lo, ends.hi - ends.lo) if ends.lo is not None else (0.0, 0.0)
    place = F.floor((F.col("v") - F.lit(lo)) / F.lit(width) * CUT_BINS) if 0 < width < float("inf") else F.lit(0)
    bucket = F.when(F.isnan("v"), F.lit(CUT_BINS + 2)).when(F.col("v") == float("inf"), F.lit(CUT_BINS + 1)).when(F.col("v") == float("-inf"), F.lit(-1)).otherwise(place)
    tagged = v.withColumn("bucket", bucket.cast("int"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = tagged.groupBy("bucket").agg(F.sum("w").alias("bw")).select("bucket", "bw", F.sum("bw").over(upto).alias("upto"), F.sum("bw").over(Window.partitionBy(F.lit(1))).alias("total"))
    at = counted.withColumn("at", (F.col("total") - 1) * F.lit(float(level))).withColumn("lower", F.floor("at")).withColumn("higher", F.ceil("at"))
    opened = at.filter((F.col("upto") - F.col("bw") <= F.col("higher")) & (F.col("upto") > F.col("lower")))
    values = tagged.join(opened, "bucket").groupBy("v").agg(F.sum("w").alias("w"), *[F.first(c).alias(c) for c in ("bucket", "bw", "upto", "at", "lower", "higher")])
    inside = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("rank", F.col("upto") - F.col("bw") + F.sum("w").over(inside))
    key = lambda rank: F.min(F.when(F.col("rank") > F.col(rank), F.col("v")))
    found = ranked.agg(key("lower").alias("a"), key("higher").alias("b"), F.first("at").alias("at"), F.first("lower").alias("lower"), F.first("higher").alias("higher"))
    between = (F.col("higher") - F.col("at")) * F.col("a") + (F.col("at") - F.col("lower")) * F.col("b")
    return found.select(F.when((F.col("lower") == F.col("higher")) | (F.col("a") == F.col("b")), F.col("a")).otherwise(between).alias("cut"))


def reference_cut(reference: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile of the member distances, copies counted."""
    m = reference.filter("kind = 'member'")
    totals = m.agg(F.sum("copies").alias("n_values"), (F.sum(F.col("jsd") * F.col("copies")) / F.sum("copies")).alias("mean"))
    return _weighted_percentile(m, "jsd", "copies", level).crossJoin(totals).select("cut", "n_values", "mean")


def histogram(samples: DataFrame, value: str, bins: int = 80) -> DataFrame:
    """Equal-width counts between the smallest and the largest value, the last bin closed."""
    lo = samples.agg(F.min(value)).scalar()
    hi = samples.agg(F.max(value)).scalar()
    s = samples.select(F.col(value).alias("v")).withColumn("lo", lo).withColumn("hi", hi)
    step = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), step)), F.lit(bins - 1))
    )
    return s.groupBy(bin_no.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def sampled_pairs(draws: DataFrame, key: str, first: DataFrame, second: DataFrame, seed: int) -> DataFrame:
    """One random entry of each of two lists per draw (R10); lists are (pos, n, ...) tables."""
    pick = lambda df, tag: draws.select(key).withColumn("n", df.agg(F.max("n")).scalar()).select(
        key, (hash_u32(F.lit(str(seed)), F.lit(tag), F.col(key)) % F.col("n")).alias("pos")
    ).join(df.drop("n"), "pos").drop("pos")
    return pick(first, "first").join(pick(second, "second"), key)
