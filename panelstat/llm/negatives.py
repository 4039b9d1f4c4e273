"""Hard negatives by blocks along a Hilbert curve, with zone maps.

Vectors become integers (floor of ``scale`` times each component) and are written as Parquet blocks in the order of a Hilbert curve through
their space, so that a block is a small box of it. A block's zone map is the least and the largest value of every dimension.
Interval arithmetic on it bounds the scores (inner products) that an anchor can have in the block: the products with
the ends of each interval, added up.

1. Positives: the first ``n_positives`` other rows of the anchor's label. The anchor's own block gives a score that they
   must reach; only blocks that hold the label and whose upper bound reaches it are read.
2. Negatives: every positive's score opens a window of scores. A block is read for an anchor if it holds another label and
   its bounds meet one of the anchor's windows.

The unit of work is some blocks met by some anchors. Blocks belong to runs along the curve (about RUN_ROWS rows), anchors to groups of at
most GROUP; for each group and run the zone maps choose the blocks, and only these are joined to the anchors. In a task the blocks come in the
order of their upper bounds, so that those under what each window has already found are passed over. A task hands on
the first of each window in its run, and the first of all runs are the result: exact, whatever the blocks.

The axes of the curve are the main axes of a sample of SAMPLE rows (those with the smallest hashes). Every row is placed, and no
result depends on the places.

Scores are exact integers: products in doubles while their sums stay below 2 ** 53, else in Python integers.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part. Every other row
is a candidate for all anchors but itself, also rows with the same id or vector. Vectors of different lengths do not
meet; empty vectors score 0. Ties go to the smaller id, null ids last. An anchor without positives, or a window without
rows, has no result. A component or score over 64 bits is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstat.llm.common import cut

SCALE, N_POSITIVES, N_NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90  # the window, in hundredths of the positive's score
BLOCK_ROWS, RUN_ROWS, GROUP = 256, 1 << 15, 1 << 10
CURVE_DIMS, CURVE_BITS, SAMPLE = 12, 5, 4096  # axes and bits of the curve; rows that the axes are taken from
NO_ID, _EXACT = np.int64(2**63 - 1), 2**53


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of small non-negative integers (``bits`` bits a dimension), as big-endian bytes.

    Coordinates are turned into the transposed index (Skilling, "Programming the Hilbert curve", 2004), whose bits, read across the
    dimensions from the highest down, are the place.
    """
    x = x.astype(np.int64).T.copy()
    n = len(x)
    for k in range(bits - 1, 0, -1):
        high, low = 1 << k, (1 << k) - 1
        for i in range(n):
            flip = (x[i] & high) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for k in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << k), (1 << k) - 1, 0)
    x ^= turn
    planes = [(x[i] >> k) & 1 for k in range(bits - 1, -1, -1) for i in range(n)]
    return np.packbits(np.array(planes, np.uint8), axis=0).T.copy()


class Axes:
    """The main axes of vectors of each length, from a sample: what decides the order of the blocks, and nothing else."""

    def __init__(self, sample: list[list[float]], dims: int = CURVE_DIMS, bits: int = CURVE_BITS):
        self.dims, self.bits, self.known = dims, bits, {}
        for size in {len(v) for v in sample} - {0}:
            x = np.array([v for v in sample if len(v) == size], np.float64)
            middle = x.mean(axis=0)
            spread, axes = np.linalg.svd(x - middle, full_matrices=False)[1:]
            # five deviations of the longest axis fill the curve's steps
            self.known[size] = middle, axes[:dims], max(5 * float(spread[0]) / math.sqrt(len(x)), 1e-9) / (1 << bits)

    def places(self, vectors: pa.Array) -> pa.Array:
        """Curve places of vectors of any lengths; lengths that the sample does not have are at the curve's begin."""
        out: list[bytes] = [b""] * len(vectors)
        lengths = np.asarray([len(v) for v in vectors], np.int64)
        for size in np.unique(lengths):
            if size not in self.known:
                continue
            rows = np.flatnonzero(lengths == size)
            middle, axes, step = self.known[size]
            own = np.asarray(vectors.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), size)
            cells = np.clip(np.rint((own - middle) @ axes.T / step) + (1 << self.bits >> 1), 0, (1 << self.bits) - 1)
            for r, place in zip(rows.tolist(), hilbert(cells, self.bits), strict=True):
                out[r] = place.tobytes()
        return pa.array(out, pa.binary())


def quantised(rows: DataFrame, scale: int = SCALE, relabel: Column | None = None) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: q is the floor of ``scale`` times each component, taken as double."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    label = F.col("label") if relabel is None else relabel
    picked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(fine, x).alias("x"))
    q = F.transform("x", lambda v: F.floor(v * scale).cast("long"))
    return picked.filter("label is not null and x is not null").select("vec_id", "label", "x", q.alias("q"))


def _least_type(q: np.ndarray) -> np.dtype:
    for kind in (np.int16, np.int32, np.int64):
        if not q.size or (q.min() >= np.iinfo(kind).min and q.max() <= np.iinfo(kind).max):
            return np.dtype(kind)
    raise OverflowError("a component over 64 bits")


BLOCKS = "block long, n int, dims int, kind string, ids binary, labels binary, q binary, low binary, high binary, least_label long, most_label long"


def _pack(block_rows: int):
    """Rows in curve order to blocks of one length of vectors."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 5, pa.int64(), pa.int64()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: pa.Table | None = None

        def blocks(t: pa.Table, last: bool) -> tuple[list[tuple], pa.Table]:
            nonlocal number
            out, dims = [], np.asarray(t["dims"].combine_chunks(), np.int64)
            at = 0
            while at < len(dims):
                same = int(np.argmin(np.append(dims[at: at + block_rows] == dims[at], False)))
                if same < block_rows and at + same == len(dims) and not last:
                    break
                own = t.slice(at, same)
                ids = np.asarray(own["vec_id"].combine_chunks().fill_null(int(NO_ID)), np.int64)
                labels = np.asarray(own["label"].combine_chunks(), np.int64)
                q = np.asarray(own["q"].combine_chunks().flatten(), np.int64).reshape(same, int(dims[at]))
                kind = _least_type(q)
                out.append((number, same, int(dims[at]), kind.str, ids.tobytes(), labels.tobytes(), q.astype(kind).tobytes(), q.min(0).tobytes(), q.max(0).tobytes(), int(labels.min()), int(labels.max())))
                number, at = number + 1, at + same
            return out, t.slice(at)

        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            done, held = blocks(held, False)
            for i in range(0, len(done), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done[i: i + 64], strict=True), types, strict=True)], names=names)
        done = blocks(held, True)[0] if held is not None else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    return pack


def write_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, run_rows: int = RUN_ROWS) -> tuple[DataFrame, int]:
    """Blocks in curve order with their zone maps and ``run``, the number of the run each belongs to; and the number of runs."""
    spark = rows.sparkSession

    axes = Axes([r[0] for r in rows.orderBy(F.xxhash64("vec_id", "q")).limit(SAMPLE).select("x").collect()])

    @F.arrow_udf("binary")
    def place(x: pa.Array) -> pa.Array:
        return axes.places(x)

    # the last key only spreads equal vectors over partitions
    keyed = rows.select("vec_id", "label", "q", F.size("q").alias("dims"), place("x").alias("_place"), F.monotonically_increasing_id().alias("_spread"))
    n = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / run_rows))
    order = ["dims", "_place", "_spread"]
    sorted_rows = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "label", "q", "dims")
    # a partition of the sort is a run: its number is the upper half of its blocks' numbers
    blocks = cut(sorted_rows.mapInArrow(_pack(block_rows), BLOCKS), "hilbert-blocks")
    return blocks.withColumn("run", F.shiftright("block", 32)), parts


class _Block:
    def __init__(self, row: dict):
        self.number, self.n, self.dims = row["block"], row["n"], row["dims"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.q = np.frombuffer(row["q"], row["kind"]).reshape(self.n, self.dims).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: by doubles, by 64-bit integers, or by Python integers where sums can pass 64 bits."""
    size = max(a.shape[1], 1) * max(int(a.max(initial=0)), -int(a.min(initial=0))) * max(int(b.max(initial=0)), -int(b.min(initial=0)))
    if size < _EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T if size >= 2**62 else a @ b.T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) score that each row of ``a`` can have in each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return tuple(np.clip(product(up, x) + product(down, y), -(2**62), 2**62).astype(np.int64) for x, y in ((low, high), (high, low)))


def window(p: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest integer n with low * p <= 100 * n <= high * p."""
    big = len(p) and max(abs(int(p.max())), abs(int(p.min()))) >= 2**62 // 100
    p = p.astype(object) if big else p
    return (-((-low * p) // 100)).astype(np.int64), (high * p // 100).astype(np.int64)


ANCHORS = "grp long, n int, dims int, kind string, block binary, place binary, ids binary, labels binary, q binary, floor binary"


def _anchors(modulo: int, k: int, group: int):
    """The anchors of blocks, with the k-th best score of their label within their own block (or the least number)."""
    names = [c.split()[0] for c in ANCHORS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 6]

    def floors(b: _Block, at: np.ndarray) -> np.ndarray:
        scores = product(b.q[at], b.q)
        scores[np.arange(len(at)), at] = -(2**62)
        scores = np.where(b.labels[at][:, None] == b.labels, scores, -(2**62))
        return np.sort(scores, axis=1)[:, -k].astype(np.int64) if b.n >= k else np.full(len(at), -(2**62))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def out() -> pa.RecordBatch:
            nonlocal number, held
            q = np.concatenate([h[4] for h in held])
            kind = _least_type(q)
            row = [number, len(q), q.shape[1], kind.str, *[np.concatenate([h[i] for h in held]).astype(np.int64).tobytes() for i in range(4)], q.astype(kind).tobytes(), np.concatenate([h[5] for h in held]).tobytes()]
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                at = np.flatnonzero((b.ids % modulo == 0) & (b.ids != NO_ID))
                if not len(at):
                    continue
                if held and (held[0][4].shape[1] != b.dims or sum(len(h[0]) for h in held) + len(at) > group):
                    yield out()
                held.append((np.full(len(at), b.number), at, b.ids[at], b.labels[at], b.q[at], floors(b, at)))
        if held:
            yield out()

    return anchors


class _Group:
    def __init__(self, row: dict):
        self.number, self.n, self.dims = row["grp"], row["n"], row["dims"]
        self.block, self.place, self.ids, self.labels, self.floor = (np.frombuffer(row[c], np.int64) for c in ("block", "place", "ids", "labels", "floor"))
        self.q = np.frombuffer(row["q"], row["kind"]).reshape(self.n, self.dims).astype(np.int64)


def _wanted(g: _Group, zones: dict, low: int, high: int, windows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For a group and zone maps: (which blocks each anchor must read, the upper bounds)."""
    least, most = bounds(g.q, zones["low"], zones["high"])
    if windows is None:
        held = (zones["least_label"] <= g.labels[:, None]) & (g.labels[:, None] <= zones["most_label"])
        return held & (most >= g.floor[:, None]), most
    wanted = np.zeros(least.shape, bool)
    for k in range(windows.shape[1]):
        p = windows[:, k]
        lo, hi = window(np.where(p == NO_ID, 0, p), low, high)
        wanted |= (p != NO_ID)[:, None] & (least <= hi[:, None]) & (most >= lo[:, None])
    other = (zones["least_label"] != zones["most_label"]) | (zones["least_label"] != g.labels[:, None])
    return wanted & other, most


def _zones(rows: list[dict]) -> dict:
    dims = rows[0]["dims"]
    return {c: np.frombuffer(b"".join(r[c] for r in rows), np.int64).reshape(len(rows), dims) for c in ("low", "high")} | {c: np.array([r[c] for r in rows], np.int64) for c in ("least_label", "most_label")}


def _choose(low: int, high: int):
    """Of the zone maps of one run and some groups: (grp, block) for every block that an anchor of the group must read."""

    def choose(key: tuple, groups: pa.Table, zones: pa.Table) -> pa.Table:
        grp, block = [], []
        by_dims: dict[int, list[dict]] = {}
        for z in zones.to_pylist():
            by_dims.setdefault(z["dims"], []).append(z)
        known = {d: _zones(z) for d, z in by_dims.items()}
        for row in groups.to_pylist():
            g = _Group(row)
            if g.dims in known:
                wanted, _ = _wanted(g, known[g.dims], low, high, _windows(row, g.n))
                for i in np.flatnonzero(wanted.any(axis=0)):
                    grp.append(g.number)
                    block.append(by_dims[g.dims][i]["block"])
        return pa.table({"grp": pa.array(grp, pa.int64()), "block": pa.array(block, pa.int64()), "salt": pa.array([key[1].as_py()] * len(grp), pa.int64())})

    return choose


def _windows(row: dict, n: int) -> np.ndarray | None:
    return None if row.get("windows") is None else np.frombuffer(row["windows"], np.int64).reshape(n, -1)


class _Best:
    """The best k (score, id) of each slot, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        self.full = np.zeros((n, 0), bool)

    def least(self) -> np.ndarray:
        """What a score must reach to count."""
        if self.score.shape[1] < self.k:
            return np.full(len(self.score), -(2**63), np.int64)
        return np.where(self.full[:, -1], self.score[:, -1], -(2**63))

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Candidates (the columns) for the slots ``at`` (the rows)."""
        own = fits.any(axis=1)
        at, score, fits = at[own], score[own], fits[own]
        if not len(at):
            return
        if fits.shape[1] > 4 * self.k:  # most columns are no use: keep each row's best k and what ties with the last
            top = np.where(fits, score, -(2**63))
            last = np.partition(top, -self.k, axis=1)[:, -self.k]
            fits &= top >= last[:, None]
            used = fits.any(axis=0)
            score, ids, fits = score[:, used], ids[used], fits[:, used]
        s = np.concatenate([self.score[at], np.where(fits, score, 0)], axis=1)
        i = np.concatenate([self.id[at], np.broadcast_to(ids, score.shape)], axis=1)
        f = np.concatenate([self.full[at], fits], axis=1)
        order = np.lexsort((i, np.where(f, -s, 0), ~f), axis=1)[:, : self.k]
        s, i, f = (np.take_along_axis(x, order, axis=1) for x in (s, i, f))
        width = s.shape[1]
        if self.score.shape[1] < width:
            more = ((0, 0), (0, width - self.score.shape[1]))
            self.score, self.id, self.full = np.pad(self.score, more), np.pad(self.id, more), np.pad(self.full, more)
        self.score[at, :width], self.id[at, :width], self.full[at, :width] = s, i, f


READ = "anchor_block long, anchor_place long, anchor_id long, window int, id long, score long"


def _read(k: int, low: int, high: int):
    """Some blocks and the groups that read some of them: the best k of each window of each anchor in these blocks."""

    def read(groups: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = {r["block"]: r for r in blocks.to_pylist()}
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for row in groups.to_pylist():
            g = _Group(row)
            own = [rows[b] for b in row["blocks"]]
            p = _windows(row, g.n)
            wanted, most = _wanted(g, _zones(own), low, high, p)
            n_windows = 1 if p is None else p.shape[1]
            if p is not None:
                edges = [window(np.where(p[:, w] == NO_ID, 0, p[:, w]), low, high) for w in range(n_windows)]
            best = [_Best(g.n, k) for _ in range(n_windows)]
            for j in np.argsort(-np.where(wanted, most, -(2**62)).max(axis=0).astype(np.float64), kind="stable"):
                # an anchor needs the block while its upper bound reaches what a window has found so far
                reach = np.zeros(g.n, bool)
                for w, b in enumerate(best):
                    reach |= most[:, j] >= (np.maximum(b.least(), g.floor) if p is None else b.least())
                at = np.flatnonzero(wanted[:, j] & reach)
                if not len(at):
                    continue
                b = _Block(own[j])
                score = product(g.q[at], b.q).astype(np.int64)
                same = g.labels[at][:, None] == b.labels
                if p is None:
                    itself = (g.block[at] == b.number)[:, None] & (g.place[at][:, None] == np.arange(b.n))
                    best[0].add(at, score, b.ids, same & ~itself)
                    continue
                for w in range(n_windows):
                    lo, hi = (e[at][:, None] for e in edges[w])
                    floor = best[w].least()[at][:, None]
                    best[w].add(at, score, b.ids, ~same & (p[at, w] != NO_ID)[:, None] & (score >= lo) & (score <= hi) & (score >= floor))
            for w, b in enumerate(best):
                i, j = np.nonzero(b.full)
                for c, v in zip(cols, (g.block[i], g.place[i], g.ids[i], np.full(len(i), w, np.int32), b.id[i, j], b.score[i, j]), strict=True):
                    c.append(v)
        names = [c.split()[0] for c in READ.split(", ")]
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0), pa.int32() if n == "window" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)

    return read


def _search(groups: DataFrame, blocks: DataFrame, n_runs: int, k: int, low: int, high: int, label: str) -> DataFrame:
    """The best k of each window of each anchor: READ and ``rank``."""
    # some groups meet some runs: the anchors go to the blocks, and only to runs whose zone maps ask for them
    n_salts = math.ceil(groups.count() / 8) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("grp"), F.lit(n_salts))).withColumn("run", every(n_runs))
    zones = blocks.select("block", "run", "dims", "low", "high", "least_label", "most_label").withColumn("salt", every(n_salts))
    chosen = salted.groupBy("run", "salt").cogroup(zones.groupBy("run", "salt")).applyInArrow(_choose(low, high), "grp long, block long, salt long")
    chosen = cut(chosen, f"{label}-chosen")
    run = F.shiftright("block", 32)
    asked = chosen.groupBy("grp", "salt", run.alias("run")).agg(F.collect_list("block").alias("blocks"))
    asked = asked.join(groups, "grp")
    needed = chosen.select("block", F.col("salt").alias("_salt"), run.alias("_run")).distinct().join(blocks.drop("run"), "block")
    found = asked.groupBy("run", "salt").cogroup(needed.groupBy("_run", "_salt")).applyInArrow(_read(k, low, high), READ)
    first = F.row_number().over(Window.partitionBy("anchor_block", "anchor_place", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", first).filter(F.col("rank") <= k)


def mine(rows: DataFrame, modulo: int = 100, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
         relabel: Column | None = None, block_rows: int = BLOCK_ROWS, run_rows: int = RUN_ROWS, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, embedding, label. Anchors are those whose vec_id is divisible by ``modulo``. For each anchor and each of its
    positives, the first ``n_negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.
    """
    blocks, n_runs = write_blocks(quantised(rows, scale, relabel), block_rows, run_rows)
    anchors = cut(blocks.drop("run").mapInArrow(_anchors(modulo, n_positives, group), ANCHORS), "anchors")
    positives = cut(_search(anchors, blocks, n_runs, n_positives, low, high, "positives"), "positives")
    # the windows go to the anchors' groups; an anchor of a group is known by its block and place
    scores = positives.groupBy("anchor_block", "anchor_place").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    members = anchors.select("grp", "n", "block", "place").mapInArrow(_members, "grp long, n int, i int, anchor_block long, anchor_place long")
    placed = members.join(scores, ["anchor_block", "anchor_place"]).select("grp", "n", "i", "scores")
    opened = placed.groupBy("grp").applyInArrow(_opened(n_positives), "grp long, windows binary")
    found = _search(anchors.join(opened, "grp"), blocks, n_runs, n_negatives, low, high, "negatives")
    positive = positives.select("anchor_block", "anchor_place", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    known = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    return found.join(positive, ["anchor_block", "anchor_place", "window"]).select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            n = row["n"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["grp"])), pa.array(np.full(n, n, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.frombuffer(row["block"], np.int64)), pa.array(np.frombuffer(row["place"], np.int64))], names=["grp", "n", "i", "anchor_block", "anchor_place"])


def _opened(k: int):
    def opened(t: pa.Table) -> pa.Table:
        out = np.full((t["n"][0].as_py(), k), NO_ID)
        for i, scores in zip(t["i"].to_pylist(), t["scores"].to_pylist(), strict=True):
            for s in scores:
                out[i, s["rank"] - 1] = s["score"]
        return pa.table({"grp": t["grp"].slice(0, 1).combine_chunks(), "windows": pa.array([out.tobytes()], pa.binary())})

    return opened
