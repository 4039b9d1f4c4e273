"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits meet halfway: some value lies within half the radius of both. Every
fingerprint emits all values within half the radius, the values are shuffled, and fingerprints that share one are
verified. An odd radius leaves one bit over. So the bits are dealt to ``blanks`` blocks and the values are
emitted with one block blanked, for each block in turn: a pair that differs in 2k+1 bits differs in at
most 2k of the others for some block, and balls of k bits meet. With radius 3 and 3 blanks that is 3 + 128
values for a fingerprint, instead of the 2081 that one side alone would need.

A pair meets in several values; only the first of them (lowest block, lowest bits of the difference flipped
first) is kept, so no pair is linked twice and no shuffle removes repeats. Documents with the same fingerprint are
one class before anything is emitted, so copies never become pairs; what meets are distinct fingerprints.

Defined cases: a text is lower-cased (A-Z), words are runs of anything but ASCII white space. With fewer words than a
shingle has the whole sequence is the one shingle; without words the fingerprint is zero, as is that
of a null text. Rows with a null doc_id are fingerprinted and link others, but are no component's smallest unless all
are null. Equal rows stay rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstat.llm import words as W
from panelstat.llm.common import cut, n_blocks
from panelstat.llm.components import components

SHINGLE, RADIUS, BLANKS, SEED = 3, 3, 3, 42


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_digest
    raw = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(raw), ">u8").astype(np.uint64)


def simhash(h: np.ndarray, step: int = 1 << 16) -> int:
    """A bit is 1 if over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), step):
        part = h[a: a + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if x else "0" for x in ones * 2 > len(h)), 2)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number; texts stay where they are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(shingle_hashes(x.as_py(), width)) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(blanks: int) -> list[list[int]]:
    return [list(range(64 * k // blanks, 64 * (k + 1) // blanks)) for k in range(blanks)]


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks that flip up to ``most`` of the bits."""
    return [_signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def _lowest(x: Column, k: int) -> Column:
    """The k lowest bits set in x."""
    out = F.lit(0).cast("long")
    for _ in range(k):
        plain = x.bitwiseAND(F.lit(2**63 - 1).cast("long"))  # the sign bit alone cannot be negated
        low = F.when(plain == 0, x).otherwise(plain.bitwiseAND(-plain))
        out, x = out.bitwiseOR(low), x.bitwiseXOR(low)
    return out


def close_pairs(fps: DataFrame, radius: int = RADIUS, blanks: int = BLANKS) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct fingerprints ``fp`` that differ in at most ``radius`` bits."""
    half = radius // 2
    blanks = blanks if radius % 2 else 1
    dealt = _blocks(blanks)
    masks = []
    for block in dealt:
        left = [b for b in range(64) if radius % 2 == 0 or b not in block]
        masks.append((_signed(sum(1 << b for b in left)), _flips(left, half)))
    # a blanked block holds the block's number instead: its bits are free
    balls = F.array(*[F.struct(F.lit(keep).cast("long").alias("keep"), F.lit(_signed((k + 1) << block[0] if radius % 2 else 0)).cast("long").alias("tag"), F.lit(k).alias("k"), F.array(*[F.lit(f).cast("long") for f in flips]).alias("flips")) for k, ((keep, flips), block) in enumerate(zip(masks, dealt, strict=True))])
    ball = fps.select("fp", F.explode(balls).alias("s")).select("fp", "s.*")
    values = ball.select(
        F.col("fp").bitwiseAND(F.col("keep")).bitwiseOR(F.col("tag")).alias("_centre"), "fp", F.explode("flips").alias("_flip"),
    ).select(F.col("_centre").bitwiseXOR(F.col("_flip")).alias("value"), "fp")

    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(None).cast("long")
    for k, (keep, _) in reversed(list(enumerate(masks))):
        rest = x.bitwiseAND(F.lit(keep).cast("long"))
        n = F.bit_count(rest)
        tag = _signed((k + 1) << dealt[k][0]) if radius % 2 else 0
        middle = F.lit(0).cast("long")
        for m in range(half, 0, -1):
            # with d bits between them the first value that both reach flips the d // 2 lowest
            middle = F.when(F.floor(n / 2) == m, _lowest(rest, m)).otherwise(middle)
        centre = F.col("a").bitwiseAND(F.lit(keep).cast("long")).bitwiseOR(F.lit(tag).cast("long"))
        first = F.when(n <= 2 * half, centre.bitwiseXOR(middle)).otherwise(first)
    left = values.select("value", F.col("fp").alias("a"))
    right = values.select(F.col("value"), F.col("fp").alias("b"))
    # the planner does not see that each fingerprint becomes many values and would broadcast them
    return left.hint("merge").join(right.hint("merge"), "value").filter((F.col("a") < F.col("b")) & (F.bit_count(x) <= radius) & (F.col("value") == first)).select("a", "b")


def linked(fps: DataFrame, radius: int = RADIUS, blanks: int = BLANKS) -> DataFrame:
    """The pairs of ``close_pairs`` among the distinct fingerprints ``fp``, written once."""
    return cut(close_pairs(fps, radius, blanks), "simhash-pairs")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, blanks: int = BLANKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), n_links.

    n_links counts the other fingerprints that this one is linked to.
    """
    fps = cut(fingerprints(docs, width), "simhash")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    pairs = linked(classes.select("fp"), radius, blanks)
    roots = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    member = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = member.join(smallest, "root").join(links, "fp", "left").select(F.col("fp").alias("_fp"), "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return fps.join(member, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


# Near copies by their fingerprints and, besides, by their shingle sets: equal minima find families, the sets themselves judge.

WIDE, SHARE = 5, 0.8
ROWS, GROUPS = 5, 25  # a pair of likeness 0.8 shares no value of 25 with probability (1 - 0.8 ** 5) ** 25 = 5e-5
SKETCH, FAR = 128, 30  # bits that differ with probability (1 - likeness) / 2: more than 30 at likeness 0.8 has probability 2e-6
MEMBERS, VALUE_ROWS = 1 << 13, 1 << 19  # members of a value that one task compares, and rows of a partition of values
FAMILY, SHINGLES, OFTEN = 1 << 11, 1 << 20, 16  # members and shingles of a block of a family; holders of a shingle that are paired one by one
_FACTORS = W._mixed(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def _node(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W._mixed(a ^ W._mixed(b + np.uint64(1))).view(np.int64)


class _Forest:
    """Joins nodes and keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.label[a] != self.label[b]
        if not new.any():
            return
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            u, v = find(int(self.label[x])), find(int(self.label[y]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                self.edges.append((x, y))
        to = np.arange(len(self.label))
        for u in parent:
            to[u] = find(u)
        self.label = to[self.label]


def shingle_sets(texts: pa.Array, width: int = WIDE) -> Iterator[list[np.ndarray]]:
    """Chunk by chunk, the distinct shingles of each row, ascending."""
    for _, _, data, offsets in W.chunks(texts):
        data = W.lowered(data)
        starts, ends, first = W.spans(data, offsets)
        h = W.hashes(data, starts, ends)
        whole = W.windows(h, width)
        yield [np.unique(whole[x: y - width + 1] if y - x >= width else W.windows(h[x:y], y - x)) if y > x else h[:0] for x, y in zip(first[:-1], first[1:], strict=True)]


def _set_node(s: np.ndarray) -> int:
    return int(_node(s.sum(dtype=np.uint64, keepdims=True), W._mixed(s).sum(dtype=np.uint64, keepdims=True))[0])


def _shortened(s: np.ndarray) -> np.ndarray:
    """The distinct upper halves of ascending hashes. Two texts of n words have a false common one with probability n ** 2 / 2 ** 32."""
    upper = (s >> np.uint64(32)).astype(np.uint32)
    return upper[np.append(True, upper[1:] != upper[:-1])].view(np.int32) if len(s) else upper.view(np.int32)


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least of each set under SKETCH orders of all hashes; sets without any have zeros."""
    out = np.zeros((len(sets), SKETCH), np.uint64)
    full = np.array([len(s) > 0 for s in sets], bool)
    if full.any():
        flat = np.concatenate(sets)
        at = np.append(0, np.cumsum([len(s) for s in sets]))[:-1][full]
        for k, factor in enumerate(_FACTORS):
            out[full, k] = np.minimum.reduceat(flat * factor, at)
    return out


def sketches(docs: DataFrame, width: int = WIDE) -> DataFrame:
    """The rows of ``docs`` as doc_id, fp (SimHash), node, s0 and s1 (a bit of each minimum), values (of ROWS minima each), shingles and n (how many)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for sets in shingle_sets(b.column(1), width):
                least = _minima(sets)
                bits = np.packbits((W._mixed(least) & np.uint64(1)).astype(np.uint8), axis=1).view(">i8").astype(np.int64)
                values = np.zeros((len(sets), GROUPS), np.uint64) + np.arange(1, GROUPS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    values = W._mixed(values ^ least[:, r: GROUPS * ROWS: ROWS])
                short = [_shortened(s) for s in sets]
                values = [v if len(s) else v[:0] for v, s in zip(values.view(np.int64), sets, strict=True)]
                fps = np.array([simhash(shingle_hashes(x.as_py(), SHINGLE)) for x in b.column(1).slice(done, len(sets))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(done, len(sets)), pa.array(fps, pa.int64()), pa.array([_set_node(s) for s in sets], pa.int64()), pa.array(bits[:, 0]), pa.array(bits[:, 1]),
                    pa.array(values, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int32())), pa.array([len(s) for s in short], pa.int64()),
                ], names=["doc_id", "fp", "node", "s0", "s1", "values", "shingles", "n"])
                done += len(sets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long, node long, s0 long, s1 long, values array<long>, shingles array<int>, n long")


def _links(far: int):
    """Of one partition of values (value, node, sketch): a forest of the members that share a value and whose sketches differ in at most ``far`` bits."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.asarray(c, np.int64) for c in b.columns] for b in batches]
        value, node, s0, s1 = (np.concatenate([g[i] for g in got] or [np.zeros(0, np.int64)]) for i in range(4))
        order = np.lexsort((node, value))
        value, node, s0, s1 = value[order], node[order], s0[order].view(np.uint64), s1[order].view(np.uint64)
        n = len(value)
        at = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if n else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))
        ids, which = np.unique(node, return_inverse=True)
        forest = _Forest(len(ids))

        def offer(x: np.ndarray, y: np.ndarray) -> None:
            near = np.bitwise_count(s0[x] ^ s0[y]).astype(np.int64) + np.bitwise_count(s1[x] ^ s1[y]) <= far
            forest.add(which[x[near]], which[y[near]])

        head = at[group]
        left = np.flatnonzero(head != np.arange(n))
        offer(head[left], left)
        step = 1
        while len(left):
            if step & (step - 1) == 0:  # values whose members are all joined are done
                label = forest.label[which]
                whole = np.minimum.reduceat(label, at) == np.maximum.reduceat(label, at)
                left = left[~whole[group[left]]]
            left = left[left + step < n]
            left = left[group[left] == group[left + step]]
            offer(left, left + step)
            step += 1
        a, b = (np.array([e[i] for e in forest.edges], np.int64) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return links


def shared(sets: list[np.ndarray], often: int = OFTEN, columns: int = 1 << 12) -> np.ndarray:
    """How many members each pair of sets has in common (above the diagonal).

    A member that few sets hold is counted pair by pair; one that many hold, such as a template's, is a bit of each
    set, and common bits are counted.
    """
    n = len(sets)
    flat, who = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    holders = np.diff(np.append(at, len(flat)))
    out = np.zeros((n, n), np.int32)
    few = np.repeat((holders > 1) & (holders <= often), holders)
    own, member = who[few], np.repeat(np.arange(len(at)), holders)[few]
    pairs = []
    for k in range(1, often):
        near = np.flatnonzero(member[k:] == member[:-k]) if len(member) > k else member[:0]
        if not len(near):
            break
        pairs.append(own[near] * n + own[near + k])
    if pairs:
        which, times = np.unique(np.concatenate(pairs), return_counts=True)
        out.ravel()[which] += times.astype(np.int32)
    many = np.flatnonzero(holders > often)
    for first in range(0, len(many), columns):
        some = many[first: first + columns]
        held = np.zeros((n, -(-len(some) // 64) * 64), bool)
        places = np.repeat(at[some], holders[some]) + np.arange(holders[some].sum()) - np.repeat(np.cumsum(holders[some]) - holders[some], holders[some])
        held[who[places], np.repeat(np.arange(len(some)), holders[some])] = True
        bits = np.packbits(held, axis=1).view(np.uint64)
        step = max(1, (1 << 21) // bits.size)
        for x in range(0, n, step):
            out[x: x + step, x:] += np.bitwise_count(bits[x: x + step, None] & bits[None, x:]).sum(axis=2, dtype=np.int32)
    return out


def alike_forest(sets: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """Edges that join all sets whose likeness (common of all members) is ``share`` or more."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    both = shared(sets)
    linked = np.zeros((n, n), bool)
    for x in range(n):
        linked[x, x + 1:] = both[x, x + 1:] >= share * (sizes[x] + sizes[x + 1:] - both[x, x + 1:]) - 1e-9
    forest = _Forest(n)
    linked |= linked.T
    while True:
        # every set takes one of its links to another tree, so that links of the same trees are not walked one by one
        open_ = linked & (forest.label[:, None] != forest.label)
        x = np.flatnonzero(open_.any(axis=1))
        if not len(x):
            return forest.edges
        forest.add(x, open_[x].argmax(axis=1))


def _judge(share: float):
    """Of some meetings of families' blocks: a forest of the sets that are alike in each."""

    def judge(t: pa.Table) -> pa.Table:
        key = [np.asarray(t[c].combine_chunks(), np.int64) for c in ("root", "i", "j")]
        node = np.asarray(t["node"].combine_chunks(), np.int64)
        order = np.lexsort((node, *key[::-1]))
        same = np.ones(max(len(order) - 1, 0), bool)
        for k in key:
            same &= k[order][1:] == k[order][:-1]
        at = np.append(np.flatnonzero(np.append(True, ~same)), len(order)) if len(order) else np.zeros(1, np.int64)
        a, b = [], []
        for x, y in zip(at[:-1], at[1:], strict=True):
            if y - x > 1:
                rows = order[x:y]
                sets = [np.asarray(t["shingles"][int(r)].values, np.int32) for r in rows]
                edges = np.array(alike_forest(sets, share), np.int64).reshape(-1, 2)
                a.append(node[rows[edges[:, 0]]])
                b.append(node[rows[edges[:, 1]]])
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(a or none)), "b": pa.array(np.concatenate(b or none))})

    return judge


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def families(classes: DataFrame, far: int = FAR) -> DataFrame:
    """(node, root) of the nodes that could be alike: those joined by pairs that share a value and differ in at most ``far`` bits.

    A value with over MEMBERS nodes is split into blocks, and every two of its blocks meet.
    """
    spark = classes.sparkSession
    values = classes.select(F.explode("values").alias("value"), "node", "s0", "s1")
    parts = n_blocks(spark, classes.count() * GROUPS, VALUE_ROWS)
    hot = cut(values.groupBy("value").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MEMBERS), "shingle-hot-values").withColumnRenamed("value", "_v")
    split = values.join(hot, F.col("value") == F.col("_v"), "left").withColumn("_n", F.ceil(F.coalesce("_n", F.lit(1)) / MEMBERS))
    split = split.withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_n"))).select("value", "node", "s0", "s1", "_n", "_i", _every(F.col("_n")).alias("_j"))
    meeting = F.when(F.col("_n") == 1, F.col("value")).otherwise(F.xxhash64("value", F.least("_i", "_j"), F.greatest("_i", "_j")))
    rows = split.select(meeting.alias("value"), "node", "s0", "s1").repartition(parts, "value")
    return components(cut(rows.mapInArrow(_links(far), "a long, b long"), "shingle-candidates"))


def _judged(docs: DataFrame, share: float, width: int, far: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sketches, their classes by node, and edges (a, b) that join all nodes alike to ``share`` or more.

    Sets that share a value and whose sketches differ in at most ``far`` bits make families. Every family's sets come
    together once and are judged exactly, all against all; what a task hands on is a forest of the alike ones. A family over
    FAMILY sets or SHINGLES shingles is split into blocks, and every two of its blocks meet, so no task holds more than two.
    """
    spark = docs.sparkSession
    own = cut(sketches(docs, width).withColumn("_row", F.monotonically_increasing_id()), "shingle-sketches")
    first = own.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("_row").alias("_row"), *[F.first(c).alias(c) for c in ("s0", "s1", "values", "n")])
    classes = cut(first, "shingle-classes")
    member = families(classes, far).withColumnRenamed("node", "_node")
    member = cut(classes.select("node", "_row", "n").join(member, F.col("node") == F.col("_node")).select("node", "_row", "n", "root"), "shingle-families")
    total = member.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / FAMILY), F.ceil(F.sum("n") / SHINGLES), F.lit(1))
    sizes = member.groupBy("root").agg(blocks.alias("_blocks")).withColumnRenamed("root", "_root")
    met = member.join(sizes, F.col("root") == F.col("_root")).withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    met = met.select("_row", "root", "_i", _every(F.col("_blocks")).alias("_j")).select(F.col("_row").alias("_r"), "root", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"))
    bins = n_blocks(spark, total, 4 * SHINGLES)
    # sort and merge at every size: the sets are as large as the texts, and the families grow with them
    sets = own.select("_row", "node", "shingles").hint("merge").join(met.hint("merge"), F.col("_row") == F.col("_r")).select("root", "i", "j", "node", "shingles")
    judged = sets.withColumn("_bin", F.pmod(F.xxhash64("root", "i", "j"), F.lit(bins))).groupBy("_bin").applyInArrow(_judge(share), "a long, b long")
    return own, classes, judged


def alike(docs: DataFrame, share: float = SHARE, width: int = WIDE, far: int = FAR) -> DataFrame:
    """(doc_id, component_id, node, root) of every row: documents whose sets of shingles are alike to ``share`` or more are linked."""
    own, classes, judged = _judged(docs, share, width, far)
    return _grouped(own, classes, components(judged))


def near_copies(docs: DataFrame, share: float = SHARE, width: int = WIDE, far: int = FAR) -> DataFrame:
    """(doc_id, component_id, node, root) of every row: documents are linked by their fingerprints, as in ``near_duplicates``, or as in ``alike``."""
    own, classes, judged = _judged(docs, share, width, far)
    held = cut(own.select("fp", "node").distinct(), "simhash-nodes")
    one = cut(held.groupBy("fp").agg(F.min("node").alias("one")), "simhash-classes")
    same = held.join(one, "fp").filter("node <> one").select(F.col("node").alias("a"), F.col("one").alias("b"))
    ends = [one.select(F.col("fp").alias(c), F.col("one").alias(f"_{c}")) for c in "ab"]
    close = linked(one.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return _grouped(own, classes, components(judged.unionByName(same).unionByName(close)))


def _grouped(own: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, component_id, node, root) of every row of ``own``; nodes without a root are their own."""
    member = classes.select("node", "first_id").join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    member = member.select("node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = member.join(smallest, "root").select(F.col("node").alias("_n"), "component_id", "root")
    return own.join(member, F.col("node") == F.col("_n")).select("doc_id", "component_id", "node", "root")


def first_alike(docs: DataFrame, share: float = SHARE, width: int = WIDE, far: int = FAR) -> DataFrame:
    """The rows of ``docs``, one of each group of ``near_copies``: that with the smallest doc_id, of equal ids the first by text.

    Groups without any doc_id keep their first row by text.
    """

    def nodes(texts: pa.Array) -> np.ndarray:
        return np.array([_set_node(s) for sets in shingle_sets(texts, width) for s in sets], np.int64)

    return _firsts(docs, near_copies(docs, share, width, far), nodes)


def _firsts(docs: DataFrame, grouped: DataFrame, nodes: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The first row of each group; ``nodes`` gives the nodes of texts."""
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    found = cut(grouped.filter(is_first), "simhash-firsts").withColumnRenamed("doc_id", "_id")
    # an id says which row stays only if no other row has it
    ids = grouped.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.max(is_first).alias("_first"))
    rows = cut(ids.filter("_first").select("_id", "_n"), "simhash-first-ids")
    own_id = F.col("doc_id").cast("long")
    plain = docs.join(rows.filter("_n = 1 and _id is not null").select("_id").hint("merge"), own_id == F.col("_id"), "left_semi")
    if rows.filter("_n > 1 or _id is null").isEmpty():
        return plain

    @F.arrow_udf("long")
    def node_of(texts: pa.Array) -> pa.Array:
        return pa.array(nodes(texts))

    # ids that several such rows share: the node tells which group a row belongs to
    shared = docs.join(rows.filter("_n > 1 or _id is null").select("_id"), own_id.eqNullSafe(F.col("_id")), "left_semi")
    shared = shared.select(F.struct("*").alias("_doc"), own_id.alias("_own"), node_of("text").alias("_node"), F.col("text").alias("_text"))
    groups = found.select("_id", F.col("node").alias("_n"), "root").distinct()
    first = F.row_number().over(Window.partitionBy("_own", "root").orderBy("_text", F.xxhash64("_doc")))
    shared = shared.join(groups, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_n"))).withColumn("_first", first).filter("_first = 1").select("_doc.*")
    return plain.unionByName(shared)
