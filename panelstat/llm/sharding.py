"""Sharding by extendible hashing: a directory of hash prefixes in which only buckets over the limit split.

The key's hash is a string of bits. A shard is the shortest prefix whose rows fit ``limit`` bytes
together, so shards are nodes of a binary tree and only full ones were split. The directory is
made from sums: rows are summed by ``depth`` leading bits, one row of that histogram stands for all its
prefixes, and only prefixes still over the limit are summed again with more bits. Nothing but
(hash, bytes) rows is read more than once, and a level costs sums, never a sort of documents.

Defined cases: the hash has 60 bits of SHA-256 of the key; rows with equal keys differ only in the next 60
bits, made from the whole row and, if even that is equal, from the row's place when the sizes were
written, so a hot key splits as well. A null key is hashed as the empty text. A row that alone is over the limit
gets a shard of its own (``fits`` is false). Rows without bytes go with their prefix. An empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.llm.common import cut

LIMIT = 32 << 20
BITS = 60


def _bits(text: Column) -> Column:
    """The first 60 bits of the SHA-256 as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 2), BITS, "0")


def assign(docs: DataFrame, key: str = "doc_id", payload: str = "text", limit: int = LIMIT, step: int = 6) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, shard (its bits), depth, shard_rows, shard_bytes, fits."""
    rows = docs.select(
        F.col(key).alias(key), F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.xxhash64(key, payload).alias("_c"), F.monotonically_increasing_id().alias("_row"),
    )
    more = _bits(F.concat_ws(":", F.col("_c").cast("string"), F.col("_row").cast("string")))
    rows = cut(rows.select(key, "n_bytes", F.concat(_bits(F.col("_k")), more).alias("_bits")), "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(2 * BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 2)

    found, open_rows, over = [], rows, None
    start = 0
    while True:
        # sums by the longest prefix looked at, then by each shorter one
        fine = open_rows.groupBy(F.substring("_bits", 1, depth).alias("_p")).agg(F.sum("n_bytes").alias("_b"), F.count(F.lit(1)).alias("_n"))
        every = fine.select(F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth"), "_p", "_b", "_n")
        nodes = every.groupBy("depth", F.expr("substring(_p, 1, depth)").alias("shard")).agg(F.sum("_b").alias("shard_bytes"), F.sum("_n").alias("shard_rows"))
        nodes = cut(nodes.withColumn("fits", F.col("shard_bytes") <= limit), "shard-nodes")
        last = depth >= 2 * BITS
        leaf = F.col("fits") | (F.col("shard_rows") == 1) | (F.lit(last) & (F.col("depth") == depth))
        up = nodes.filter(~leaf).select((F.col("depth") + 1).alias("_d"), F.col("shard").alias("_up"))
        # a leaf's parent had to split; the root of this level is known to be over the limit, or is the whole table
        leaves = nodes.filter(leaf)
        below = leaves.join(up, (F.col("depth") == F.col("_d")) & (F.expr("substring(shard, 1, depth - 1)") == F.col("_up")), "left_semi")
        roots = leaves.filter(F.col("depth") == start)
        found.append(below.unionByName(roots))
        over = nodes.filter((F.col("depth") == depth) & ~leaf).select(F.col("shard").alias("_up"))
        if last or over.isEmpty():
            break
        open_rows = open_rows.join(over, F.substring("_bits", 1, depth) == F.col("_up"), "left_semi")
        start, depth = depth + 1, min(2 * BITS, depth + step)
    directory = found[0]
    for more_found in found[1:]:
        directory = directory.unionByName(more_found)
    directory = cut(directory, "shard-directory")
    depths = [r[0] for r in directory.select("depth").distinct().orderBy("depth").collect()]  # at most 121
    if not depths:
        return rows.select(key, "n_bytes").join(directory.select("shard", "depth", "shard_rows", "shard_bytes", "fits"), F.lit(False))
    # a row looks for its shard at the depths that occur, by equality: one of them matches
    looked = rows.select(key, "n_bytes", "_bits", F.explode(F.array(*[F.lit(d) for d in depths])).alias("_d"))
    d = directory.select("shard", "depth", "shard_rows", "shard_bytes", "fits")
    return looked.join(d, (F.col("_d") == F.col("depth")) & (F.expr("substring(_bits, 1, _d)") == F.col("shard"))).select(
        F.col(key), "n_bytes", "shard", "depth", "shard_rows", "shard_bytes", "fits")
