"""Dense positions 0..n-1 without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_position(ids: DataFrame, key: str, bucket: Column | None = None) -> DataFrame:
    """(key, pos, n): position of each distinct key and the number of keys.

    Keys are split into buckets, numbered inside each bucket and shifted by the size of the buckets
    before. Without ``bucket`` the order is that of the MD5 of the key with its first three hex
    digits as bucket: at most 4096 equally likely buckets whatever the keys look like. With an
    order-preserving ``bucket`` the order is that of the keys.
    """
    if bucket is None:
        digest = F.md5(F.col(key).cast("string"))
        base = ids.select(key).distinct().select(
            key, digest.alias("_ord"), F.substring(digest, 1, 3).alias("_bucket")
        )
    else:
        base = ids.select(key).distinct().select(key, F.col(key).alias("_ord"), bucket.alias("_bucket"))
    sizes = base.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"),
        F.sum("_size").over(Window.partitionBy(F.lit(1))).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_ord", key))
    return (
        base.withColumn("_rn", inside)
        .join(offsets, "_bucket")
        .select(key, (F.col("_off") + F.col("_rn") - 1).alias("pos"), "n")
    )


# keys that are looked at to bound the ranges, and how many of them a range has
_LOOK, _PER_RANGE = 1024, 16


def ordered_position(ids: DataFrame, key: str) -> DataFrame:
    """(key, pos, n) in key order, whatever the keys look like.

    The keys are split into about 64 ranges of near-equal size, bounded by keys of a fixed-size sample (those
    with the smallest hashes). The bounds decide only how even the ranges are, not the positions.
    """
    sample = ids.select(key).dropna().distinct().orderBy(F.xxhash64(key)).limit(_LOOK)
    bounds = sorted(r[0] for r in sample.collect())[::_PER_RANGE]
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    return dense_position(ids, key, bucket)


def case_positions(cases: DataFrame) -> DataFrame:
    """Positions in case_id order."""
    return ordered_position(cases, "case_id")
