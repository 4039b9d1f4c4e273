"""Connected components of a distributed edge list, without a driver-side union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.llm.common import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it can reach.

    Alternates two steps on the edges until nothing changes: every node hands its larger neighbours,
    then its smaller ones, to the smallest of them. Each step is a minimum by node (summed before
    the shuffle) and an equality join, so a hub's edges are split like any skewed join. Rounds grow with
    the logarithm of the longest path; each is cut by a written table.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = cut(edges, "components")
    size = None
    for _ in range(max_rounds):
        # all neighbours, larger side: link each larger neighbour of n to n's smallest
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "components")
        # smaller side: link n and its smaller neighbours to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.filter("u <> v").distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == size:
            break
        size = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
