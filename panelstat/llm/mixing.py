"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate (expected copies). Of all rates that give each source its target of tokens,
entropy balancing takes those with the least relative entropy to one copy each, at most ``max_rate``:

    rate = min(max_rate, exp(lambda_source * size / mean size of the source))

The lambdas solve the convex dual: one token constraint per source, found for all sources at once by
Newton steps on sums that Spark makes, with a bracket that catches steps that leave it. The sums
read a histogram (source, size, documents), so a step costs the distinct sizes, not the documents.

Rates become whole copies by systematic rounding: running sums of rates over the sizes of a source, cut
at whole numbers from an offset that leaves its tokens nearest the target. Equal documents share
their copies by the order of a hash. No window ever holds more than the distinct sizes of a source or
``rows_per_window`` documents, so neither a hot source nor a hot size meets in one task.

Defined cases: a null text has no words; a null source is a source of its own and the last;
documents without words get one copy of nothing; an empty table gives an empty result; rows repeated
as a whole are documents of their own; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstat.llm.common import cut, n_words

WEIGHTS = (1, 2, 3)
MAX_RATE = 3
OFFSETS = 16


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) of (source, size) rows.

    Sources by code point, null last, weigh ``weights`` in turn. A target is a share of all sizes by
    weight; it stops at max_rate times the source, and the rest goes to the others by weight until
    none is above. That is one water level: target = min(cap, level * weight), so sources in the order of
    cap / weight are full up to a point, and running sums give the level.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    own = own.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_rate))
    whole, full = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(
        "*",
        F.sum("source_size").over(whole).alias("_all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("_capped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_open"),
    )
    level = (F.col("_all") - F.col("_capped")) / F.col("_open")  # if all before are full
    is_full = level * F.col("weight") >= F.col("cap")
    own = own.withColumn("_level", F.when(~is_full, level)).withColumn("_level", F.max("_level").over(whole))
    # the level is that of the first source that does not fill; later ones take caps off that are not reached, so theirs is lower
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap").cast("double")))
    return own.select("source", "source_size", target.alias("target"))


def _rate(lam: Column, z: Column, max_rate: int) -> Column:
    return F.least(F.lit(float(max_rate)), F.exp(F.least(lam * z, F.lit(50.0))))


def tilt(hist: DataFrame, targets: DataFrame, max_rate: int = MAX_RATE, steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """(source, mean_size, lam, saturated) for a histogram (source, size, n): the dual solved by Newton steps."""
    stats = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    state = stats.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).select(
        "source", "mean_size", "target",
        (F.col("target") >= F.col("source_size") * F.lit(max_rate) * (1 - 1e-12)).alias("saturated"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("miss"),
    )
    state = cut(state.coalesce(1), "tilt")
    # decimals add up to the same whatever the order, so reruns agree to the last bit
    exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    for _ in range(steps):
        h = hist.withColumnRenamed("source", "_s")
        z = F.col("size") / F.col("mean_size")
        rate = _rate(F.col("lam"), z, max_rate)
        words = F.col("n") * F.col("size") * rate
        sums = h.join(state, F.col("_s").eqNullSafe(F.col("source"))).filter(~F.col("saturated")).groupBy("source").agg(
            exact(words).alias("got"), exact(F.when(rate < max_rate, words * z).otherwise(0.0)).alias("slope"))
        sums = sums.withColumnRenamed("source", "_s")
        joined = state.join(sums, F.col("_s").eqNullSafe(F.col("source")), "left")
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        # the logarithm of the sum is nearly linear in lambda; plain steps would overshoot
        step = F.col("lam") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = F.coalesce((step > F.coalesce("_lo", F.lit(-1e300))) & (step < F.coalesce("_hi", F.lit(1e300))), F.lit(False))
        middle = (
            F.when(F.col("_lo").isNull(), F.col("_hi") * 2 - F.greatest(F.abs("_hi"), F.lit(1.0)))
            .when(F.col("_hi").isNull(), F.col("_lo") * 2 + F.greatest(F.abs("_lo"), F.lit(1.0)))
            .otherwise((F.col("_lo") + F.col("_hi")) / 2)
        )
        done = F.col("got").isNull() | (F.col("target") <= 0) | (F.abs(F.col("got") / F.col("target") - 1) <= tolerance)
        joined = joined.select(
            "source", "mean_size", "target", "saturated", "lam", "got", "slope", lo.alias("_lo"), hi.alias("_hi"),
            F.coalesce(F.when(done, F.lit(0.0)).otherwise(F.abs(F.col("got") / F.col("target") - 1)), F.lit(0.0)).alias("miss"),
        )
        state = cut(joined.select(
            "source", "mean_size", "target", "saturated",
            F.when((F.col("miss") == 0.0), F.col("lam")).otherwise(F.when(inside, step).otherwise(middle)).alias("lam"),
            F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "miss",
        ).coalesce(1), "tilt")
        if not state.agg(F.max("miss")).first()[0]:
            break
    else:
        raise RuntimeError(f"the dual was not solved in {steps} steps")
    return state.select("source", "mean_size", "lam", "saturated")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: int = MAX_RATE, rows_per_window: int = 20_000, offsets: int = OFFSETS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    return _mix(docs, [], weights, max_rate, rows_per_window, offsets)


def mix_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` in their columns, each as often as the mix takes it."""
    names = docs.columns
    numbered = cut(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "mix-rows")
    plain = numbered.select("_doc.doc_id", "_doc.source", "_doc.text", "_row")
    taken = _mix(plain, ["_row"], weights, max_rate, 20_000, OFFSETS).filter(F.col("copies") > 0).select(F.col("_row").alias("_r"), "copies")
    out = numbered.join(taken, F.col("_row") == F.col("_r")).select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.select(*[F.col(f"_doc.`{c}`").alias(c) for c in names])


def _mix(docs: DataFrame, more: list[str], weights: Sequence[float], max_rate: int, rows_per_window: int, offsets: int) -> DataFrame:
    slim = cut(docs.select("doc_id", "source", *more, n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_h")), "mix-sizes")
    hist = cut(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    targets = cut(source_targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")), weights, max_rate).coalesce(1), "mix-targets")
    duals = tilt(hist, targets, max_rate)

    # expected copies of each (source, size), summed along the sizes
    rates = hist.withColumnRenamed("source", "_s").join(duals, F.col("_s").eqNullSafe(F.col("source"))).withColumn(
        "rate", F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("saturated"), F.lit(float(max_rate))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean_size"), max_rate)))
    along = Window.partitionBy("source").orderBy(F.col("size").desc())
    rates = rates.select("source", "size", "n", "rate", F.sum(F.col("n") * F.col("rate")).over(along).alias("_to"))
    cells = rates.withColumn("_from", F.coalesce(F.lag("_to").over(along), F.lit(0.0)))

    def copies(offset: Column) -> Column:
        cut_at = lambda c: F.floor(F.round(F.col(c), 6) + offset)
        return F.least(cut_at("_to") - cut_at("_from"), F.col("n") * F.lit(max_rate)).cast("long")

    tries = cells.groupBy("source").agg(*[F.sum(copies(F.lit(k / offsets)) * F.col("size")).alias(f"_t{k}") for k in range(offsets)])
    tries = tries.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source")))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_t{k}") - F.col("target")).alias("d"), F.lit(k / offsets).alias("k")) for k in range(offsets)]))["k"]
    chosen = tries.select(F.col("source").alias("_s"), "source_size", "target", best.alias("_offset"))
    cells = cut(cells.join(chosen, F.col("_s").eqNullSafe(F.col("source"))).select(
        "source", "size", "n", "rate", "source_size", "target", copies(F.col("_offset")).alias("_copies")), "mix-cells")

    # equal sizes: salted by hash into windows of bounded size, each with its share of the copies
    spread = F.pmod(F.xxhash64("_h", "doc_id"), F.ceil(F.col("n") / F.lit(rows_per_window)).cast("long"))
    c = cells.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "rate", "source_size", "target", "_copies")
    rows = slim.join(c, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z").withColumn("_part", spread)
    parts = rows.groupBy("source", "size", "_part").agg(F.count(F.lit(1)).alias("_m"), F.first("n").alias("n"), F.first("_copies").alias("_copies"))
    by_part = Window.partitionBy("source", "size").orderBy("_part")
    parts = parts.withColumn("_end", F.sum("_m").over(by_part))
    share = lambda upto: F.floor(F.col("_copies") * upto / F.col("n"))
    parts = parts.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_part").alias("_p"), "_m", (share(F.col("_end")) - share(F.col("_end") - F.col("_m"))).alias("_k"))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_part") == F.col("_p")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("_h", "doc_id"))
    per = F.floor(F.col("_k") / F.col("_m"))
    n_copies = (per + F.when(rank <= F.col("_k") - per * F.col("_m"), 1).otherwise(0)).cast("long")
    return rows.withColumn("copies", n_copies).select(
        *more, "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
