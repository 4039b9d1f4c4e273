"""Ranks and correlations from value histograms, so no rater's rows are ever sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstat.functions.tails import correlation_p
from panelstat.plans.gram import pair_moments

# Values closer than this are ties; entropies of k/n and (n-k)/n differ in the last bit.
TIE_DIGITS = 12


def average_rank(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(by..., value, n, rank): average rank of each distinct value.

    Equal values are counted before anything is ordered, so the window only sees distinct values.
    """
    count = F.sum(weight) if weight else F.count("*")
    hist = df.groupBy(*by, value).agg(count.alias("n"))
    upto = Window.partitionBy(*(by or [F.lit(1)])).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("rank", F.sum("n").over(upto) - (F.col("n") - 1) / 2.0)


def _pearson(n, sx, sy, sxx, syy, sxy):
    """Correlation from moments; NULL when either side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-9) & (vy > 1e-9), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def spearman(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y", min_n: int = 3) -> DataFrame:
    """(by..., rho, n, p): rank correlation per group of pairs."""
    p = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.round(x, TIE_DIGITS).alias("x"), F.round(y, TIE_DIGITS).alias("y")
    )
    joint = p.groupBy(*by, "x", "y").agg(F.count("*").alias("w"))
    rx = average_rank(joint, by, "x", "w").select(*by, "x", F.col("rank").alias("rx"))
    ry = average_rank(joint, by, "y", "w").select(*by, "y", F.col("rank").alias("ry"))
    ranked = joint.join(rx, by + ["x"]).join(ry, by + ["y"])
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    m = ranked.groupBy(*by).agg(
        F.sum("w").alias("n"),
        F.sum(w * a).alias("sx"),
        F.sum(w * b).alias("sy"),
        F.sum(w * a * a).alias("sxx"),
        F.sum(w * b * b).alias("syy"),
        F.sum(w * a * b).alias("sxy"),
    )
    rho = _pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    out = m.filter(F.col("n") >= min_n).select(*by, rho.alias("rho"), "n")
    return out.withColumn("p", correlation_p("rho", F.col("n").cast("double")))


def entropy_pairs(summary: DataFrame, reference: str) -> DataFrame:
    """(rater, case_id, x, y): reference and rater entropy on shared cases."""
    ref = summary.filter((F.col("rater") == reference) & F.col("entropy").isNotNull())
    ref = ref.select("case_id", F.col("entropy").alias("x"))
    own = summary.filter((F.col("rater") != reference) & F.col("entropy").isNotNull())
    return own.select("case_id", "rater", F.col("entropy").alias("y")).join(ref, "case_id")


def entropy_correlation_matrix(summary: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """Pearson correlation of every pair of raters' entropies over shared cases."""
    m = pair_moments(summary, "case_id", "rater", "entropy", n_blocks)
    r = _pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return m.select(F.col("item_a").alias("rater_a"), F.col("item_b").alias("rater_b"), r.alias("r"), "n")


def rho_overview(rhos: DataFrame) -> DataFrame:
    return rhos.agg(
        F.avg("rho").alias("mean_rho"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"),
        F.count("rho").alias("n_raters"),
    )


def mean_entropy_pairs(pairs: DataFrame, common: DataFrame) -> DataFrame:
    """Mean rater entropy against the reference on the cases all raters share."""
    return (
        pairs.join(common, "case_id", "left_semi")
        .groupBy("case_id")
        .agg(F.first("x").alias("x"), F.avg("y").alias("y"))
    )


def linear_trend(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Least-squares line of y on x."""
    return pairs.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n")
    )


def mann_whitney(values: DataFrame, by: list[str], group: str, first: str, value: str) -> DataFrame:
    """U of the first group against the rest per ``by``, with its p.

    The p is exact without ties if one side has at most 8 values, else the tie-corrected normal one.
    """
    from panelstat.functions.tails import mann_whitney_p

    v = values.select(*by, (F.col(group) == first).cast("int").alias("g"), F.col(value).alias("v"))
    ranks = average_rank(v, by, "v")
    cells = v.groupBy(*by, "v").agg(F.sum("g").alias("n1"), F.count("*").alias("t"))
    s = (
        cells.join(ranks.select(*by, "v", "rank"), by + ["v"])
        .groupBy(*by)
        .agg(
            F.sum(F.col("n1") * F.col("rank")).alias("r1"),
            F.sum("n1").cast("double").alias("n1"),
            F.sum("t").cast("double").alias("n"),
            F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"),
        )
    )
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0)))
    # continuity correction of one half
    z = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / F.sqrt(F.nullif(var, F.lit(0.0)))
    out = s.select(*by, u.alias("u"), z.alias("z"), n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), "ties")
    return out.withColumn("p", mann_whitney_p("u", "n1", "n2", "ties", "z")).drop("ties")
