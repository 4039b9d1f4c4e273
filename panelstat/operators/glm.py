"""Value weights: binomial-logit regression of choices on option differences, per rater or draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.functions.irls import fit_batches
from panelstat.functions.tails import chi2_3_p, normal_p
from panelstat.plans.gram import shuffle_partitions
from panelstat.schema import ATTRIBUTES


def _d(attributes):
    return [f"d_{a}" for a in attributes]


def wide_deltas(tags: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """(case_id, d_<attribute>...): one row per case. Fixed pivot values, so no extra job."""
    aggs = [F.max(F.when(F.col("attribute") == a, F.col("delta"))).alias(f"d_{a}") for a in attributes]
    return tags.groupBy("case_id").agg(*aggs)


def design_matrix(summary: DataFrame, tags: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Option differences, share of choice_1 and trials per (case, rater)."""
    answered = summary.filter("valid > 0").select("case_id", "rater", "p1", "c1", F.col("valid").alias("n"))
    return answered.join(wide_deltas(tags, attributes), "case_id").select(
        "case_id", "rater", *_d(attributes), "p1", "c1", "n"
    )


def design_cells(design: DataFrame, keys: list[str], attributes: list[str] = ATTRIBUTES, weight=None) -> DataFrame:
    """Sufficient statistics per key and distinct difference vector.

    At most 5 ** attributes cells per key remain, whatever the number of cases; the sums are formed
    on the map side. The per-case constants of the likelihood are summed along.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    n, s = (w * F.col("n")).cast("double"), (w * F.col("c1")).cast("double")
    y = F.col("c1") / F.col("n")
    inside = (F.col("c1") > 0) & (F.col("c1") < F.col("n"))
    return design.groupBy(*keys, *_d(attributes)).agg(
        F.sum(n).alias("trials"),
        F.sum(s).alias("successes"),
        F.sum(n * y * y).alias("squares"),
        # ln C(1, y) for a fractional y, from the reflection formula of the gamma function
        F.sum(F.when(inside, -n * F.ln(F.lit(3.141592653589793) * y * (1 - y) / F.sin(F.lit(3.141592653589793) * y))).otherwise(0.0)).alias("binomial"),
        F.sum(F.when(inside, n * (y * F.ln(y) + (1 - y) * F.ln(1 - y))).otherwise(0.0)).alias("saturated"),
        F.sum(w).cast("bigint").alias("n_cases"),
    )


def fit_cells(
    cells: DataFrame, keys: list[str], terms: str = "base", attributes: list[str] = ATTRIBUTES,
    ridges: tuple[float, ...] = (), sandwich: bool = False,
) -> DataFrame:
    """One fit per key (A21): status, coefficients, covariance, likelihood pieces and totals."""
    d = [F.col(c).cast("double").alias(c) for c in _d(attributes)]
    totals = ["trials", "successes", "binomial", "saturated"]
    # the fits are the work here, so their number of tasks must not shrink with the bytes
    spread = cells.repartition(shuffle_partitions(cells), *keys)
    packed = spread.groupBy(*keys).agg(
        F.collect_list(F.struct(*d, "trials", "successes", "squares")).alias("cells"),
        *[F.sum(c).alias(c) for c in totals],
        F.sum("n_cases").alias("n_cases"),
    )
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields if f.name in keys)
    out = (
        f"{key_types}, trials double, successes double, binomial double, saturated double, n_cases bigint, "
        "status string, beta array<double>, raw_beta array<double>, inverse array<double>, robust array<double>, "
        "loglik double, penalty double"
    )
    ordered = packed.select(*keys, *totals, "n_cases", "cells")
    return ordered.mapInArrow(fit_batches(terms, list(ridges), len(attributes), sandwich), out)


def value_weights(summary: DataFrame, tags: DataFrame, keys=("rater",), attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Weights per key as one array row each."""
    cells = design_cells(design_matrix(summary, tags, attributes), list(keys), attributes)
    return fit_cells(cells, list(keys), "base", attributes)


def long_weights(fits: DataFrame, keys: list[str], attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """(keys..., attribute, beta, std_error, p_value, status); no errors for fits without variation."""
    k = len(attributes)
    names = F.array(*[F.lit(a) for a in attributes])
    rows = fits.select(*keys, "status", "beta", "robust", F.posexplode(names).alias("i", "attribute"))
    fitted = F.col("status").isin("converged", "not_converged")
    se = F.when(fitted, F.sqrt(F.greatest(F.expr(f"robust[i * {k} + i]"), F.lit(0.0))))
    out = rows.select(*keys, "attribute", F.expr("beta[i]").alias("beta"), se.alias("std_error"), "status")
    return out.withColumn("p_value", normal_p(F.try_divide("beta", "std_error")))


def leverage_errors(design: DataFrame, fits: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """(rater, attribute, beta, std_error, p_value) with leverage-adjusted (HC3) errors.

    Leverage needs the trials of each case, so the cases are joined with their rater's fit and the
    products of the scaled scores are summed on the map side; nothing per case is shuffled twice.
    """
    k = len(attributes)
    f = fits.filter(F.col("status").isin("converged", "not_converged")).select("rater", "beta", "inverse")
    x = [F.col(c).cast("double") for c in _d(attributes)]
    eta = sum((x[i] * F.col("beta")[i] for i in range(1, k)), x[0] * F.col("beta")[0])
    rows = design.join(f, "rater").withColumn("mu", 1 / (1 + F.exp(-eta)))
    quad = sum((x[i] * x[j] * F.col("inverse")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0))
    h = F.col("n") * F.col("mu") * (1 - F.col("mu")) * quad
    rows = rows.withColumn("g", F.col("n") * (F.col("p1") - F.col("mu")) / (1 - h))
    meat = rows.groupBy("rater").agg(
        F.first("inverse").alias("inv"),
        F.first("beta").alias("beta"),
        *[F.sum(x[i] * x[j] * F.col("g") * F.col("g")).alias(f"m{i}{j}") for i in range(k) for j in range(i, k)],
    )
    m = lambda i, j: F.col(f"m{min(i, j)}{max(i, j)}")
    var = [
        sum((F.col("inv")[a * k + i] * m(i, j) * F.col("inv")[j * k + a] for i in range(k) for j in range(k)), F.lit(0.0))
        for a in range(k)
    ]
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col("beta")[i].alias("beta"), F.sqrt(v).alias("std_error")) for i, (a, v) in enumerate(zip(attributes, var))])
    out = meat.select("rater", F.explode(pairs).alias("p")).select("rater", "p.*")
    return out.withColumn("p_value", normal_p(F.try_divide("beta", "std_error")))


def goodness_of_fit(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Log likelihood, deviance and McFadden R2 against the constant-share model."""
    share = F.col("successes") / F.col("trials")
    null = F.col("successes") * F.ln(share) + (F.col("trials") - F.col("successes")) * F.ln(1 - share)
    fitted = F.col("status").isin("converged", "not_converged")
    ll, ll0 = F.col("loglik") + F.col("binomial"), null + F.col("binomial")
    return fits.filter(fitted).select(
        *keys,
        ll.alias("log_likelihood"),
        (2 * (F.col("saturated") - F.col("loglik"))).alias("deviance"),
        F.try_divide(ll0 - ll, ll0).alias("mcfadden_r2"),
        "n_cases",
    )


def lrt_uniform_null(cells: DataFrame, keys: list[str], attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Likelihood-ratio test of equal weights against one weight per attribute."""
    alt = fit_cells(cells, keys, "base", attributes).select(*keys, "binomial", F.col("loglik").alias("alt"))
    null = fit_cells(cells, keys, "sum", attributes).select(*keys, F.col("loglik").alias("null"))
    out = alt.join(null, keys).select(
        *keys,
        F.greatest(2 * (F.col("alt") - F.col("null")), F.lit(0.0)).alias("lrt"),
        (F.col("null") + F.col("binomial")).alias("ll_null"),
        (F.col("alt") + F.col("binomial")).alias("ll_alt"),
        F.lit(len(attributes) - 1).alias("df"),
    )
    return out.withColumn("p_value", chi2_3_p("lrt"))


def interaction_weights(cells: DataFrame, keys: list[str], attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Weights with all pairwise products; fits that do not converge are refitted with a growing penalty."""
    return fit_cells(cells, keys, "interaction", attributes, ridges=(0.01, 0.1, 1.0))


def marginal_weights(full: DataFrame, cells: DataFrame, keys: list[str], attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Weight of each attribute at the mean of the others, as an array."""
    k = len(attributes)
    mean = cells.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(d) * F.col("n_cases")) / F.sum("n_cases") for d in _d(attributes)]).alias("mean_delta")
    )
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    b, m = F.col("beta"), F.col("mean_delta")

    def weight(v):
        terms = [b[k + p] * m[j if i == v else i] for p, (i, j) in enumerate(pairs) if v in (i, j)]
        return sum(terms, b[v])

    return full.join(mean, keys).select(*keys, F.array(*[weight(v) for v in range(k)]).alias("beta"), "penalty", "status")
