"""Preference, agreement, refusal and entropy metrics for all raters at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.plans.gram import pair_moments
from panelstat.schema import ATTRIBUTES, CONSENSUS


def value_preference_per_case(summary: DataFrame, tags: DataFrame) -> DataFrame:
    """Expected alignment per (case, rater, attribute); attributes neutral on both options drop out."""
    engaged = tags.filter((F.col("align_1") != 0) | (F.col("align_2") != 0)).select(
        "case_id", "attribute", "align_1", "align_2"
    )
    answered = summary.filter("valid > 0").select("case_id", "rater", "c1", "c2", "valid")
    value = (F.col("c1") * F.col("align_1") + F.col("c2") * F.col("align_2")) / F.col("valid")
    return answered.join(engaged, "case_id").select("case_id", "rater", "attribute", value.alias("value"))


def value_preference(summary: DataFrame, tags: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Mean expected alignment per rater and attribute (A4).

    Tags are made one row per case first, so each answer is joined once and not once per attribute.
    """
    is_a = lambda a: F.col("attribute") == a
    wide = tags.groupBy("case_id").agg(
        *[F.max(F.when(is_a(a), F.col(f"align_{o}"))).alias(f"a{o}_{i}") for i, a in enumerate(attributes) for o in (1, 2)]
    )
    answered = summary.filter("valid > 0").select("case_id", "rater", "c1", "c2", "valid")
    values, entries = [], []
    for i, a in enumerate(attributes):
        one, two = F.col(f"a1_{i}"), F.col(f"a2_{i}")
        value = F.when((one != 0) | (two != 0), (F.col("c1") * one + F.col("c2") * two) / F.col("valid"))
        values += [F.sum(value).alias(f"s{i}"), F.count(value).alias(f"n{i}")]
        entries.append(F.struct(F.lit(a).alias("attribute"), F.col(f"s{i}").alias("s"), F.col(f"n{i}").alias("n_cases")))
    sums = answered.join(wide, "case_id").groupBy("rater").agg(*values)
    long = sums.select("rater", F.explode(F.array(*entries)).alias("e")).select("rater", "e.*").filter("n_cases > 0")
    return long.select("rater", "attribute", (F.col("s") / F.col("n_cases")).alias("preference"), "n_cases")


def require_rows(df: DataFrame, key: str, wanted: list[str], message: str) -> DataFrame:
    """Add one failing row per wanted key that has no row, so a missing rater fails the job."""
    asked = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{key} string")
    missing = asked.join(df.select(key).distinct(), key, "left_anti")
    fail = missing.select(F.raise_error(F.concat(F.lit(message + ": "), F.col(key))).cast("boolean").alias("_f"))
    guard = fail.agg(F.count("_f")).scalar()
    return df.filter(F.col(key).isin(wanted)).filter(guard >= 0)


def agreement_per_case(summary: DataFrame, a: str, b: str) -> DataFrame:
    """1 or 0 per case on which both raters have a majority."""
    pick = lambda r, c: summary.filter((F.col("rater") == r) & F.col("majority").isNotNull()).select(
        "case_id", F.col("majority").alias(c)
    )
    return pick(a, "ma").join(pick(b, "mb"), "case_id").select(
        "case_id", (F.col("ma") == F.col("mb")).cast("double").alias("value")
    )


def agreement_rate(summary: DataFrame, a: str, b: str) -> DataFrame:
    return agreement_per_case(summary, a, b).agg(
        F.avg("value").alias("agreement"), F.count("*").alias("n_cases")
    )


def agreement_matrix(summary: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """Agreement of every pair of raters over the cases both decided (A5)."""
    vote = F.when(F.col("majority") == "choice_1", 1).when(F.col("majority") == "choice_2", -1)
    m = pair_moments(summary.withColumn("vote", vote), "case_id", "rater", "vote", n_blocks)
    return m.select(
        F.col("item_a").alias("rater_a"),
        F.col("item_b").alias("rater_b"),
        ((F.col("n") + F.col("sxy")) / (2 * F.col("n"))).alias("agreement"),
        F.col("n").alias("n_cases"),
    )


def refusal_rate(summary: DataFrame) -> DataFrame:
    """Mean over cases of the share of refusals; the pooled rater has none by definition."""
    own = summary.filter(F.col("rater") != CONSENSUS)
    total = F.nullif(F.col("valid") + F.col("refusals"), F.lit(0))
    per_case = own.select("case_id", "rater", (F.col("refusals") / total).alias("value"))
    return per_case.groupBy("rater").agg(
        F.avg("value").alias("refusal_rate"), F.count("value").alias("n_cases")
    )


def entropy_per_case(cases: DataFrame, summary: DataFrame, raters: list[str]) -> DataFrame:
    """Entropy of every listed rater on every case; NULL without a valid run."""
    grid = cases.select("case_id", F.explode(F.array(*[F.lit(r) for r in raters])).alias("rater"))
    return grid.join(summary.select("case_id", "rater", "entropy"), ["case_id", "rater"], "left")


def entropy_statistics(entropies: DataFrame) -> DataFrame:
    """Descriptive statistics of per-case entropies per rater."""
    q = F.percentile("entropy", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    stats = entropies.groupBy("rater").agg(
        F.avg("entropy").alias("mean"),
        F.stddev_samp("entropy").alias("std"),
        F.min("entropy").alias("min"),
        F.max("entropy").alias("max"),
        q.alias("q"),
        F.count("entropy").alias("n_cases"),
        F.count("*").alias("n_total"),
    )
    named = [F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p25", "median", "p75", "p90"))]
    return stats.select("rater", "mean", "std", "min", "max", *named, "n_cases", "n_total")


def aggregate_entropy_per_case(entropies: DataFrame, raters: list[str]) -> DataFrame:
    """Mean entropy of the listed raters per case (A10)."""
    if not raters:
        raise ValueError("at least one rater is needed")
    return entropies.filter(F.col("rater").isin(raters)).groupBy("case_id").agg(F.avg("entropy").alias("entropy"))


def kappa_table(summary: DataFrame) -> DataFrame:
    """How many raters' majority is each option, for cases with at least one vote."""
    return (
        summary.groupBy("case_id")
        .agg(
            F.count_if(F.col("majority") == "choice_1").alias("choice_1_count"),
            F.count_if(F.col("majority") == "choice_2").alias("choice_2_count"),
        )
        .filter(F.col("choice_1_count") + F.col("choice_2_count") > 0)
    )


def fleiss_kappa(table: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """Chance-corrected agreement of a count table.

    The statistic is defined for one rater count. With ``strict`` unequal counts fail the job;
    otherwise each row uses its own count and single-vote rows, which have no pairs, drop out.
    """
    n = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    rows = table.withColumn("n", n)
    if strict:
        spread = rows.agg((F.max("n") - F.min("n")).alias("d")).scalar()
        rows = rows.withColumn(
            "n", F.when(spread == 0, F.col("n")).otherwise(F.raise_error(F.lit("unequal rater counts")).cast("bigint"))
        )
    else:
        rows = rows.filter("n > 1")
    squares = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    p_i = (squares - F.col("n")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))
    a = rows.agg(
        F.avg(p_i).alias("p_bar"),
        F.sum("n").alias("total"),
        F.count("*").alias("n_cases"),
        *[F.sum(c).alias(c) for c in columns],
    )
    share = [F.col(c) / F.col("total") for c in columns]
    chance = sum((s * s for s in share[1:]), share[0] * share[0])
    return a.withColumn("p_e", chance).select(
        F.try_divide(F.col("p_bar") - F.col("p_e"), 1 - F.col("p_e")).alias("kappa"), "p_bar", "p_e", "n_cases"
    )


def tension_pairs(tags: DataFrame) -> DataFrame:
    """Attribute pairs x < y whose option differences have opposite signs.

    Both signs of a case are collected (at most one entry per attribute) and paired as arrays, so
    no join is needed.
    """
    names = F.sort_array(F.collect_list(F.when(F.col("delta") != 0, F.struct("attribute", F.signum("delta").alias("s")))))
    per_case = tags.groupBy("case_id").agg(names.alias("v"))
    pairs = F.flatten(
        F.transform(
            "v",
            lambda x: F.transform(
                F.filter("v", lambda y: (x["attribute"] < y["attribute"]) & (x["s"] * y["s"] < 0)),
                lambda y: F.struct(x["attribute"].alias("x"), y["attribute"].alias("y")),
            ),
        )
    )
    return per_case.select("case_id", F.explode(pairs).alias("p")).select("case_id", "p.x", "p.y")


@F.udtf(returnType="x string, y string")
class TensionPairs:
    """Table function: attribute pairs x < y of one case whose differences have opposite signs.

    Takes the attributes and the differences as two arrays; null arrays, null and zero differences give no pair.
    """

    def eval(self, attributes: list, deltas: list):
        signs = sorted((a, d > 0) for a, d in zip(attributes or [], deltas or []) if a is not None and d)
        for i, (x, up) in enumerate(signs):
            for y, other in signs[i + 1 :]:
                if up != other:
                    yield x, y


def tension_pairs_lateral(tags: DataFrame) -> DataFrame:
    """``tension_pairs`` by a lateral call of the table function, for callers that hold a case's differences as arrays."""
    cell = F.struct("attribute", F.col("delta").cast("double").alias("delta"))
    per_case = tags.groupBy("case_id").agg(F.collect_list(cell).alias("v"))  # at most one entry per attribute
    arrays = per_case.select("case_id", F.col("v.attribute").alias("attributes"), F.col("v.delta").alias("deltas"))
    pairs = TensionPairs(F.col("attributes").outer(), F.col("deltas").outer())
    return arrays.lateralJoin(pairs).select("case_id", "x", "y")


def tension_matrix(pairs: DataFrame, attributes: list[str]) -> DataFrame:
    """Symmetric co-occurrence counts as a wide matrix."""
    both = pairs.select("x", "y").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    counts = both.groupBy("x").pivot("y", attributes).count()
    return counts.select(F.col("x").alias("attribute"), *[F.coalesce(a, F.lit(0)).alias(a) for a in attributes])


def tension_incidence(cases: DataFrame, pairs: DataFrame, attributes: list[str]) -> DataFrame:
    """0/1 per case and attribute pair."""
    s = sorted(attributes)
    labels = [f"{x}_{y}" for i, x in enumerate(s) for y in s[i + 1 :]]
    hit = pairs.select("case_id", F.concat_ws("_", "x", "y").alias("pair"))
    flags = hit.groupBy("case_id").agg(*[F.max((F.col("pair") == l).cast("int")).alias(l) for l in labels])
    return cases.select("case_id").join(flags, "case_id", "left").select(
        "case_id", *[F.coalesce(l, F.lit(0)).alias(l) for l in labels]
    )


def panel_pluralism(consensus: DataFrame, threshold: float = 0.70) -> DataFrame:
    """How many cases lack a clear plurality, and the median plurality share."""
    c = consensus.filter("confidence is not null")
    return c.agg(
        F.count_if(F.col("confidence") < threshold).alias("n_below"),
        F.count("*").alias("n_cases"),
        F.percentile("confidence", F.lit(0.5)).alias("median_plurality"),
    )


def near_determinism(summary: DataFrame) -> DataFrame:
    """Share of cases with at least nine of ten equal answers, per rater."""
    s = summary.filter("valid > 0")
    return s.groupBy("rater").agg(
        F.avg((F.greatest("c1", "c2") * 10 >= F.col("valid") * 9).cast("double")).alias("near_deterministic"),
        F.percentile("entropy", F.lit(0.75)).alias("p75"),
        F.count("*").alias("n_cases"),
    )


def determinism_overview(per_rater: DataFrame) -> DataFrame:
    """Raters whose upper quartile entropy is positive, median and p75 of the near-deterministic share."""
    return per_rater.agg(
        F.count_if(F.col("p75") > 0).alias("n_varied"),
        F.count("*").alias("n_raters"),
        F.percentile("near_deterministic", F.lit(0.5)).alias("median_share"),
        F.percentile("near_deterministic", F.lit(0.75)).alias("p75_share"),
    )
