"""Case, review-row, rubric and vector checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.schema import ATTRIBUTES, STATUSES, TAGS


def _labels(tags: Column, which: str, tag: str) -> Column:
    return F.transform(F.filter(tags, lambda t: t[which] == tag), lambda t: t["attribute"])


def option_effects(tags: Column) -> list[Column]:
    """(c1_promotes, c1_violates, c2_promotes, c2_violates) of an array of tagged attributes."""
    has = lambda w, v: F.exists(tags, lambda t: t[w] == v)
    return [has("tag_1", "promotes"), has("tag_1", "violates"), has("tag_2", "promotes"), has("tag_2", "violates")]


def same_direction(tags: Column) -> Column:
    """Attributes that both options promote or both violate (V1)."""
    return F.transform(
        F.filter(tags, lambda t: (t["tag_1"] == t["tag_2"]) & (t["tag_1"] != "neutral")), lambda t: t["attribute"]
    )


def engaged(tags: Column) -> Column:
    """How many attributes are not neutral on both options (V2)."""
    return F.size(F.filter(tags, lambda t: (t["tag_1"] != "neutral") | (t["tag_2"] != "neutral")))


def cross_opposition(tags: Column) -> Column:
    """Whether the options pull apart: different promoted sets, different violated sets, or one attribute opposed (V3)."""

    def differ(tag):
        a, b = _labels(tags, "tag_1", tag), _labels(tags, "tag_2", tag)
        return (F.size(a) > 0) & (F.size(b) > 0) & (F.array_sort(a) != F.array_sort(b))

    opposed = F.exists(
        tags, lambda t: (t["tag_1"] != t["tag_2"]) & (t["tag_1"] != "neutral") & (t["tag_2"] != "neutral")
    )
    return differ("promotes") | differ("violates") | opposed


def free_lunch(tags: Column) -> Column:
    """One option only violates while the other promotes something (V4).

    That covers both forbidden shapes, pure upside and mixed against pure downside.
    """
    p1, v1, p2, v2 = option_effects(tags)
    return (v1 & ~p1 & p2) | (v2 & ~p2 & p1)


def failed_rule(tags: Column) -> Column:
    """First failed rule 1..4 of a case's tags, NULL when valid."""
    return (
        F.when(F.size(same_direction(tags)) > 0, 1)
        .when(engaged(tags) < 2, 2)
        .when(~cross_opposition(tags), 3)
        .when(free_lunch(tags), 4)
    )


def rule_message(tags: Column, rule: Column) -> Column:
    first = F.element_at(same_direction(tags), 1)
    p1, v1, _, _ = option_effects(tags)
    worse = F.when(v1 & ~p1, "choice 1").otherwise("choice 2")
    return (
        F.when(rule == 1, F.concat(F.lit("both options carry the same tag for "), first))
        .when(rule == 2, F.concat(F.lit("only "), engaged(tags).cast("string"), F.lit(" attributes engaged, 2 needed")))
        .when(rule == 3, F.lit("no tension between the options"))
        .when(rule == 4, F.concat(worse, F.lit(" has violations only")))
    )


def case_tags(tags: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """One array of tagged attributes per case, in attribute order; one entry per attribute at most."""
    order = F.array_position(F.array(*[F.lit(a) for a in attributes]), F.col("attribute"))
    entry = F.struct(order.alias("i"), "attribute", "tag_1", "tag_2")
    return tags.groupBy("case_id").agg(F.sort_array(F.collect_set(entry)).alias("tags"))


def validate_cases(tags: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """(case_id, valid, failed_rule, message) with the rules applied in order (V5)."""
    return check_tag_arrays(case_tags(tags, attributes)).drop("tags")


def check_tag_arrays(cases: DataFrame, column: str = "tags") -> DataFrame:
    rule = failed_rule(F.col(column))
    out = cases.withColumn("failed_rule", rule)
    return out.withColumn("valid", F.col("failed_rule").isNull()).withColumn(
        "message", rule_message(F.col(column), F.col("failed_rule"))
    )


def validate_review_rows(rows: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Input rows plus ``status``, ``errors`` and the id to report, ``UNKNOWN`` when missing (V6).

    Field errors end the check of a row; only complete rows are held against the case rules.
    """
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    tag = lambda c: F.lower(text(c))
    names = [f"{a.capitalize()} C{o}" for o in (1, 2) for a in attributes]
    problems = [
        F.when(text("Vignette") == "", "Missing vignette"),
        F.when(text("Choice 1") == "", "Missing Choice 1 text"),
        F.when(text("Choice 2") == "", "Missing Choice 2 text"),
    ]
    for n in names:
        problems.append(
            F.when(tag(n) == "", f"Missing value tag: {n}").when(
                ~tag(n).isin(TAGS),
                F.concat(F.lit("Invalid value tag '"), tag(n), F.lit(f"' in {n} (must be promotes/violates/neutral)")),
            )
        )
    field_errors = F.filter(F.array(*problems), lambda e: e.isNotNull())
    tags = F.array(
        *[
            F.struct(F.lit(a).alias("attribute"), tag(f"{a.capitalize()} C1").alias("tag_1"), tag(f"{a.capitalize()} C2").alias("tag_2"))
            for a in attributes
        ]
    )
    out = rows.withColumn("_fields", field_errors).withColumn("_tags", tags)
    out = out.withColumn("_rule", F.when(F.size("_fields") == 0, failed_rule(F.col("_tags"))))
    errors = (
        F.when(text("Case ID") == "", F.array(F.lit("Missing Case ID")))
        .when(F.size("_fields") > 0, F.col("_fields"))
        .when(F.col("_rule").isNotNull(), F.array(rule_message(F.col("_tags"), F.col("_rule"))))
        .otherwise(F.array().cast("array<string>"))
    )
    out = out.withColumn("errors", errors)
    return (
        out.withColumn("status", F.when(F.size("errors") > 0, "error").otherwise("valid"))
        .withColumn("reported_id", F.coalesce(F.nullif(text("Case ID"), F.lit("")), F.lit("UNKNOWN")))
        .drop("_fields", "_tags", "_rule")
    )


def rubric_violations(results: DataFrame) -> DataFrame:
    """Failed criteria without a suggestion, which a rubric must not contain (V7)."""
    return results.filter(~F.col("outcome") & (F.length(F.coalesce("suggested_changes", F.lit(""))) == 0))


def unknown_statuses(records: DataFrame) -> DataFrame:
    """Records whose status is outside the life cycle; reported, not dropped."""
    return records.filter(~F.col("status").isin(STATUSES)).select("case_id", "status")


def embedding_problems(batch: DataFrame, expected: DataFrame, key: str = "case_id") -> DataFrame:
    """Ids whose vector is missing, unasked, repeated, empty or not finite."""
    got = batch.groupBy(key).agg(
        F.count("*").alias("n"),
        F.max(F.col("embedding").isNull() | (F.size("embedding") == 0)).alias("empty"),
        F.max(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"),
    )
    j = expected.select(key, F.lit(True).alias("_e")).join(got, key, "full")
    problem = (
        F.when(F.col("n").isNull(), "missing vector")
        .when(F.col("_e").isNull(), "not asked for")
        .when(F.col("n") > 1, "repeated")
        .when(F.col("empty"), "empty vector")
        .when(F.col("bad"), "not numeric")
    )
    return j.select(key, problem.alias("problem")).filter("problem is not null")


def search_cases(cases: DataFrame, text=None, seed_mode=None, evaluator=None, decision=None) -> DataFrame:
    """Cases that match every given criterion (V13); ``evaluators`` and ``decisions`` are arrays."""
    out = cases
    if text:
        out = out.filter(F.contains(F.lower("text"), F.lit(text.lower())))
    if seed_mode:
        out = out.filter(F.col("seed_mode") == seed_mode)
    if evaluator:
        out = out.filter(F.array_contains("evaluators", evaluator))
    if decision:
        out = out.filter(F.array_contains("decisions", decision))
    return out


def by_status(cases: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Cases of the given statuses, ``needs_review`` by default; an empty list keeps all."""
    wanted = ["needs_review"] if statuses is None else statuses
    return cases.filter(F.col("status").isin(wanted)) if wanted else cases
