"""Case histories, reviewer votes and review tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.schema import ATTRIBUTES, REVIEW_COLUMNS


def final_version(iterations: DataFrame, rule: str = "last") -> DataFrame:
    """The version that counts per case.

    ``last`` takes the last iteration as it is, ``last_with_data`` the last with content,
    ``last_tagged`` the last tagged one, ``last_if_tagged`` the last but only when it is tagged.
    An ordered-struct maximum picks it, so long histories are never sorted.
    """
    rows = iterations
    if rule == "last_with_data":
        rows = rows.filter("vignette is not null")
    elif rule == "last_tagged":
        rows = rows.filter("tagged")
    elif rule not in ("last", "last_if_tagged"):
        raise ValueError(f"unknown rule {rule!r}")
    rest = [c for c in rows.columns if c not in ("case_id", "pos")]
    out = rows.groupBy("case_id").agg(F.max(F.struct("pos", *rest)).alias("v")).select("case_id", "v.*")
    return out.filter("tagged") if rule == "last_if_tagged" else out


def latest_evaluation(iterations: DataFrame) -> DataFrame:
    """Most recent human evaluation per case."""
    has = iterations.filter("reviewer is not null")
    best = F.max(F.struct("pos", "iteration", "reviewer", "decision", "comments")).alias("v")
    return has.groupBy("case_id").agg(best).select("case_id", "v.*")


def evaluation_history(iterations: DataFrame) -> DataFrame:
    """All human evaluations of a case."""
    return iterations.filter("reviewer is not null").select(
        "case_id", "pos", "iteration", "ts", "reviewer", "decision", "comments"
    )


def export_evaluation(iterations: DataFrame) -> DataFrame:
    """Evaluation of the last tagged version, else the most recent one (W2 with fallback)."""
    cols = ["reviewer", "decision", "comments"]
    final = final_version(iterations, "last_tagged").select("case_id", F.struct(*cols).alias("own"))
    recent = latest_evaluation(iterations).select("case_id", F.struct(*cols).alias("recent"))
    use = F.when(F.col("own.reviewer").isNotNull(), F.col("own")).otherwise(F.col("recent"))
    return final.join(recent, "case_id", "left").select("case_id", use.alias("e")).select("case_id", "e.*")


def reviewer_votes(iterations: DataFrame) -> DataFrame:
    """Last decision of each reviewer per case, on the common scale."""
    name = F.trim("reviewer")
    rows = iterations.filter(F.length(name) > 0).withColumn("reviewer", name)
    last = F.max(F.struct("pos", "iteration", "decision", "comments")).alias("v")
    out = rows.groupBy("case_id", "reviewer").agg(last).select("case_id", "reviewer", "v.*")
    return out.withColumn("decision", S.normalise_review_decision("decision"))


def review_summary(records: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes per case and how divided they are; cases without votes included."""
    d = F.col("decision")
    counts = votes.groupBy("case_id").agg(
        F.count("*").alias("num_evaluations"),
        F.count_if(d == "approve").alias("approve_count"),
        F.count_if(d == "reject").alias("reject_count"),
        F.count_if(d == "skip").alias("skip_count"),
    )
    names = ["num_evaluations", "approve_count", "reject_count", "skip_count"]
    joined = records.join(counts, "case_id", "left").fillna(0, names)
    divided = (F.col("num_evaluations") > 1) & (F.col("approve_count") > 0) & (F.col("reject_count") > 0)
    low = F.least("approve_count", "reject_count")
    return joined.withColumn(
        "controversy", F.when(divided, low / F.nullif(F.col("num_evaluations"), F.lit(0))).otherwise(0.0)
    )


# Case list orders; the id breaks ties because a distributed sort is not stable.
ORDERS = {
    "newest": [("created_at", False)],
    "oldest": [("created_at", True)],
    "most_approved": [("approve_count", False), ("created_at", False)],
    "most_rejected": [("reject_count", False), ("created_at", False)],
    "most_controversial": [("controversy", False), ("num_evaluations", False), ("created_at", False)],
    "most_reviewed": [("num_evaluations", False), ("created_at", False)],
}


def ordered_cases(summary: DataFrame, order: str = "newest") -> DataFrame:
    """Case list in one of the named orders (K1)."""
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in ORDERS[order]]
    return summary.orderBy(*keys, "case_id")


def placed_cases(summary: DataFrame) -> DataFrame:
    """Place of each case in the most-controversial order.

    Cases are counted per (controversy, count, day) first; only those counts are put in one order.
    """
    keys = ["controversy", "num_evaluations", "day"]
    rows = summary.withColumn("day", F.to_date("created_at"))
    before = Window.orderBy(*[F.desc(k) for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    offsets = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys).orderBy(F.desc("created_at"), "case_id")
    placed = rows.withColumn("_rn", F.row_number().over(inside)).join(offsets, keys)
    return placed.withColumn("place", F.col("_off") + F.col("_rn")).drop("_off", "_rn", "day")


def status_priority(status) -> Column:
    """needs_review first, then approved, deprecated, draft, failed, anything else."""
    s = F.lower(F.col(status) if isinstance(status, str) else status)
    out = None
    for i, name in enumerate(["needs_review", "approved", "deprecated", "draft", "failed"], start=1):
        out = F.when(s == name, i) if out is None else out.when(s == name, i)
    return out.otherwise(99)


def by_status_priority(rows: DataFrame, status: str = "status", tie: str = "case_id") -> DataFrame:
    return rows.orderBy(status_priority(status), tie)


def derive_status(r1, r2, r3) -> Column:
    """Status from three reviewers: any reject deprecates, the second or third approves."""
    d = [F.lower(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))) for c in (r1, r2, r3)]
    reject = (d[0] == "reject") | (d[1] == "reject") | (d[2] == "reject")
    approve = (d[1] == "approve") | (d[2] == "approve")
    return F.when(reject, "deprecated").when(approve, "approved").otherwise("needs_review")


def feedback_statistics(comments: DataFrame) -> DataFrame:
    """Comments by decision, evaluator and seed mode (one pass of grouping sets) and by problem axis."""
    c = comments.filter(F.length(F.coalesce("comments", F.lit(""))) > 0)
    grouped = c.groupingSets(
        [[F.col("decision")], [F.col("evaluator")], [F.col("seed_mode")], []], "decision", "evaluator", "seed_mode"
    ).agg(F.count("*").alias("n"), F.grouping_id("decision", "evaluator", "seed_mode").alias("g"))
    named = (
        F.when(F.col("g") == 3, F.struct(F.lit("decision").alias("facet"), F.col("decision").alias("value")))
        .when(F.col("g") == 5, F.struct(F.lit("evaluator").alias("facet"), F.col("evaluator").alias("value")))
        .when(F.col("g") == 6, F.struct(F.lit("seed_mode").alias("facet"), F.col("seed_mode").alias("value")))
        .otherwise(F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")))
    )
    facets = grouped.select(named.alias("f"), "n").select("f.facet", "f.value", "n")
    axes = c.select(F.explode("problem_axes").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return facets.unionByName(axes.select(F.lit("axis").alias("facet"), "value", "n"))


def rubric_metrics(results: DataFrame) -> DataFrame:
    """Passes, rate, failing criteria and joined suggestions per case and rubric.

    A rubric has a handful of criteria, so the collected lists are short by definition.
    """
    ok = F.col("outcome")
    text = F.trim(F.coalesce("suggested_changes", F.lit("")))
    failing = F.sort_array(F.collect_list(F.when(~ok, F.struct("position", "criterion"))))
    notes = F.sort_array(
        F.collect_list(F.when(~ok & (F.length(text) > 0), F.struct("position", F.concat_ws(": ", "criterion", text).alias("t"))))
    )
    out = results.groupBy("case_id", "rubric").agg(
        F.count_if(ok).alias("num_passing"), F.count("*").alias("num_criteria"), failing.alias("f"), notes.alias("s")
    )
    return out.select(
        "case_id",
        "rubric",
        "num_passing",
        "num_criteria",
        F.when(F.col("num_criteria") > 0, F.col("num_passing") / F.col("num_criteria")).otherwise(1.0).alias("pass_rate"),
        (F.col("num_passing") == F.col("num_criteria")).alias("overall_pass"),
        F.array_join(F.transform("f", lambda x: x["criterion"]), ",").alias("failing"),
        F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("suggestions"),
    )


def ordered_iterations(iterations: DataFrame) -> DataFrame:
    """Versions in navigation order (W9). A range sort splits even a single long history."""
    return iterations.orderBy("case_id", "pos")


def newest_file(files: DataFrame) -> DataFrame:
    """Most recently modified file per case."""
    rest = [c for c in files.columns if c != "case_id"]
    order = ["modified"] + [c for c in rest if c != "modified"]
    return files.groupBy("case_id").agg(F.max(F.struct(*order)).alias("v")).select("case_id", "v.*")


def _key(c) -> Column:
    return F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))


def content_changed(old: list[str], new: list[str]) -> Column:
    """Whether any trimmed field differs."""
    return ~F.struct(*[_key(c).alias(f"c{i}") for i, c in enumerate(old)]).eqNullSafe(
        F.struct(*[_key(c).alias(f"c{i}") for i, c in enumerate(new)])
    )


def reviewers_changed(old: list[str], new: list[str], old_comments: str, new_comments: str) -> Column:
    """Whether names or decisions differ, case ignored, or comments differ."""
    names = lambda cs: F.struct(*[F.lower(_key(c)).alias(f"c{i}") for i, c in enumerate(cs)])
    return (names(old) != names(new)) | (_key(old_comments) != _key(new_comments))


def plan_updates(history: DataFrame, incoming: DataFrame, content: list[str], reviewers: list[str], comments: str) -> DataFrame:
    """Per incoming row: next iteration, derived status and whether it has to be appended.

    ``history`` has one row per case with the latest version, ``last_iteration`` (NULL without any)
    and ``status``; both sides share the named columns. A case without a record is skipped.
    """
    shared = content + reviewers + [comments]
    h = history.select("case_id", "last_iteration", F.col("status").alias("old_status"), *[F.col(f"`{c}`").alias(f"old {c}") for c in shared])
    j = incoming.join(h.withColumn("_h", F.lit(True)), "case_id", "left")
    status = derive_status(*reviewers[1::2])
    j = j.withColumn("new_status", status)
    changed = (
        content_changed([f"old {c}" for c in content], content)
        | F.coalesce(F.col("old_status") != F.col("new_status"), F.lit(True))
        | reviewers_changed([f"old {c}" for c in reviewers], reviewers, f"old {comments}", comments)
    )
    action = F.when(F.col("_h").isNull(), "skipped").when(F.col("last_iteration").isNull() | changed, "append").otherwise("unchanged")
    return j.select(
        "case_id",
        (F.coalesce("last_iteration", F.lit(-1)) + 1).alias("next_iteration"),
        "old_status",
        "new_status",
        action.alias("action"),
    )


def import_report(validated: DataFrame, plan: DataFrame) -> DataFrame:
    """Counts of an import: validation outcome per row and what was done with it."""
    v = validated.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("status") == "valid").alias("valid_cases"),
        F.count_if(F.col("status") == "warning").alias("warning_cases"),
        F.count_if(F.col("status") == "error").alias("error_cases"),
    )
    done = plan.agg(
        F.count_if(F.col("action") == "append").alias("imported_cases"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged_cases"),
        F.count_if(F.col("action") == "skipped").alias("no_record"),
    )
    # two one-row aggregates
    both = v.withColumn("k", F.lit(1)).join(done.withColumn("k", F.lit(1)), "k")
    return both.select(
        "total_rows", "valid_cases", "warning_cases", "error_cases", "imported_cases", "unchanged_cases",
        (F.col("error_cases") + F.col("no_record")).alias("skipped_cases"),
    )


def review_row(case: DataFrame) -> DataFrame:
    """The fixed review columns from a flat case with ``c1_<attribute>`` and ``c2_<attribute>`` tags."""
    source = {
        "Case ID": "case_id", "R1": "r1", "R1 Decision?": "r1_decision", "R2": "r2", "R2 Decision?": "r2_decision",
        "R3": "r3", "R3 Decision?": "r3_decision", "Status": "status", "Vignette": "vignette",
        "Choice 1": "choice_1", "Choice 2": "choice_2", "Reviewer Comments": "comments",
    }
    for o in (1, 2):
        for a in ATTRIBUTES:
            source[f"{a.capitalize()} C{o}"] = f"c{o}_{a}"
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) if c in case.columns else F.lit("")
    default = {"Status": "draft", **{f"{a.capitalize()} C{o}": "neutral" for o in (1, 2) for a in ATTRIBUTES}}
    cell = lambda n: F.coalesce(F.nullif(blank(source[n]), F.lit("")), F.lit(default[n])) if n in default else blank(source[n])
    return case.select(*[cell(n).alias(n) for n in REVIEW_COLUMNS])


def numbered_rows(rows: DataFrame, position: str = "pos") -> DataFrame:
    """Review rows with the 1-based number they have below a header line."""
    return rows.withColumn("row_number", F.col(position) + 2)


def window_positions(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """0-based position inside each group."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
