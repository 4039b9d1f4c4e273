"""Upserts, set operations and joins between decision sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_responses(responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One response per (participant, case): the newest wins, ties by event id.

    An ordered-struct maximum pre-aggregates on the map side, so a participant who holds a large
    share of the rows never becomes one sorted window partition.
    """
    keys = keys or ["case_id", "participant_id"]
    rest = [c for c in responses.columns if c not in keys]
    order = ["ts", "event_id"] + [c for c in rest if c not in ("ts", "event_id")]
    return (
        responses.groupBy(*keys)
        .agg(F.max(F.struct(*order)).alias("v"))
        .select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])
    )


def upsert_responses(stored: DataFrame, incoming: DataFrame, batch: int) -> DataFrame:
    """Stored responses after an import; importing the same rows twice changes nothing."""
    cols = stored.columns
    both = stored.withColumn("_batch", F.lit(0)).unionByName(
        latest_responses(incoming).select(*cols).withColumn("_batch", F.lit(batch))
    )
    rest = [c for c in cols if c not in ("case_id", "participant_id")]
    return (
        both.groupBy("case_id", "participant_id")
        .agg(F.max(F.struct("_batch", *rest)).alias("v"))
        .select(*[F.col(c) if c in ("case_id", "participant_id") else F.col(f"v.{c}").alias(c) for c in cols])
    )


def merge_cases(primary: DataFrame, secondary: DataFrame, columns: list[str]) -> DataFrame:
    """Full outer merge by case; the primary side's text wins."""
    p = primary.select("case_id", F.struct(*columns).alias("p"))
    s = secondary.select("case_id", F.struct(*columns).alias("s"))
    return p.join(s, "case_id", "full").select(
        "case_id",
        *[F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in columns],
        F.when(F.col("p").isNull(), "secondary").when(F.col("s").isNull(), "primary").otherwise("both").alias("origin"),
    )


def overlapping_raters(model_cells: DataFrame, human_cells: DataFrame) -> DataFrame:
    """(case, rater) pairs that occur on both sides; a merge is only valid when this is empty."""
    keys = ["case_id", "rater"]
    return model_cells.select(*keys).distinct().join(human_cells.select(*keys).distinct(), keys, "left_semi")


def merge_runs(model_runs: DataFrame, human_runs: DataFrame) -> DataFrame:
    """Union of both fact tables; a rater on both sides of one case is an error raised by the job."""
    keys = ["case_id", "rater"]
    seen = (
        model_runs.select(*keys, F.lit(1).alias("side"))
        .unionByName(human_runs.select(*keys, F.lit(2).alias("side")))
        .groupBy(*keys)
        .agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    )
    n_bad = seen.filter("lo <> hi").agg(F.count("*")).scalar()
    return (
        model_runs.unionByName(human_runs)
        .withColumn("_bad", n_bad)
        .withColumn(
            "case_id",
            F.when(F.col("_bad") == 0, F.col("case_id")).otherwise(
                F.raise_error(F.lit("a rater occurs on both sides of a case"))
            ),
        )
        .drop("_bad")
    )


def lookup_cases(wanted: DataFrame, first: DataFrame, then: DataFrame, columns: list[str]) -> DataFrame:
    """Cases from the first source that has them, else from the second."""
    a = first.select("case_id", F.struct(*columns).alias("a"))
    b = then.select("case_id", F.struct(*columns).alias("b"))
    found = wanted.join(a, "case_id", "left").join(b, "case_id", "left")
    pick = [
        F.when(F.col("a").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns
    ]
    origin = F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second")
    return found.select("case_id", *pick, origin.alias("origin"))


def sync_plan(local: DataFrame, sheet: DataFrame | None, exportable: str = "exportable") -> DataFrame:
    """What a two-way sync has to do per case: push, pull, sheet_only or skipped."""
    mine = local.select("case_id", F.col(exportable).alias("_exp"), F.lit(True).alias("_l"))
    if sheet is None:
        joined = mine.withColumn("_s", F.lit(None).cast("boolean"))
    else:
        theirs = sheet.select("case_id").distinct().withColumn("_s", F.lit(True))
        joined = mine.join(theirs, "case_id", "full")
    action = (
        F.when(F.col("_l").isNull(), "sheet_only")
        .when(F.col("_s").isNotNull(), "pull")
        .when(F.col("_exp"), "push")
        .otherwise("skipped")
    )
    return joined.select("case_id", action.alias("action"))


def sync_summary(local: DataFrame, sheet: DataFrame) -> DataFrame:
    """Counts of both sides and of the three overlaps."""
    m = local.select("case_id").distinct().withColumn("l", F.lit(1))
    s = sheet.select("case_id").distinct().withColumn("s", F.lit(1))
    return m.join(s, "case_id", "full").agg(
        F.count("l").alias("local_count"),
        F.count("s").alias("sheet_count"),
        F.count_if(F.expr("s is null")).alias("local_only"),
        F.count_if(F.expr("l is not null and s is not null")).alias("in_both"),
        F.count_if(F.expr("l is null")).alias("sheet_only"),
    )


def append_new(rows: DataFrame, existing: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def rows_by_id(rows: DataFrame, ids: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows of the asked ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def pending_work(cases: DataFrame, summary: DataFrame, raters: list[str], runs_per_rater: int) -> DataFrame:
    """Runs still to be made, so that an interrupted collection can resume."""
    wanted = cases.select("case_id", F.explode(F.array(*[F.lit(r) for r in raters])).alias("rater"))
    have = summary.select("case_id", "rater", "runs_completed")
    left = wanted.join(have, ["case_id", "rater"], "left").withColumn(
        "done", F.coalesce("runs_completed", F.lit(0))
    )
    todo = left.filter(F.col("done") < runs_per_rater)
    return todo.select(
        "case_id",
        "rater",
        F.explode(F.sequence(F.col("done"), F.lit(runs_per_rater - 1).cast("bigint"))).alias("run"),
    )


def prune_plan(stored: DataFrame, cases: DataFrame, active: list[str]) -> DataFrame:
    """Stored embeddings to drop, with the reason."""
    known = cases.select("case_id", "status")
    reason = F.when(F.col("_k").isNull(), "deleted").when(
        ~F.col("status").isin(active), F.concat(F.lit("status:"), "status")
    )
    return (
        stored.select("case_id")
        .join(known.withColumn("_k", F.lit(True)), "case_id", "left")
        .select("case_id", reason.alias("reason"))
        .filter("reason is not null")
    )


def response_facts(responses: DataFrame, cases: DataFrame, participants: DataFrame) -> DataFrame:
    """Responses whose case and participant both exist."""
    return responses.join(cases, "case_id").join(participants, "participant_id")


def common_cases(cells: DataFrame, raters: list[str]) -> DataFrame:
    """Cases on which every one of the raters has a value (U4)."""
    return (
        cells.filter(F.col("rater").isin(raters))
        .groupBy("case_id")
        .agg(F.count_distinct("rater").alias("k"))
        .filter(F.col("k") == len(set(raters)))
        .select("case_id")
    )


def ordered_union(first: DataFrame, second: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys of two lists in order of first appearance."""
    both = first.select(key, F.struct(F.lit(0).alias("src"), F.col(position).alias("pos")).alias("at")).unionByName(
        second.select(key, F.struct(F.lit(1).alias("src"), F.col(position).alias("pos")).alias("at"))
    )
    return both.groupBy(key).agg(F.min("at").alias("at")).select(key, "at.src", "at.pos")


def select_cases(records: DataFrame, mode: str = "approved", ids: list[str] | None = None) -> DataFrame:
    """Case ids to work on: approved with a tagged final version, all, or an explicit list (V9)."""
    if mode == "approved":
        return records.filter((F.col("status") == "approved") & F.col("final_tagged")).select("case_id")
    if mode == "all":
        return records.select("case_id")
    if mode == "explicit":
        if not ids:
            raise ValueError("explicit selection needs at least one id")
        return records.filter(F.col("case_id").isin(ids)).select("case_id")
    raise ValueError(f"unknown selection mode {mode!r}")


def lookup_errors(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """Per asked id why it cannot be used: missing, duplicate, wrong status or no tagged final version."""
    have = records.groupBy("case_id").agg(
        F.count("*").alias("n"), F.max("status").alias("status"), F.max("final_tagged").alias("final_tagged")
    )
    problem = (
        F.when(F.col("n").isNull(), "not found")
        .when(F.col("n") > 1, "duplicate")
        .when(F.col("status") != "approved", F.concat(F.lit("status "), "status"))
        .when(~F.col("final_tagged"), "no final version")
    )
    return wanted.join(have, "case_id", "left").select("case_id", problem.alias("problem")).filter("problem is not null")


def with_humans(summary: DataFrame) -> DataFrame:
    """Rows of cases that at least one person has answered."""
    human = summary.filter(F.col("rater").startswith("human/")).select("case_id").distinct()
    return summary.join(human, "case_id", "left_semi")


def prompt_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """set, ok or mismatch per case; a mismatching case must be skipped."""
    j = stored.select("case_id", F.col("prompt").alias("old")).join(
        current.select("case_id", F.col("prompt").alias("new")), "case_id"
    )
    state = F.when(F.col("old").isNull(), "set").when(F.col("old") == F.col("new"), "ok").otherwise("mismatch")
    return j.select("case_id", state.alias("state"))
