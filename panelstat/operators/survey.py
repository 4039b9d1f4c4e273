"""Survey import: wide rows to responses, participants and warnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.plans.reuse import materialise


def unpivot_responses(rows: DataFrame, ids: list[str], case_columns: list[str]) -> DataFrame:
    """(ids..., case_id, response_text), blanks left out."""
    long = rows.unpivot(ids, case_columns, "case_id", "response_text")
    return long.withColumn("response_text", F.trim("response_text")).filter(F.length("response_text") > 0)


@dataclass
class Survey:
    """Frames of a parsed survey; nothing is computed until one of them is used."""

    responses: DataFrame
    unmatched: DataFrame
    participants: DataFrame
    warnings: DataFrame
    errors: DataFrame


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def people(rows: DataFrame, as_of) -> DataFrame:
    """Rows with the person, their id and the time; unusable rows keep a ``problem``."""
    given = _text("email")
    r = rows.withColumn("name", _text("name")).withColumn("given_email", given)
    r = r.withColumn("email", F.replace(given, F.lit(" "), F.lit("")))
    has = (F.length("name") > 0) & (F.length("email") > 0)
    ts = S.parse_timestamp("recorded")
    problem = F.when(~has, F.when((F.length("name") > 0) | (F.length("email") > 0), "incomplete").otherwise("blank")).when(
        ~S.valid_email("email"), "email"
    )
    return (
        r.withColumn("problem", problem)
        .withColumn("expertise", _text("expertise"))
        .withColumn("recorded", _text("recorded"))
        .withColumn("parsed", ts)
        .withColumn("ts", F.coalesce(ts, F.lit(as_of).cast("timestamp_ntz")))
        .withColumn("participant_id", S.participant_id("name", "email"))
    )


def parse_survey(rows: DataFrame, case_columns: list[str], cases: DataFrame, as_of, file_warnings: list[str] = ()) -> Survey:
    """Parse wide rows (row, name, email, expertise, recorded, one column per case).

    ``cases`` has case_id, choice_1 and choice_2. ``as_of`` replaces unreadable times, so that a
    rerun gives the same result. Nothing is written here; see ``check_strict``.
    """
    p = people(rows, as_of)
    good = p.filter("problem is null")
    long = unpivot_responses(good, ["row", "participant_id", "ts"], case_columns)
    known = long.join(cases.select("case_id", "choice_1", "choice_2", F.lit(True).alias("_known")), "case_id", "left")
    known = known.withColumn("selected_choice", S.match_choice("response_text", "choice_1", "choice_2"))
    matched = known.filter("selected_choice is not null")
    missed = known.filter("selected_choice is null")
    responses = matched.select("case_id", "participant_id", "selected_choice", "response_text", "ts", "row")
    unmatched = missed.select("case_id", "participant_id", "response_text")
    participants = merge_participants(
        good.select("participant_id", "name", F.lower("email").alias("email"), "expertise", "ts", F.col("row").alias("seq"))
    )

    where = F.concat(F.lit("Row "), F.col("row").cast("string"))
    who = F.concat(where, F.lit(", Participant "), F.col("name"))
    n_blank = sum((F.when(F.length(_text(c)) == 0, 1).otherwise(0) for c in case_columns), F.lit(0))
    first_blank = F.coalesce(*[F.when(F.length(_text(c)) == 0, F.lit(c)) for c in case_columns]) if case_columns else F.lit(None)
    usable = F.col("problem").isNull()
    timed = usable | (F.col("problem") == "email")
    note = lambda when, kind, *text: F.when(when, F.struct(F.lit(kind).alias("kind"), F.concat(*text).alias("warning")))
    row_notes = F.array(
        note((F.col("given_email") != F.col("email")) & (F.length("given_email") > 0), "email_spaces", where, F.lit(": spaces taken out of e-mail '"), "given_email", F.lit("'")),
        note(F.col("problem") == "incomplete", "no_person", where, F.lit(": name or e-mail is missing, row left out")),
        note(timed & (F.length("recorded") == 0), "timestamp", who, F.lit(": no time given, import time taken")),
        note(timed & (F.length("recorded") > 0) & F.col("parsed").isNull(), "timestamp", who, F.lit(": unreadable time '"), "recorded", F.lit("', import time taken")),
        note(F.col("problem") == "email", "bad_email", who, F.lit(": '"), "email", F.lit("' is no e-mail address")),
        note(usable & (n_blank > 0) & (n_blank < len(case_columns)), "blank", who, F.lit(": no answer to "), n_blank.cast("string"), F.lit(" case(s), first "), first_blank),
    )
    from_rows = p.select("row", F.explode(F.filter(row_notes, lambda x: x.isNotNull())).alias("n")).select("row", "n.*")
    case = F.concat(where, F.lit(", Case "), F.col("case_id"))
    lost = F.col("_known").isNull()
    from_cells = missed.select(
        "row", F.when(lost, "no_case").otherwise("no_choice").alias("kind"),
        F.when(lost, F.concat(case, F.lit(": unknown case"))).otherwise(F.concat(case, F.lit(", Participant "), "participant_id", F.lit(": answer is neither choice"))).alias("warning"),
    )
    warnings = from_rows.unionByName(from_cells)
    if file_warnings:
        notes = rows.sparkSession.createDataFrame([(0, "no_column", w) for w in file_warnings], "row bigint, kind string, warning string")
        warnings = notes.unionByName(warnings.withColumn("row", F.col("row").cast("bigint")))
    errors = p.filter("problem = 'email'").select("row", F.concat(where, F.lit(": unusable participant")).alias("error")).unionByName(
        from_cells.select("row", F.col("warning").alias("error"))
    )
    return Survey(responses, unmatched, participants, warnings, errors)


def check_strict(survey: Survey) -> None:
    """Raise before anything is written when the survey has errors.

    All of them are in the table that the error names; none reaches the driver.
    """
    errors = materialise(survey.errors, "survey-errors")
    n = errors.count()
    if n:
        raise ValueError(f"failed to parse {n} response(s); see {errors.inputFiles()[0].rsplit('/', 1)[0]}")


def merge_participants(seen: DataFrame) -> DataFrame:
    """One row per participant: time range, first name and e-mail, first non-empty expertise.

    Input has participant_id, name, email, expertise, ts and an order column ``seq``; every part is
    a minimum or maximum and combines on the map side.
    """
    topic = F.nullif("expertise", F.lit(""))
    agg = seen.groupBy("participant_id").agg(
        F.min(F.struct("seq", "name", "email")).alias("f"),
        F.min(F.when(topic.isNotNull(), F.struct("seq", "expertise"))).alias("x"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    return agg.select(
        "participant_id", "f.name", "f.email", F.coalesce("x.expertise", F.lit("")).alias("expertise"), "first_seen", "last_seen"
    )


def upsert_registry(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry after an import: stored people keep name and e-mail, ranges widen, empty expertise fills."""
    cols = ["participant_id", "name", "email", "expertise", "first_seen", "last_seen"]
    both = stored.select(*cols, F.lit(0).alias("src")).unionByName(incoming.select(*cols, F.lit(1).alias("src")))
    agg = both.groupBy("participant_id").agg(
        F.min(F.struct("src", "name", "email")).alias("f"),
        F.min(F.when(F.length("expertise") > 0, F.struct("src", "expertise"))).alias("x"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return agg.select(
        "participant_id", "f.name", "f.email", F.coalesce("x.expertise", F.lit("")).alias("expertise"), "first_seen", "last_seen"
    )


# The label that a kind of warning is reported under.
WARNING_LABELS = {
    "bad_email": "Invalid email formats",
    "blank": "Empty responses",
    "email_spaces": "Emails with spaces",
    "no_case": "Missing case files",
    "no_choice": "Unmatched responses",
    "no_column": "Missing columns",
    "no_person": "Missing participant data",
    "timestamp": "Timestamp parsing issues",
}


def warning_histogram(warnings: DataFrame, top: int | None = 5) -> DataFrame:
    """Most frequent kinds of warning."""
    labels = F.create_map(*[F.lit(x) for pair in WARNING_LABELS.items() for x in pair])
    out = warnings.groupBy("kind").agg(F.count("*").alias("n")).select(labels[F.col("kind")].alias("kind"), "n").orderBy(F.desc("n"), "kind")
    return out.limit(top) if top else out


def import_statistics(responses: DataFrame, cases: DataFrame, participants: DataFrame, registry: DataFrame) -> DataFrame:
    """Cases updated, responses saved and participants added by an import."""
    from panelstat.operators.merge import response_facts

    facts = response_facts(responses, cases.select("case_id"), participants.select("participant_id"))
    saved = facts.agg(F.count_distinct("case_id").alias("cases_updated"), F.count("*").alias("responses_saved"))
    added = participants.join(registry.select("participant_id"), "participant_id", "left_anti").agg(F.count("*")).scalar()
    return saved.withColumn("participants_added", added)
