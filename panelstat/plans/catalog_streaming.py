"""Streaming queries: the whole event table as a stream, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.plans.oracle import with_ctes
from panelstat.plans.registry import query
from panelstat.session import shared_folder
from panelstat.sources import tables as T
from panelstat.streaming import responses as ST


def _events(spark, folder):
    schema = T.table(spark, folder, "events").schema
    return ST.read_events(spark, f"{folder}/event[s].parquet", schema)


def _responses(spark, folder):
    """The response stream; the number of cases is fixed when the stream starts."""
    n = T.table(spark, folder, "part").count()
    e = _events(spark, folder).withColumn("case_key", F.col("event_id") % n)
    person = F.col("user_id").cast("string")
    pid = S.participant_id(F.concat(F.lit("User "), person), F.concat(F.lit("u"), person, F.lit("@example.org")))
    choice = F.when(F.col("event_type").isin("click", "purchase"), "choice_1").when(
        F.col("event_type").isin("view", "signup"), "choice_2").otherwise("REFUSAL")
    return e.select(T.uuid_of("case_key").alias("case_id"), pid.alias("participant_id"), choice.alias("parsed_choice"), "ts", "event_id")


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("t1_live_tally", with_ctes("responses") + """SELECT case_id, 'human/' || participant_id AS rater, count(*) FILTER (parsed_choice='choice_1') AS c1,
  count(*) FILTER (parsed_choice='choice_2') AS c2, count(*) FILTER (parsed_choice='REFUSAL') AS refusals, count(*) AS runs_completed FROM responses GROUP BY ALL""")
def t1(spark, folder):
    base = shared_folder(spark, "tally")
    r = _responses(spark, folder).withColumn("rater", F.concat(F.lit("human/"), "participant_id"))
    _finish(ST.write_changes(ST.vote_tally(r), f"{base}/log", f"{base}/state"))
    return ST.current(spark, f"{base}/log", ["case_id", "rater"])


@query("t2_response_upsert", with_ctes("latest") + "SELECT case_id, participant_id, parsed_choice, event_id FROM latest")
def t2(spark, folder):
    """The stream is imported twice into one log, from checkpoints of its own; the second time changes nothing."""
    base = shared_folder(spark, "upsert")
    for n in (1, 2):
        _finish(ST.write_upserts(_responses(spark, folder), f"{base}/log", f"{base}/state-{n}", n))
    return ST.current_responses(spark, f"{base}/log").select("case_id", "participant_id", "parsed_choice", "event_id")


@query("t3_live_registry", with_ctes("responses") + """SELECT participant_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n FROM responses GROUP BY ALL""")
def t3(spark, folder):
    base = shared_folder(spark, "registry")
    _finish(ST.write_changes(ST.registry_ranges(_responses(spark, folder)), f"{base}/log", f"{base}/state"))
    out = ST.current(spark, f"{base}/log", ["participant_id"])
    text = lambda c: F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("participant_id", text("first_seen"), text("last_seen"), "n")


@query("t4_deduplicated_events", "SELECT event_id, user_id, event_type FROM events")
def t4(spark, folder):
    """Every event arrives twice."""
    base = shared_folder(spark, "dedupe")
    e = _events(spark, folder)
    _finish(ST.write_rows(ST.deduplicated(e.union(e)), f"{base}/rows", f"{base}/state"))
    return spark.read.parquet(f"{base}/rows").select("event_id", "user_id", "event_type")


@query("t5_hourly_tally", """SELECT strftime(date_trunc('hour', ts),'%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def t5(spark, folder):
    base = shared_folder(spark, "hourly")
    tally = ST.hourly_tally(_events(spark, folder), "event_type").select(F.col("window.start").alias("start"), "event_type", "n")
    _finish(ST.write_changes(tally, f"{base}/log", f"{base}/state"))
    out = ST.current(spark, f"{base}/log", ["start", "event_type"])
    return out.select(F.date_format(F.col("start").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
