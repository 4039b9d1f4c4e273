from pyspark.sql import functions as F

from panelstat.operators.merge import latest_responses
from panelstat.operators.summary import _counts
from panelstat.streaming import responses as ST

SCHEMA = "case_id string, participant_id string, rater string, parsed_choice string, ts timestamp_ntz, event_id bigint"


def batch(spark, lo, hi):
    return spark.range(lo, hi).select(
        F.concat(F.lit("c"), F.col("id") % 5).alias("case_id"), F.concat(F.lit("p"), F.col("id") % 3).alias("participant_id"),
        F.concat(F.lit("human/p"), F.col("id") % 3).alias("rater"),
        F.when(F.col("id") % 2 == 0, "choice_1").otherwise("REFUSAL").alias("parsed_choice"),
        F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7 as int))").alias("ts"), F.col("id").alias("event_id"),
    )


def run(q):
    q.awaitTermination()
    assert q.exception() is None


def test_tally_and_registry_over_several_imports(spark, tmp_path):
    src, log, state = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "state")
    for lo, hi in ((0, 40), (40, 100)):
        batch(spark, lo, hi).coalesce(1).write.mode("append").parquet(src)
        stream = ST.read_events(spark, src, SCHEMA, maxFilesPerTrigger=1)
        run(ST.write_changes(ST.vote_tally(stream), log, state))
        run(ST.write_changes(ST.registry_ranges(stream), log + "-r", state + "-r"))
    want = sorted(map(tuple, batch(spark, 0, 100).groupBy("case_id", "rater").agg(*_counts()).collect()))
    assert sorted(map(tuple, ST.current(spark, log, ["case_id", "rater"]).collect())) == want
    ST.compact(spark, log, log + "-c", ["case_id", "rater"])
    assert sorted(map(tuple, ST.current(spark, log + "-c", ["case_id", "rater"]).collect())) == want
    ranges = {r.participant_id: r.n for r in ST.current(spark, log + "-r", ["participant_id"]).collect()}
    assert ranges == {"p0": 34, "p1": 33, "p2": 33}


def test_replayed_upsert_changes_nothing(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    batch(spark, 0, 60).repartition(3).write.parquet(src)
    for attempt in ("s1", "s2"):  # a fresh checkpoint replays every batch beside the first ones
        run(ST.write_upserts(ST.read_events(spark, src, SCHEMA, maxFilesPerTrigger=1), log, str(tmp_path / attempt)))
    got = sorted((r.case_id, r.participant_id, r.event_id) for r in ST.current_responses(spark, log).collect())
    want = sorted((r.case_id, r.participant_id, r.event_id) for r in latest_responses(batch(spark, 0, 60)).collect())
    assert got == want


def test_duplicates_are_dropped_and_hours_counted(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = batch(spark, 0, 50)
    rows.unionByName(rows).repartition(2).write.parquet(src)
    stream = ST.read_events(spark, src, SCHEMA)
    run(ST.write_rows(ST.deduplicated(stream), str(tmp_path / "out"), str(tmp_path / "s")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    hours = ST.hourly_tally(stream, "rater").select(F.col("window.start").alias("start"), "rater", "n")
    run(ST.write_changes(hours, str(tmp_path / "h"), str(tmp_path / "hs")))
    got = ST.current(spark, str(tmp_path / "h"), ["start", "rater"])
    assert got.agg(F.sum("n")).first()[0] == 100


def test_imports_into_one_log_do_not_erase_each_other(spark, tmp_path):
    log = str(tmp_path / "log")
    first, second = batch(spark, 0, 60), batch(spark, 100, 130).withColumn("ts", F.expr("timestamp_ntz'2020-01-01 00:00:00'"))
    for n, rows in enumerate((first, second)):  # the corrected rows are older by time
        rows.repartition(3).write.parquet(str(tmp_path / f"in{n}"))
        run(ST.write_upserts(ST.read_events(spark, str(tmp_path / f"in{n}"), SCHEMA, maxFilesPerTrigger=1), log, str(tmp_path / f"s{n}"), n))
    got = {(r.case_id, r.participant_id): r.event_id for r in ST.current_responses(spark, log).collect()}
    want = {(r.case_id, r.participant_id): r.event_id for r in latest_responses(first).collect()}
    want |= {(r.case_id, r.participant_id): r.event_id for r in latest_responses(second).collect()}
    assert got == want


def test_late_files_are_not_lost(spark, tmp_path):
    src = str(tmp_path / "in")
    for lo, hi in ((400, 500), (0, 100), (200, 300), (0, 100)):  # out of order, one twice
        day = batch(spark, lo, hi).withColumn("ts", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(cast(event_id as int))"))
        day.coalesce(1).write.mode("append").parquet(src)
    stream = ST.read_events(spark, src, SCHEMA, maxFilesPerTrigger=1)
    run(ST.write_rows(ST.deduplicated(stream), str(tmp_path / "out"), str(tmp_path / "s")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
    hours = ST.hourly_tally(stream, "rater").select(F.col("window.start").alias("start"), "rater", "n")
    run(ST.write_changes(hours, str(tmp_path / "h"), str(tmp_path / "hs")))
    assert ST.current(spark, str(tmp_path / "h"), ["start", "rater"]).agg(F.sum("n")).first()[0] == 400
