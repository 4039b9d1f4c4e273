import json

import pytest
from pyspark.sql import functions as F

from panelstat.operators import review as RV
from panelstat.sources import decisions as D
from panelstat.sources import stores as ST


def option(text, **tags):
    return {"choice": text, "autonomy": "neutral", "beneficence": "neutral", "nonmaleficence": "neutral", "justice": "neutral"} | tags


def document(cid, models):
    run = lambda c, i: {"full_response": {"choices": [{"message": {"content": f"{c} {i}"}}], "usage": {"cost": 0.5}}, "parsed_choice": c}
    return {
        "case_id": cid, "system_prompt": "s", "user_prompt": None,
        "case": {"vignette": f"v {cid} é", "choice_1": option("a", autonomy="promotes"), "choice_2": option("b", justice="violates")},
        "models": {m: {"temperature": 0.7, "runs": [run(c, i) for i, c in enumerate(cs)]} for m, cs in models.items()},
    }


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "decisions"
    d.mkdir()
    for doc in (document("c1", {"m": ["choice_1", "choice_2", "REFUSAL"], "human/participant_00000001": ["choice_1"]}), document("c2", {"m": ["choice_2"], "n": []})):
        (d / f"{doc['case_id']}.json").write_text(json.dumps(doc, indent=2))
    return d


def test_read_and_round_trip(spark, folder, tmp_path):
    one = D.read_decisions(spark, str(folder), with_payload=True)
    assert one.runs.count() == 5 and one.cases.count() == 2 and one.tags.count() == 8
    assert {r.delta for r in one.tags.filter("attribute = 'justice'").collect()} == {1}
    assert one.rater_config.count() == 4
    key = lambda d: sorted((r.case_id, r.rater, r.run, r.parsed_choice, r.j) for r in d.runs.withColumn("j", F.to_json("full_response")).collect())
    for n in (1, 3):
        path = str(tmp_path / f"out{n}")
        D.write_decisions(one, path, documents_per_case=n)
        two = D.read_decisions(spark, path, with_payload=True, lines=True)
        rows = [(c, r, ch, j) for c, r, _, ch, j in key(two)]
        assert sorted(rows) == sorted((c, r, ch, j) for c, r, _, ch, j in key(one))
        assert two.cases.count() == 2 and two.tags.count() == 8
        if n == 1:
            assert key(two) == key(one)


def test_slim_read_needs_no_payload(spark, folder):
    assert D.read_decisions(spark, str(folder)).runs.columns == ["case_id", "rater", "run", "parsed_choice"]


@pytest.mark.parametrize("text", ["{not json", '{"case_id": "x"}', "{}"])
def test_bad_document_names_its_file(spark, folder, text):
    (folder / "broken.json").write_text(text)
    with pytest.raises(Exception, match="broken.json"):
        D.read_decisions(spark, str(folder)).runs.collect()


def test_registry_beside_human_documents(spark, folder, tmp_path):
    reg = {"participant_00000001": {"name": "Ann", "email": "a@x.org", "first_seen": "2026-01-01T10:00:00.5", "last_seen": "2026-01-02T10:00:00"}}
    path = folder / D.REGISTRY_FILE
    path.write_text(json.dumps(reg, indent=1))
    assert D.read_human_decisions(spark, str(folder)).runs.count() == 5
    people = ST.read_registry(spark, str(path))
    r = people.first()
    assert r.expertise == "" and str(r.first_seen) == "2026-01-01 10:00:00.500000"
    ST.write_registry(people, str(tmp_path / "reg"))
    assert ST.read_registry(spark, str(tmp_path / "reg"), rows=True).collect() == people.collect()
    missing = ST.read_registry(spark, str(tmp_path / "none.json"))
    assert missing.count() == 0 and missing.columns == people.columns


def test_case_records(spark, tmp_path):
    crit = {"clear": {"outcome": False, "suggested_changes": "say more"}, "short": {"outcome": True, "suggested_changes": None}}
    rec = {
        "case_id": "c1", "created_at": "2026-01-01", "status": "completed", "seed": {"mode": "literature", "parameters": {"value_1": "a"}},
        "refinement_history": [
            {"iteration": 0, "data": {"vignette": "v0", "choice_1": "one", "choice_2": "two"}, "clinical_evaluation": crit, "human_evaluation": None},
            {"iteration": 1, "data": {"vignette": "v1", "choice_1": option("uno"), "choice_2": option("dos")},
             "human_evaluation": {"reviewers": {"r2": {"name": "Bo", "decision": "Approve"}}, "comments": "fine"}},
        ],
    }
    (tmp_path / "case_c1_x.json").write_text(json.dumps(rec))
    (tmp_path / "case_bad_x.json").write_text("{oops")
    records = ST.read_case_records(spark, str(tmp_path))
    assert [r.file_name for r in ST.newest_first(records).collect()] == ["case_c1_x.json"]
    it = ST.record_iterations(records).orderBy("pos").collect()
    assert [(r.choice_1, r.tagged) for r in it] == [("one", False), ("uno", True)]
    assert it[1].r2_decision == "Approve" and it[1].comments == "fine" and it[0].r2 is None and it[1].c1_autonomy == "neutral"
    m = RV.rubric_metrics(ST.record_rubrics(records)).first()
    assert (m.rubric, m.num_passing, m.failing, m.suggestions) == ("clinical", 1, "clear", "clear: say more")


def test_embedding_store(spark, tmp_path):
    doc = {"metadata": {"model": "m", "total_embeddings": 2, "last_updated": "t"}, "embeddings": {"a": {"embedding": [1, 2.5], "created_at": "x"}, "b": [0.5, 0.25]}}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    e = ST.read_embeddings(spark, str(tmp_path / "e.json"))
    assert {r.case_id: (list(r.embedding), r.created_at) for r in e.collect()} == {"a": ([1, 2.5], "x"), "b": ([0.5, 0.25], None)}
    assert ST.embedding_metadata(spark, str(tmp_path / "e.json")).first().total_embeddings == 2
    ST.write_embeddings(e, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_evaluations(spark, tmp_path):
    for who in ("ann", "bo"):
        d = tmp_path / "ev" / who
        d.mkdir(parents=True)
        (d / "case_1.json").write_text(json.dumps({"case_id": "c", "evaluator": who, "decision": "approve", "problem_axes": ["x"], "comments": ""}, indent=1))
    (tmp_path / "s.json").write_text(json.dumps({"username": "ann", "reviewed_case_ids": ["c"]}))
    assert {r.evaluator for r in ST.read_evaluations(spark, str(tmp_path / "ev")).collect()} == {"ann", "bo"}
    assert ST.read_sessions(spark, str(tmp_path / "s.json")).first().reviewed_case_ids == ["c"]


def test_registry_object_in_parts(spark, tmp_path):
    """The files together are the one JSON document; lines are entries whatever the texts hold; nobody is lost."""
    said = [(f"participant_{i:08x}", f'n{i} "q", {{x}}\nline' if i % 2 else None, f"e{i}@x.org", "", "2024-01-02 03:04:05.000006", None) for i in range(50)]
    rows = spark.createDataFrame(said, "participant_id string, name string, email string, expertise string, first_seen string, last_seen string")
    people = rows.withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz")).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))
    key = lambda df: sorted(map(tuple, df.collect()))
    for n, some in ((50, people.repartition(6)), (1, people.limit(1)), (0, people.limit(0))):
        path = tmp_path / f"r{n}"
        ST.write_registry_parts(some, str(path))
        parts = sorted(p for p in path.rglob("part-*"))
        whole = json.loads("".join(p.read_text() for p in parts))
        assert len(whole) == n and key(ST.read_registry(spark, str(path), entry_lines=True)) == key(some)
        (tmp_path / f"one{n}.json").write_text(json.dumps(whole))
        assert key(ST.read_registry(spark, str(tmp_path / f"one{n}.json"))) == key(some)
    assert len(list((tmp_path / "r50" / "1-entries").glob("part-*"))) > 1
    bad = tmp_path / "bad.json"
    bad.write_text('{"a": {"name": "x"}\n,"b": {"name"\n}')
    with pytest.raises(Exception, match="(?i)malformed"):
        ST.read_registry(spark, str(bad), entry_lines=True).collect()


def test_registry_object_in_one_file(spark, tmp_path):
    people = spark.createDataFrame([("p1", "Ann", "a@x.org", "", None, None)], "participant_id string, name string, email string, expertise string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    file = tmp_path / "registry.json"
    ST.write_registry_object(people, str(file))
    assert list(json.loads(file.read_text())) == ["p1"] and ST.read_registry(spark, str(file)).collect() == people.collect()


def test_summaries_keep_the_sessions_partitions(spark, tmp_path):
    """Native keys have few bytes, by which adaptive execution joins partitions; the ids that follow have ten times as many."""
    from panelstat.sources import tables

    spark.range(300).selectExpr("id % 30 l_partkey", "int(id % 7 + 1) l_linenumber", "'O' l_linestatus", "'A' l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    s = tables.model_summary(spark, str(tmp_path))
    assert s.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert s.agg({"runs_completed": "sum"}).first()[0] == 300
