"""Validation, case history, review table and sync queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.operators import merge as J
from panelstat.operators import review as RV
from panelstat.operators import validate as V
from panelstat.plans.catalog_metrics import R, r9, rounded
from panelstat.plans.oracle import CTES, u32, uuid_sql, with_ctes
from panelstat.plans.positions import dense_position
from panelstat.plans.registry import query
from panelstat.schema import ATTRIBUTES, REVIEW_COLUMNS, STATUSES, TAGS
from panelstat.sources import seeds as SD
from panelstat.sources import tables as T

A = ATTRIBUTES
CAP = [f"{a.capitalize()} C{o}" for o in (1, 2) for a in A]


def _hex(i: int) -> str:
    return f"substr(md5('row|' || d.doc_id),{i},1)"


def _rtag(i: int) -> str:
    return (f"CASE WHEN {_hex(i)}<'5' THEN 'promotes' WHEN {_hex(i)}<'a' THEN ' Violates' WHEN {_hex(i)}<'f' THEN 'neutral' "
            f"WHEN {_hex(i + 8)}<'8' THEN '' ELSE 'both' END")


CTES["review"] = ([], f"""SELECT CASE WHEN {_hex(31)}<'f' THEN {uuid_sql('d.doc_id', 'doc')} ELSE '' END AS "Case ID",
  CASE WHEN quality IS NOT NULL THEN 'ada' ELSE '' END AS "R1", CASE WHEN quality=1 THEN 'Approve' ELSE '' END AS "R1 Decision?",
  CASE WHEN toxic IS NOT NULL THEN 'ben' ELSE '' END AS "R2", CASE WHEN toxic=1 THEN 'Reject' WHEN toxic=0 THEN 'approve' ELSE '' END AS "R2 Decision?",
  '' AS "R3", '' AS "R3 Decision?", CASE WHEN toxic=1 THEN 'deprecated' WHEN toxic=0 THEN 'approved' ELSE 'needs_review' END AS "Status",
  text AS "Vignette", 'Keep ' || source AS "Choice 1", CASE WHEN {_hex(32)}<'f' THEN 'Drop ' || source ELSE '' END AS "Choice 2",
  """ + ", ".join(f"{_rtag(4 * o + i - 3)} AS \"{a.capitalize()} C{o}\"" for o in (1, 2) for i, a in enumerate(A)) +
  """, lang AS "Reviewer Comments" FROM documents d LEFT JOIN labels USING (doc_id)""")
CTES["records"] = ([], f"""SELECT {uuid_sql('o_orderkey', 'record')} AS case_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'needs_review' ELSE 'completed' END AS status,
  CASE WHEN o_orderpriority<'3' THEN 'literature' ELSE 'synthetic' END AS seed_mode,
  nullif(o_orderpriority,'4-NOT SPECIFIED') AS value_a, o_orderstatus AS value_b FROM orders""")
CTES["iters"] = ([], f"""SELECT {uuid_sql('l_orderkey', 'record')} AS case_id, l_linenumber AS pos, l_linenumber-1 AS iteration, ts,
  CASE WHEN flag<>'N' THEN 'About part ' || part END AS vignette, CASE WHEN flag<>'N' THEN 'Take it' END AS choice_1,
  CASE WHEN flag<>'N' THEN 'Leave it' END AS choice_2, flag<>'N' AND state='O' AS tagged,
  CASE WHEN supplier%3<>0 THEN 'reviewer ' || (supplier//10) END AS reviewer,
  CASE WHEN supplier%3<>0 THEN CASE WHEN flag='A' THEN 'Approved ' WHEN flag='R' THEN 'no' WHEN state='O' THEN '' ELSE 'later' END END AS decision,
  CASE WHEN supplier%3<>0 AND state='F' THEN 'see ' || part END AS comments
  FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS part, max(l_suppkey) AS supplier, max(l_returnflag) AS flag,
        max(l_linestatus) AS state, max(l_shipdate) AS ts FROM lineitem GROUP BY ALL)""")
_NORM = """CASE WHEN lower(trim(decision)) IN ('approve','approved','yes','accept') THEN 'approve' WHEN lower(trim(decision)) IN ('reject','rejected','no') THEN 'reject'
  WHEN lower(trim(decision)) IN ('skip','skipped','n/a','') THEN 'skip' ELSE 'unknown' END"""
CTES["votes"] = (["iters"], f"""SELECT case_id, reviewer, iteration, {_NORM} AS decision, comments FROM
  (SELECT *, row_number() OVER (PARTITION BY case_id, reviewer ORDER BY pos DESC) AS rn FROM iters WHERE reviewer IS NOT NULL) WHERE rn=1""")

# rule pieces over a table with one row per case and list columns p1, v1, p2, v2, bad, opp, eng
CTES["effects"] = (["tags"], """SELECT case_id, bool_or(tag_1='promotes') AS c1_promotes, bool_or(tag_1='violates') AS c1_violates,
  bool_or(tag_2='promotes') AS c2_promotes, bool_or(tag_2='violates') AS c2_violates,
  coalesce(list(attribute ORDER BY attribute) FILTER (tag_1='promotes'),[]) AS p1, coalesce(list(attribute ORDER BY attribute) FILTER (tag_2='promotes'),[]) AS p2,
  coalesce(list(attribute ORDER BY attribute) FILTER (tag_1='violates'),[]) AS v1, coalesce(list(attribute ORDER BY attribute) FILTER (tag_2='violates'),[]) AS v2,
  min(list_position(['autonomy','beneficence','nonmaleficence','justice'], attribute)) FILTER (tag_1=tag_2 AND tag_1<>'neutral') AS bad,
  count(*) FILTER (tag_1<>'neutral' OR tag_2<>'neutral') AS eng, bool_or(align_1*align_2=-1) AS opp FROM tags GROUP BY case_id""")
CTES["ruled"] = (["effects"], """SELECT *, (len(p1)>0 AND len(p2)>0 AND p1<>p2) OR (len(v1)>0 AND len(v2)>0 AND v1<>v2) OR opp AS cross_opposed,
  (c1_violates AND NOT c1_promotes AND c2_promotes) OR (c2_violates AND NOT c2_promotes AND c1_promotes) AS lunch,
  CASE WHEN bad IS NOT NULL THEN 1 WHEN eng<2 THEN 2
   WHEN NOT ((len(p1)>0 AND len(p2)>0 AND p1<>p2) OR (len(v1)>0 AND len(v2)>0 AND v1<>v2) OR opp) THEN 3
   WHEN (c1_violates AND NOT c1_promotes AND c2_promotes) OR (c2_violates AND NOT c2_promotes AND c1_promotes) THEN 4 END AS failed_rule FROM effects""")


# -- rules ------------------------------------------------------------------------------------

@query("p1_p2_alignments", with_ctes("tags") + "SELECT case_id, attribute, tag_1, tag_2, align_1, align_2, delta FROM tags")
def p1(spark, folder):
    return T.tags(spark, folder)


@query("p18_option_effects", with_ctes("effects") + """SELECT case_id, c1_promotes, c1_violates, c2_promotes, c2_violates,
  CASE WHEN c1_promotes AND c1_violates THEN 'mixed' WHEN c1_promotes THEN 'upside' WHEN c1_violates THEN 'downside' ELSE 'none' END AS class_1,
  CASE WHEN c2_promotes AND c2_violates THEN 'mixed' WHEN c2_promotes THEN 'upside' WHEN c2_violates THEN 'downside' ELSE 'none' END AS class_2 FROM effects""")
def p18(spark, folder):
    names = ["c1_promotes", "c1_violates", "c2_promotes", "c2_violates"]
    e = V.case_tags(T.tags(spark, folder)).select(
        "case_id", *[c.alias(n) for c, n in zip(V.option_effects(F.col("tags")), names)])
    return e.withColumn("class_1", S.option_class(*names[:2])).withColumn("class_2", S.option_class(*names[2:]))


@query("v1_to_v4_rules", with_ctes("ruled") + "SELECT case_id, bad IS NOT NULL AS same_direction, eng::int AS engaged, cross_opposed, lunch FROM ruled")
def v1(spark, folder):
    t = F.col("tags")
    return V.case_tags(T.tags(spark, folder)).select(
        "case_id", (F.size(V.same_direction(t)) > 0).alias("same_direction"), V.engaged(t).alias("engaged"),
        V.cross_opposition(t).alias("cross_opposed"), V.free_lunch(t).alias("lunch"))


@query("v5_validate_cases", with_ctes("ruled") + """SELECT case_id, failed_rule, failed_rule IS NULL AS valid, CASE failed_rule
  WHEN 1 THEN 'both options carry the same tag for ' || ['autonomy','beneficence','nonmaleficence','justice'][bad]
  WHEN 2 THEN 'only ' || eng || ' attributes engaged, 2 needed' WHEN 3 THEN 'no tension between the options'
  WHEN 4 THEN CASE WHEN c1_violates AND NOT c1_promotes THEN 'choice 1' ELSE 'choice 2' END || ' has violations only' END AS message FROM ruled""")
def v5(spark, folder):
    return V.validate_cases(T.tags(spark, folder))


def _q(c: str) -> str:
    return f'trim("{c}")'


_FIELD = "list_filter([" + ", ".join(
    [f"CASE WHEN {_q('Vignette')}='' THEN 'Missing vignette' END", f"CASE WHEN {_q('Choice 1')}='' THEN 'Missing Choice 1 text' END",
     f"CASE WHEN {_q('Choice 2')}='' THEN 'Missing Choice 2 text' END"] +
    [f"CASE WHEN {_q(n)}='' THEN 'Missing value tag: {n}' WHEN lower({_q(n)}) NOT IN ('promotes','violates','neutral') THEN "
     f"'Invalid value tag ''' || lower({_q(n)}) || ''' in {n} (must be promotes/violates/neutral)' END" for n in CAP]) + "], lambda e: e IS NOT NULL)"


@query("v6_review_field_errors", with_ctes("review", extra=f"e AS (SELECT *, {_FIELD} AS f FROM review)") + """SELECT
  CASE WHEN trim("Case ID")='' THEN 'UNKNOWN' ELSE trim("Case ID") END AS reported_id, "Vignette" AS vignette,
  CASE WHEN trim("Case ID")='' THEN 'Missing Case ID' ELSE array_to_string(f,'; ') END AS errors FROM e WHERE trim("Case ID")='' OR len(f)>0""")
def v6(spark, folder):
    v = V.validate_review_rows(T.review_rows(spark, folder)).filter("status = 'error'")
    text = F.array_join("errors", "; ")
    field = text.startswith("Missing") | text.startswith("Invalid")
    return v.filter(field).select("reported_id", F.col("Vignette").alias("vignette"), text.alias("errors"))


def _wide_rule() -> str:
    has = lambda o, v: "(" + " OR ".join(f"lower({_q(f'{a.capitalize()} C{o}')})='{v}'" for a in A) + ")"
    same = "(" + " OR ".join(f"(lower({_q(f'{a.capitalize()} C1')})=lower({_q(f'{a.capitalize()} C2')}) AND lower({_q(f'{a.capitalize()} C1')})<>'neutral')" for a in A) + ")"
    opp = "(" + " OR ".join(f"(lower({_q(f'{a.capitalize()} C1')})<>lower({_q(f'{a.capitalize()} C2')}) AND lower({_q(f'{a.capitalize()} C1')})<>'neutral' AND lower({_q(f'{a.capitalize()} C2')})<>'neutral')" for a in A) + ")"
    eng = "(" + "+".join(f"(lower({_q(f'{a.capitalize()} C1')})<>'neutral' OR lower({_q(f'{a.capitalize()} C2')})<>'neutral')::int" for a in A) + ")"
    lst = lambda o, v: "list_filter([" + ", ".join(f"CASE WHEN lower({_q(f'{a.capitalize()} C{o}')})='{v}' THEN '{a}' END" for a in A) + "], lambda e: e IS NOT NULL)"
    dif = lambda v: f"(len({lst(1, v)})>0 AND len({lst(2, v)})>0 AND {lst(1, v)}<>{lst(2, v)})"
    lunch = f"(({has(1,'violates')} AND NOT {has(1,'promotes')} AND {has(2,'promotes')}) OR ({has(2,'violates')} AND NOT {has(2,'promotes')} AND {has(1,'promotes')}))"
    return f"CASE WHEN {same} THEN 1 WHEN {eng}<2 THEN 2 WHEN NOT ({dif('promotes')} OR {dif('violates')} OR {opp}) THEN 3 WHEN {lunch} THEN 4 END"


@query("v6_review_validation", with_ctes("review", extra=f"e AS (SELECT *, {_FIELD} AS f, {_wide_rule()} AS rule FROM review)") + """SELECT
  CASE WHEN trim("Case ID")='' THEN 'UNKNOWN' ELSE trim("Case ID") END AS reported_id, "Vignette" AS vignette,
  CASE WHEN trim("Case ID")='' OR len(f)>0 OR rule IS NOT NULL THEN 'error' ELSE 'valid' END AS status,
  CASE WHEN trim("Case ID")='' THEN 1 WHEN len(f)>0 THEN len(f) WHEN rule IS NOT NULL THEN 1 ELSE 0 END::int AS n_errors FROM e""")
def v6_status(spark, folder):
    return V.validate_review_rows(T.review_rows(spark, folder)).select(
        "reported_id", F.col("Vignette").alias("vignette"), "status", F.size("errors").alias("n_errors"))


# -- histories --------------------------------------------------------------------------------

def _final_sql(where: str, post: str = "") -> str:
    return with_ctes("iters") + f"""SELECT case_id, pos, iteration, vignette, tagged FROM
      (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS rn FROM iters WHERE {where}) WHERE rn=1 {post}"""


_VERSION = ["case_id", "pos", "iteration", "vignette", "tagged"]


@query("w1_final_last", _final_sql("true"))
def w1(spark, folder):
    return RV.final_version(T.iterations(spark, folder), "last").select(*_VERSION)


@query("w1_final_last_if_tagged", _final_sql("true", "AND tagged"))
def w1_if(spark, folder):
    return RV.final_version(T.iterations(spark, folder), "last_if_tagged").select(*_VERSION)


@query("w1_final_last_tagged", _final_sql("tagged"))
def w1_tagged(spark, folder):
    return RV.final_version(T.iterations(spark, folder), "last_tagged").select(*_VERSION)


@query("w1_final_last_with_data", _final_sql("vignette IS NOT NULL"))
def w1_data(spark, folder):
    return RV.final_version(T.iterations(spark, folder), "last_with_data").select(*_VERSION)


@query("w2_latest_evaluation", with_ctes("iters") + """SELECT case_id, pos, iteration, reviewer, decision, comments FROM (SELECT *,
  row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS rn FROM iters WHERE reviewer IS NOT NULL) WHERE rn=1""")
def w2(spark, folder):
    return RV.latest_evaluation(T.iterations(spark, folder))


@query("w2_evaluation_history", with_ctes("iters") + "SELECT case_id, pos, iteration, reviewer, decision, comments FROM iters WHERE reviewer IS NOT NULL")
def w2_history(spark, folder):
    return RV.evaluation_history(T.iterations(spark, folder)).drop("ts")


@query("w2_export_evaluation", with_ctes("iters", extra="""f AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS rn FROM iters WHERE tagged),
  r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS rn FROM iters WHERE reviewer IS NOT NULL)""") + """SELECT f.case_id,
  CASE WHEN f.reviewer IS NOT NULL THEN f.reviewer ELSE r.reviewer END AS reviewer, CASE WHEN f.reviewer IS NOT NULL THEN f.decision ELSE r.decision END AS decision,
  CASE WHEN f.reviewer IS NOT NULL THEN f.comments ELSE r.comments END AS comments FROM f LEFT JOIN r ON r.case_id=f.case_id AND r.rn=1 WHERE f.rn=1""")
def w2_export(spark, folder):
    return RV.export_evaluation(T.iterations(spark, folder))


@query("w5_reviewer_votes", with_ctes("votes") + "SELECT case_id, reviewer, iteration, decision, comments FROM votes")
def w5(spark, folder):
    return RV.reviewer_votes(T.iterations(spark, folder)).drop("pos")


@query("w9_ordered_iterations", with_ctes("iters") + "SELECT case_id, pos, iteration, tagged FROM iters ORDER BY case_id, pos")
def w9(spark, folder):
    return RV.ordered_iterations(T.iterations(spark, folder)).select("case_id", "pos", "iteration", "tagged")


_SUM = """rs AS (SELECT r.*, coalesce(n,0) AS num_evaluations, coalesce(a,0) AS approve_count, coalesce(j,0) AS reject_count, coalesce(k,0) AS skip_count,
  CASE WHEN n>1 AND a>0 AND j>0 THEN least(a,j)::double/n ELSE 0.0 END AS controversy FROM records r LEFT JOIN (SELECT case_id, count(*) AS n,
  count(*) FILTER (decision='approve') AS a, count(*) FILTER (decision='reject') AS j, count(*) FILTER (decision='skip') AS k FROM votes GROUP BY case_id) v USING (case_id))"""


def _summary(spark, folder):
    return RV.review_summary(T.case_records(spark, folder), RV.reviewer_votes(T.iterations(spark, folder)))


@query("a37_review_summary", with_ctes("records", "votes", extra=_SUM) + f"""SELECT case_id, status, seed_mode, coalesce(value_a,'N/A') || ' vs ' || coalesce(value_b,'N/A') AS value_pair,
  num_evaluations, approve_count, reject_count, skip_count, {r9('controversy', 'controversy')} FROM rs""")
def a37(spark, folder):
    s = _summary(spark, folder)
    return rounded(s.select("case_id", "status", "seed_mode", S.pair_label("value_a", "value_b").alias("value_pair"),
                            "num_evaluations", "approve_count", "reject_count", "skip_count", "controversy"))


@query("k1_case_orders", with_ctes("records", "votes", extra=_SUM) + """SELECT case_id, row_number() OVER
  (ORDER BY controversy DESC, num_evaluations DESC, created_at DESC, case_id) AS place FROM rs ORDER BY place""")
def k1(spark, folder):
    """Position of each case in the most-controversial order, without a single-task window."""
    return RV.placed_cases(_summary(spark, folder)).select("case_id", "place")


@query("k2_status_priority", with_ctes("records") + """SELECT case_id, status, CASE status WHEN 'needs_review' THEN 1 WHEN 'approved' THEN 2 WHEN 'deprecated' THEN 3
  WHEN 'draft' THEN 4 WHEN 'failed' THEN 5 ELSE 99 END AS priority FROM records ORDER BY priority, case_id""")
def k2(spark, folder):
    rows = RV.by_status_priority(T.case_records(spark, folder))
    return rows.select("case_id", "status", RV.status_priority("status").alias("priority"))


@query("u6_reviewer_list", with_ctes("votes") + "SELECT DISTINCT reviewer FROM votes ORDER BY 1")
def u6_reviewers(spark, folder):
    return RV.reviewer_votes(T.iterations(spark, folder)).select("reviewer").distinct().orderBy("reviewer")


_FB = """fb AS (SELECT votes.*, seed_mode, CASE WHEN decision='reject' THEN ['clarity', seed_mode] WHEN decision='unknown' THEN ['scope'] ELSE [] END AS axes
  FROM votes JOIN records USING (case_id) WHERE comments IS NOT NULL)"""


@query("a36_feedback_statistics", with_ctes("votes", "records", extra=_FB) + """SELECT 'decision' AS facet, decision AS value, count(*) AS n FROM fb GROUP BY decision
  UNION ALL SELECT 'evaluator', reviewer, count(*) FROM fb GROUP BY reviewer UNION ALL SELECT 'seed_mode', seed_mode, count(*) FROM fb GROUP BY seed_mode
  UNION ALL SELECT 'total', '', count(*) FROM fb UNION ALL SELECT 'axis', x, count(*) FROM (SELECT unnest(axes) AS x FROM fb) GROUP BY x""")
def a36(spark, folder):
    votes = RV.reviewer_votes(T.iterations(spark, folder)).withColumnRenamed("reviewer", "evaluator")
    c = votes.join(T.case_records(spark, folder).select("case_id", "seed_mode"), "case_id")
    axes = F.when(F.col("decision") == "reject", F.array(F.lit("clarity"), "seed_mode")).when(
        F.col("decision") == "unknown", F.array(F.lit("scope"))).otherwise(F.array().cast("array<string>"))
    return RV.feedback_statistics(c.withColumn("problem_axes", axes))


@query("v13_search_cases", with_ctes("review") + """SELECT "Case ID" AS case_id, "Vignette" AS vignette FROM review
  WHERE contains(lower("Vignette"), 'the') AND "Reviewer Comments"='en' AND list_contains(["R1","R2"], 'ben') AND list_contains(["R1 Decision?","R2 Decision?"], 'approve')""")
def v13(spark, folder):
    r = T.review_rows(spark, folder)
    cases = r.select(F.col("Case ID").alias("case_id"), F.col("Vignette").alias("text"), F.col("Reviewer Comments").alias("seed_mode"),
                     F.array("R1", "R2").alias("evaluators"), F.array("`R1 Decision?`", "`R2 Decision?`").alias("decisions"))
    return V.search_cases(cases, "The", "en", "ben", "approve").select("case_id", F.col("text").alias("vignette"))


@query("a38_derived_status", with_ctes("review") + """SELECT "Vignette" AS vignette, CASE WHEN 'reject' IN (lower("R1 Decision?"), lower("R2 Decision?"), lower("R3 Decision?")) THEN 'deprecated'
  WHEN 'approve' IN (lower("R2 Decision?"), lower("R3 Decision?")) THEN 'approved' ELSE 'needs_review' END AS derived FROM review""")
def a38(spark, folder):
    return T.review_rows(spark, folder).select(
        F.col("Vignette").alias("vignette"), RV.derive_status("R1 Decision?", "R2 Decision?", "R3 Decision?").alias("derived"))


CONTENT = ["vignette", "choice_1", "choice_2"]
REVIEWERS = ["r1", "r1_decision", "r2", "r2_decision", "r3", "r3_decision"]


def _history(spark, folder):
    """Latest version per record, one reviewer, next to the record's status."""
    last = RV.final_version(T.iterations(spark, folder), "last").withColumn("last_iteration", F.col("iteration"))
    h = T.case_records(spark, folder).select("case_id", "status").join(last, "case_id", "left")
    none = F.lit(None).cast("string")
    return h.select("case_id", "status", "last_iteration", *CONTENT, F.lit(None).cast("string").alias("r1"), none.alias("r1_decision"),
                    F.col("reviewer").alias("r2"), F.col("decision").alias("r2_decision"), none.alias("r3"), none.alias("r3_decision"), "comments")


def _incoming(spark, folder):
    """Edited rows: the last version with content of every order, its reviewer's name in capitals."""
    v = RV.final_version(T.iterations(spark, folder), "last_with_data")
    none = F.lit("")
    vote = F.when(F.col("decision") == "no", "Reject").when(F.col("decision").startswith("Approved"), "Approve").otherwise(F.col("decision"))
    return v.select("case_id", F.concat(F.lit(" "), "vignette").alias("vignette"), "choice_1", "choice_2", none.alias("r1"), none.alias("r1_decision"),
                    F.upper("reviewer").alias("r2"), vote.alias("r2_decision"), none.alias("r3"), none.alias("r3_decision"), "comments")


_W7 = """lastv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS rn FROM iters) WHERE rn=1),
  inc AS (SELECT *, CASE WHEN decision='no' THEN 'Reject' WHEN decision LIKE 'Approved%' THEN 'Approve' ELSE decision END AS vote FROM
    (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS rn FROM iters WHERE vignette IS NOT NULL) WHERE rn=1),
  plan AS (SELECT i.case_id, coalesce(l.iteration,-1)+1 AS next_iteration, r.status AS old_status,
    CASE WHEN i.vote='Reject' THEN 'deprecated' WHEN i.vote='Approve' THEN 'approved' ELSE 'needs_review' END AS new_status, r.case_id IS NOT NULL AS known, l.case_id IS NOT NULL AS has_version,
    trim(coalesce(l.vignette,''))<>trim(i.vignette) OR coalesce(l.choice_1,'')<>i.choice_1 OR lower(trim(coalesce(l.reviewer,'')))<>lower(trim(coalesce(i.reviewer,'')))
      OR lower(trim(coalesce(l.decision,'')))<>lower(trim(coalesce(i.vote,''))) OR trim(coalesce(l.comments,''))<>trim(coalesce(i.comments,'')) AS diff
    FROM inc i LEFT JOIN records r USING (case_id) LEFT JOIN lastv l ON l.case_id=r.case_id),
  acts AS (SELECT case_id, next_iteration, old_status, new_status, CASE WHEN NOT known THEN 'skipped' WHEN NOT has_version OR diff OR old_status<>new_status THEN 'append' ELSE 'unchanged' END AS action FROM plan)"""


@query("w7_update_plan", with_ctes("iters", "records", extra=_W7) + "SELECT * FROM acts")
def w7(spark, folder):
    return RV.plan_updates(_history(spark, folder), _incoming(spark, folder), CONTENT, REVIEWERS, "comments")


@query("a39_import_report", with_ctes("iters", "records", "review", extra=_W7 + f""", e AS (SELECT {_FIELD} AS f, {_wide_rule()} AS rule, "Case ID" AS id FROM review),
  st AS (SELECT id='' OR len(f)>0 OR rule IS NOT NULL AS err FROM e)""") + """SELECT (SELECT count(*) FROM st) AS total_rows, (SELECT count(*) FROM st WHERE NOT err) AS valid_cases,
  0::bigint AS warning_cases, (SELECT count(*) FROM st WHERE err) AS error_cases, count(*) FILTER (action='append') AS imported_cases,
  count(*) FILTER (action='unchanged') AS unchanged_cases, (SELECT count(*) FROM st WHERE err) + count(*) FILTER (action='skipped') AS skipped_cases FROM acts""")
def a39(spark, folder):
    plan = RV.plan_updates(_history(spark, folder), _incoming(spark, folder), CONTENT, REVIEWERS, "comments")
    return RV.import_report(V.validate_review_rows(T.review_rows(spark, folder)), plan)


CTES["rubric"] = ([], f"""SELECT {uuid_sql('l_orderkey', 'record')} AS case_id, l_linestatus AS rubric, l_linenumber AS position, 'c' || l_linenumber AS criterion,
  max(l_returnflag)<>'R' AS outcome, CASE WHEN max(l_returnflag)='R' AND max(l_discount)>0.02 THEN ' change ' || max(l_partkey) || ' ' END AS suggested_changes FROM lineitem
  GROUP BY l_orderkey, l_linestatus, l_linenumber""")


def _rubric(spark, folder):
    g = T.table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linestatus", "l_linenumber").agg(
        F.max("l_returnflag").alias("flag"), F.max("l_discount").alias("d"), F.max("l_partkey").alias("part"))
    return g.select(T.uuid_of("l_orderkey", "record").alias("case_id"), F.col("l_linestatus").alias("rubric"), F.col("l_linenumber").alias("position"),
                    F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("criterion"), (F.col("flag") != "R").alias("outcome"),
                    F.when((F.col("flag") == "R") & (F.col("d") > 0.02), F.concat(F.lit(" change "), F.col("part").cast("string"), F.lit(" "))).alias("suggested_changes"))


@query("a40_rubric_metrics", with_ctes("rubric") + f"""SELECT case_id, rubric, count(*) FILTER (outcome) AS num_passing, count(*) AS num_criteria,
  {r9('avg(outcome::int)', 'pass_rate')}, bool_and(outcome) AS overall_pass, coalesce(string_agg(criterion, ',' ORDER BY position) FILTER (NOT outcome),'') AS failing,
  coalesce(string_agg(criterion || ': ' || trim(suggested_changes), chr(10) ORDER BY position) FILTER (NOT outcome AND suggested_changes IS NOT NULL),'') AS suggestions FROM rubric GROUP BY ALL""")
def a40(spark, folder):
    return rounded(RV.rubric_metrics(_rubric(spark, folder)))


@query("v7_rubric_violations", with_ctes("rubric") + "SELECT case_id, rubric, criterion FROM rubric WHERE NOT outcome AND suggested_changes IS NULL")
def v7(spark, folder):
    return V.rubric_violations(_rubric(spark, folder)).select("case_id", "rubric", "criterion")


# -- selection and sync -----------------------------------------------------------------------

def _records_final(spark, folder):
    final = RV.final_version(T.iterations(spark, folder), "last").select("case_id", F.col("tagged").alias("final_tagged"))
    return T.case_records(spark, folder).join(final, "case_id", "left").fillna({"final_tagged": False})


_RF = """lastv AS (SELECT case_id, max_by(tagged, pos) AS tagged FROM iters GROUP BY case_id), rf AS (SELECT r.*, coalesce(tagged,false) AS final_tagged FROM records r LEFT JOIN lastv USING (case_id))"""


@query("v9_selected_cases", with_ctes("records", "iters", extra=_RF) + "SELECT case_id FROM rf WHERE status='approved' AND final_tagged")
def v9(spark, folder):
    return J.select_cases(_records_final(spark, folder), "approved")


@query("v9_lookup_errors", with_ctes("records", "iters", extra=_RF + f""", w AS (SELECT DISTINCT {uuid_sql('l_partkey', 'record')} AS case_id FROM lineitem)""") + """SELECT w.case_id,
  CASE WHEN rf.case_id IS NULL THEN 'not found' WHEN status<>'approved' THEN 'status ' || status ELSE 'no final version' END AS problem FROM w LEFT JOIN rf USING (case_id)
  WHERE rf.case_id IS NULL OR status<>'approved' OR NOT final_tagged""")
def v9_errors(spark, folder):
    wanted = T.table(spark, folder, "lineitem").select(T.uuid_of("l_partkey", "record").alias("case_id")).distinct()
    return J.lookup_errors(wanted, _records_final(spark, folder))


@query("v11_status_filter", with_ctes("records") + "SELECT case_id, status FROM records WHERE status='needs_review'")
def v11(spark, folder):
    return V.by_status(T.case_records(spark, folder)).select("case_id", "status")


@query("v14_unknown_statuses", with_ctes("records") + "SELECT case_id, status FROM records WHERE status NOT IN ('draft','needs_review','approved','failed','deprecated')")
def v14(spark, folder):
    return V.unknown_statuses(T.case_records(spark, folder))


@query("v15_prompt_drift", f"""SELECT {uuid_sql('l_orderkey', 'record')} AS case_id, CASE WHEN old IS NULL THEN 'set' WHEN old=new THEN 'ok' ELSE 'mismatch' END AS state FROM
  (SELECT l_orderkey, nullif(max(l_returnflag),'N') AS old, min(nullif(l_returnflag,'N')) AS new FROM lineitem GROUP BY l_orderkey HAVING new IS NOT NULL)""")
def v15(spark, folder):
    flag = F.nullif("l_returnflag", F.lit("N"))
    g = T.table(spark, folder, "lineitem").groupBy(T.uuid_of("l_orderkey", "record").alias("case_id"))
    stored = g.agg(F.nullif(F.max("l_returnflag"), F.lit("N")).alias("prompt"))
    current = g.agg(F.min(flag).alias("prompt")).filter("prompt is not null")
    return J.prompt_drift(stored, current)


_SYNC = f"""loc AS (SELECT r.case_id, i.case_id IS NOT NULL AS exportable FROM records r LEFT JOIN (SELECT DISTINCT case_id FROM iters WHERE tagged) i USING (case_id)),
  sh AS (SELECT DISTINCT {uuid_sql('c_custkey', 'record')} AS case_id FROM customer UNION SELECT {uuid_sql('p_partkey+(SELECT count(*) FROM orders)-500', 'record')} FROM part)"""


def _sync_sides(spark, folder):
    tagged = RV.final_version(T.iterations(spark, folder), "last_tagged").select("case_id", F.lit(True).alias("exportable"))
    local = T.case_records(spark, folder).join(tagged, "case_id", "left").fillna({"exportable": False})
    n = T.table(spark, folder, "orders").agg(F.count("*")).scalar()
    more = T.table(spark, folder, "part").withColumn("k", F.col("p_partkey") + n - 500).select(T.uuid_of("k", "record").alias("case_id"))
    sheet = T.table(spark, folder, "customer").select(T.uuid_of("c_custkey", "record").alias("case_id")).unionByName(more)
    return local, sheet


@query("j3_sync_plan", with_ctes("records", "iters", extra=_SYNC) + """SELECT coalesce(loc.case_id, sh.case_id) AS case_id, CASE WHEN loc.case_id IS NULL THEN 'sheet_only'
  WHEN sh.case_id IS NOT NULL THEN 'pull' WHEN exportable THEN 'push' ELSE 'skipped' END AS action FROM loc FULL JOIN sh ON loc.case_id=sh.case_id""")
def j3(spark, folder):
    return J.sync_plan(*_sync_sides(spark, folder))


@query("j3_sync_plan_without_sheet", with_ctes("records", "iters", extra=_SYNC) + "SELECT case_id, CASE WHEN exportable THEN 'push' ELSE 'skipped' END AS action FROM loc")
def j3_local(spark, folder):
    return J.sync_plan(_sync_sides(spark, folder)[0], None)


@query("j3_sync_summary", with_ctes("records", "iters", extra=_SYNC) + """SELECT count(loc.case_id) AS local_count, count(sh.case_id) AS sheet_count, count(*) FILTER (sh.case_id IS NULL) AS local_only,
  count(*) FILTER (loc.case_id IS NOT NULL AND sh.case_id IS NOT NULL) AS in_both, count(*) FILTER (loc.case_id IS NULL) AS sheet_only FROM loc FULL JOIN sh ON loc.case_id=sh.case_id""")
def j3_summary(spark, folder):
    return J.sync_summary(*_sync_sides(spark, folder))


@query("j4_append_new", with_ctes("records", "iters", extra=_SYNC) + "SELECT case_id, status FROM records WHERE case_id NOT IN (SELECT case_id FROM sh)")
def j4(spark, folder):
    _, sheet = _sync_sides(spark, folder)
    return J.append_new(T.case_records(spark, folder).select("case_id", "status"), sheet)


@query("j5_rows_by_id", with_ctes("iters") + f"""SELECT case_id, pos, pos+2 AS row_number, vignette FROM iters WHERE case_id IN (SELECT {uuid_sql('c_custkey', 'record')} FROM customer)""")
def j5(spark, folder):
    ids = T.table(spark, folder, "customer").select(T.uuid_of("c_custkey", "record").alias("case_id"))
    return RV.numbered_rows(J.rows_by_id(T.iterations(spark, folder), ids)).select("case_id", "pos", "row_number", "vignette")


@query("s9_review_rows_read", with_ctes("review") + """SELECT "Vignette" AS vignette, "Case ID" AS case_id, "Status" AS status FROM review
  WHERE lower("Status")='approved'""")
def s9(spark, folder):
    from panelstat.sources import review_table

    rows = review_table.clean_rows(T.review_rows(spark, folder))
    return review_table.with_status(rows, "Approved").select(
        F.col("Vignette").alias("vignette"), F.col("Case ID").alias("case_id"), F.col("Status").alias("status"))


@query("s10_review_rows_for_export", with_ctes("iters", "records", extra="""f AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS rn FROM iters WHERE tagged)""") + """SELECT f.case_id AS "Case ID",
  '' AS "R1", '' AS "R1 Decision?", '' AS "R2", '' AS "R2 Decision?", '' AS "R3", '' AS "R3 Decision?", status AS "Status", vignette AS "Vignette", choice_1 AS "Choice 1", """ +
  ", ".join(f"'neutral' AS \"{n}\"" for n in CAP) + """, choice_2 AS "Choice 2", coalesce(comments,'') AS "Reviewer Comments" FROM f JOIN records USING (case_id) WHERE rn=1""")
def s10(spark, folder):
    final = RV.final_version(T.iterations(spark, folder), "last_tagged")
    return RV.review_row(final.join(T.case_records(spark, folder).select("case_id", "status"), "case_id"))


# -- seeds ------------------------------------------------------------------------------------

def _seeds(spark, folder):
    return T.table(spark, folder, "part").select("p_partkey", F.trim("p_name").alias("text"), F.col("p_type").alias("scenario_type"))


_SEEDS = "s AS (SELECT p_partkey, trim(p_name) AS text, row_number() OVER (ORDER BY md5(p_partkey::varchar), p_partkey)-1 AS pos FROM part WHERE p_type='ECONOMY')"


@query("s13_seed_positions", f"WITH {_SEEDS} SELECT p_partkey, text, pos FROM s")
def s13(spark, folder):
    economy = SD.of_type(_seeds(spark, folder), "ECONOMY")
    return economy.join(dense_position(economy, "p_partkey"), "p_partkey").select("p_partkey", "text", "pos")


@query("s13_seed_by_index", f"WITH {_SEEDS} SELECT p_partkey, text FROM s WHERE pos=7")
def s13_index(spark, folder):
    economy = SD.of_type(_seeds(spark, folder), "ECONOMY")
    at = SD.seed_at(dense_position(economy, "p_partkey"), 7)
    return economy.join(at, "p_partkey").select("p_partkey", "text")


@query("s13_random_seed", f"WITH {_SEEDS} SELECT p_partkey, text FROM s ORDER BY {u32("'42|' || p_partkey")}, p_partkey LIMIT 1")
def s13_random(spark, folder):
    return SD.random_seed_row(SD.of_type(_seeds(spark, folder), "ECONOMY"), "p_partkey", 42).select("p_partkey", "text")
