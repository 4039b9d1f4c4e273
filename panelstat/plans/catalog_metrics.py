"""Queries over the decision facts: summaries, preference, agreement, refusal, entropy, pluralism."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.operators import merge as J
from panelstat.operators import metrics as M
from panelstat.operators import summary as SM
from panelstat.plans.oracle import CTES, entropy_sql, uuid_sql, with_ctes
from panelstat.plans.positions import case_positions
from panelstat.plans.registry import query
from panelstat.schema import ATTRIBUTES, CONSENSUS
from panelstat.sources import tables as T

R = S.rounded
PANEL = T.MODELS + [CONSENSUS]


def summary(spark, folder):
    return SM.with_consensus(T.summary(spark, folder), T.human_summary(spark, folder))


def rounded(df, digits=9, **cols):
    """Replace the named columns by rounded ones."""
    wanted = cols or {c: digits for c, t in df.dtypes if t == "double"}
    return df.select(*[R(c, wanted[c]).alias(c) if c in wanted else F.col(c) for c in df.columns])


def r9(expr: str, name: str) -> str:
    return f"round({expr},9)+0.0 AS {name}"


@query("a1_run_summary", with_ctes("summary") + f"""SELECT case_id, rater, c1, c2, refusals, valid, runs_completed,
  majority, {r9('p1', 'p1')}, {r9('majority_probability', 'majority_probability')}, {r9('entropy', 'entropy')} FROM summary""")
def a1(spark, folder):
    return rounded(summary(spark, folder))


@query("a3_human_consensus", with_ctes("consensus") + f"""SELECT case_id, majority AS majority_choice, c1 AS choice_1_votes,
  c2 AS choice_2_votes, refusals AS refusal_votes, valid AS total_votes, {r9('majority_probability', 'confidence')} FROM consensus""")
def a3(spark, folder):
    return rounded(SM.human_consensus(T.human_summary(spark, folder)))


@query("a4_value_preference", with_ctes("pref") + f"""SELECT rater, attribute, {r9('avg(value)', 'preference')}, count(*) AS n_cases
  FROM pref GROUP BY ALL""")
def a4(spark, folder):
    return rounded(M.value_preference(summary(spark, folder), T.tags(spark, folder)))


@query("a4_value_preference_per_case", with_ctes("pref") + f"SELECT case_id, rater, attribute, {r9('value', 'value')} FROM pref")
def a4_cases(spark, folder):
    return rounded(M.value_preference_per_case(summary(spark, folder), T.tags(spark, folder)))


@query("a5_agreement_matrix", with_ctes("summary") + f"""SELECT a.rater AS rater_a, b.rater AS rater_b,
  {r9('avg((a.majority=b.majority)::int)', 'agreement')}, count(*) AS n_cases FROM summary a JOIN summary b
  ON a.case_id=b.case_id AND a.rater<b.rater AND a.majority IS NOT NULL AND b.majority IS NOT NULL GROUP BY ALL""")
def a5(spark, folder):
    return rounded(M.agreement_matrix(summary(spark, folder)))


@query("j7_agreement_of_two", with_ctes("summary") + f"""SELECT {r9('avg((a.majority=b.majority)::int)', 'agreement')},
  count(*) AS n_cases FROM summary a JOIN summary b USING (case_id)
  WHERE a.rater='model/m1F' AND b.rater='human_consensus' AND a.majority IS NOT NULL AND b.majority IS NOT NULL""")
def j7(spark, folder):
    return rounded(M.agreement_rate(summary(spark, folder), "model/m1F", CONSENSUS))


@query("a6_refusal_rate", with_ctes("own") + f"""SELECT rater, {r9('avg(refusals::double/nullif(valid+refusals,0))', 'refusal_rate')},
  count(nullif(valid+refusals,0)) AS n_cases FROM own GROUP BY rater""")
def a6(spark, folder):
    return rounded(M.refusal_rate(summary(spark, folder)))


def entropies(spark, folder):
    return M.entropy_per_case(T.cases(spark, folder), summary(spark, folder), PANEL)


@query("a7_entropy_per_case", with_ctes("grid") + f"SELECT case_id, rater, {r9('entropy', 'entropy')} FROM grid")
def a7(spark, folder):
    return rounded(entropies(spark, folder))


@query("a8_entropy_statistics", with_ctes("grid") + f"""SELECT rater, {r9('avg(entropy)', 'mean')}, {r9('stddev_samp(entropy)', 'std')},
  {r9('min(entropy)', '"min"')}, {r9('max(entropy)', '"max"')}, {r9('quantile_cont(entropy,0.1)', 'p10')},
  {r9('quantile_cont(entropy,0.25)', 'p25')}, {r9('quantile_cont(entropy,0.5)', 'median')}, {r9('quantile_cont(entropy,0.75)', 'p75')},
  {r9('quantile_cont(entropy,0.9)', 'p90')}, count(entropy) AS n_cases, count(*) AS n_total FROM grid GROUP BY rater""")
def a8(spark, folder):
    return rounded(M.entropy_statistics(entropies(spark, folder)))


@query("a10_aggregate_entropy", with_ctes("grid") + f"""SELECT case_id, {r9('avg(entropy)', 'entropy')} FROM grid
  WHERE rater<>'human_consensus' GROUP BY case_id""")
def a10(spark, folder):
    return rounded(M.aggregate_entropy_per_case(entropies(spark, folder), T.MODELS))


_KAPPA = """kt AS (SELECT case_id, count(*) FILTER (majority='choice_1') AS choice_1_count,
  count(*) FILTER (majority='choice_2') AS choice_2_count FROM own WHERE rater LIKE 'human/%' GROUP BY case_id
  HAVING count(majority)>0)"""


@query("a12_kappa_table", with_ctes("own", extra=_KAPPA) + "SELECT * FROM kt")
def a12(spark, folder):
    return M.kappa_table(T.human_summary(spark, folder))


@query("a13_fleiss_kappa", with_ctes("own", extra=_KAPPA + """,
  k AS (SELECT choice_1_count a, choice_2_count b, choice_1_count+choice_2_count n FROM kt),
  f AS (SELECT avg((a*a+b*b-n)::double/(n*(n-1))) p_bar, count(*) n_cases,
    (sum(a)::double/sum(n))**2 + (sum(b)::double/sum(n))**2 p_e FROM k WHERE n>1)""") +
  f"SELECT {r9('(p_bar-p_e)/(1-p_e)', 'kappa')}, {r9('p_bar', 'p_bar')}, {r9('p_e', 'p_e')}, n_cases FROM f")
def a13(spark, folder):
    table = M.kappa_table(T.human_summary(spark, folder))
    return rounded(M.fleiss_kappa(table, ["choice_1_count", "choice_2_count"], strict=False))


@query("a14_tension_pairs", with_ctes("tension") + "SELECT case_id, x, y FROM tension")
def a14(spark, folder):
    return M.tension_pairs(T.tags(spark, folder))


@query("a14_tension_udtf", with_ctes("tension") + "SELECT case_id, x, y FROM tension")
def a14_udtf(spark, folder):
    return M.tension_pairs_lateral(T.tags(spark, folder))


@query("a15_tension_matrix", with_ctes("tension", extra="""
  both_ways AS (SELECT x, y FROM tension UNION ALL SELECT y, x FROM tension)""") +
  "SELECT x AS attribute, " + ", ".join(f"count(*) FILTER (y='{a}') AS {a}" for a in ATTRIBUTES) + " FROM both_ways GROUP BY x")
def a15(spark, folder):
    return M.tension_matrix(M.tension_pairs(T.tags(spark, folder)), ATTRIBUTES)


_PAIRS = [f"{x}_{y}" for i, x in enumerate(sorted(ATTRIBUTES)) for y in sorted(ATTRIBUTES)[i + 1:]]


@query("a15_tension_incidence", with_ctes("cases", "tension") + "SELECT c.case_id, " +
       ", ".join(f"(count(*) FILTER (x || '_' || y = '{p}'))::int AS {p}" for p in _PAIRS) +
       " FROM cases c LEFT JOIN tension t USING (case_id) GROUP BY c.case_id")
def a15_incidence(spark, folder):
    return M.tension_incidence(T.cases(spark, folder), M.tension_pairs(T.tags(spark, folder)), ATTRIBUTES)


@query("a16_panel_pluralism", with_ctes("consensus") + f"""SELECT count(*) FILTER (majority_probability<0.7) AS n_below,
  count(*) AS n_cases, {r9('quantile_cont(majority_probability,0.5)', 'median_plurality')} FROM consensus WHERE majority_probability IS NOT NULL""")
def a16(spark, folder):
    return rounded(M.panel_pluralism(SM.human_consensus(T.human_summary(spark, folder))))


_DET = """det AS (SELECT rater, avg((greatest(c1,c2)*10>=valid*9)::int) AS near_deterministic,
  quantile_cont(entropy,0.75) AS p75, count(*) AS n_cases FROM own WHERE valid>0 GROUP BY rater)"""


@query("a17_near_determinism", with_ctes("own", extra=_DET) + f"""SELECT rater, {r9('near_deterministic', 'near_deterministic')},
  {r9('p75', 'p75')}, n_cases FROM det""")
def a17(spark, folder):
    return rounded(M.near_determinism(T.summary(spark, folder)))


@query("a17_determinism_overview", with_ctes("own", extra=_DET) + f"""SELECT count(*) FILTER (p75>0) AS n_varied, count(*) AS n_raters,
  {r9('quantile_cont(near_deterministic,0.5)', 'median_share')}, {r9('quantile_cont(near_deterministic,0.75)', 'p75_share')} FROM det""")
def a17_overview(spark, folder):
    return rounded(M.determinism_overview(M.near_determinism(T.summary(spark, folder))))


@query("w4_case_positions", with_ctes("positions") + "SELECT case_id, pos, n FROM positions")
def w4(spark, folder):
    return case_positions(T.cases(spark, folder))


@query("w6_latest_responses", with_ctes("latest") + "SELECT case_id, participant_id, parsed_choice, event_id FROM latest")
def w6(spark, folder):
    return J.latest_responses(T.responses(spark, folder)).select("case_id", "participant_id", "parsed_choice", "event_id")


@query("w6_upsert_after_reimport", with_ctes("latest") + "SELECT case_id, participant_id, parsed_choice, event_id FROM latest")
def w6_twice(spark, folder):
    cols = ["case_id", "participant_id", "parsed_choice", "ts", "event_id"]
    incoming = T.responses(spark, folder).select(*cols)
    empty = incoming.filter(F.lit(False))
    once = J.upsert_responses(empty, incoming, 1)
    return J.upsert_responses(once, incoming, 2).select("case_id", "participant_id", "parsed_choice", "event_id")


@query("v10_with_humans", with_ctes("own") + """SELECT case_id, rater, c1, c2, refusals FROM own
  WHERE case_id IN (SELECT case_id FROM own WHERE rater LIKE 'human/%')""")
def v10(spark, folder):
    return J.with_humans(T.summary(spark, folder)).select("case_id", "rater", "c1", "c2", "refusals")


@query("u1_all_case_ids", f"""SELECT {uuid_sql('p_partkey')} AS case_id FROM part UNION SELECT {uuid_sql('l_partkey')} FROM lineitem""")
def u1(spark, folder):
    return T.cases(spark, folder).select("case_id").union(T.model_runs(spark, folder).select("case_id")).distinct()


@query("u2_in_both", with_ctes("model_runs", "latest") + "SELECT case_id FROM model_runs INTERSECT SELECT case_id FROM latest")
def u2(spark, folder):
    return T.model_runs(spark, folder).select("case_id").intersect(T.human_runs(spark, folder).select("case_id"))


@query("u3_only_one_rater", with_ctes("model_runs") + """SELECT case_id FROM model_runs WHERE rater='model/m1F'
  EXCEPT SELECT case_id FROM model_runs WHERE rater='model/m1O'""")
def u3(spark, folder):
    runs = T.model_runs(spark, folder)
    ids = lambda r: runs.filter(F.col("rater") == r).select("case_id")
    return ids("model/m1F").subtract(ids("model/m1O"))


@query("u4_common_cases", with_ctes("model_runs") + """SELECT case_id FROM model_runs
  GROUP BY case_id HAVING count(DISTINCT rater)=14""")
def u4(spark, folder):
    return J.common_cases(T.model_runs(spark, folder), T.MODELS)


@query("u5_ordered_union", with_ctes("responses", "positions") + """SELECT case_id, min_by(src, src*1e12+pos)::int AS src,
  min_by(pos, src*1e12+pos)::bigint AS pos FROM
  (SELECT case_id, 0 AS src, event_id AS pos FROM responses UNION ALL SELECT case_id, 1, pos FROM positions) GROUP BY case_id""")
def u5(spark, folder):
    first = T.responses(spark, folder).select("case_id", F.col("event_id").alias("pos"))
    return J.ordered_union(first, case_positions(T.cases(spark, folder)), "case_id", "pos")


@query("u6_rater_list", with_ctes("runs") + "SELECT DISTINCT rater, rater LIKE 'human/%' AS human FROM runs")
def u6(spark, folder):
    r = T.runs(spark, folder).select("rater").distinct()
    return r.withColumn("human", F.col("rater").startswith("human/")).orderBy("rater")


@query("j1_merge_cases", with_ctes("model_runs", "latest", extra="""
  m AS (SELECT case_id, count(*) AS votes, min(rater) AS first_rater FROM model_runs GROUP BY case_id),
  h AS (SELECT case_id, count(*) AS votes, min('human/' || participant_id) AS first_rater FROM latest GROUP BY case_id)""") +
  """SELECT coalesce(m.case_id,h.case_id) AS case_id, CASE WHEN m.case_id IS NOT NULL THEN m.votes ELSE h.votes END AS votes,
  CASE WHEN m.case_id IS NOT NULL THEN m.first_rater ELSE h.first_rater END AS first_rater,
  CASE WHEN m.case_id IS NULL THEN 'secondary' WHEN h.case_id IS NULL THEN 'primary' ELSE 'both' END AS origin
  FROM m FULL JOIN h ON m.case_id=h.case_id""")
def j1(spark, folder):
    side = lambda df: df.groupBy("case_id").agg(F.count("*").alias("votes"), F.min("rater").alias("first_rater"))
    return J.merge_cases(side(T.model_runs(spark, folder)), side(T.human_runs(spark, folder)), ["votes", "first_rater"])


@query("j1_merge_runs", with_ctes("runs") + "SELECT case_id, rater, count(*) AS n FROM runs GROUP BY ALL")
def j1_runs(spark, folder):
    merged = J.merge_runs(T.model_runs(spark, folder), T.human_runs(spark, folder))
    return merged.groupBy("case_id", "rater").agg(F.count("*").alias("n"))


@query("j2_lookup_cases", with_ctes("model_runs", "latest", "cases", extra="""
  a AS (SELECT case_id, min(parsed_choice) AS choice FROM latest GROUP BY case_id),
  b AS (SELECT case_id, max(parsed_choice) AS choice FROM model_runs GROUP BY case_id)""") +
  """SELECT c.case_id, CASE WHEN a.case_id IS NOT NULL THEN a.choice ELSE b.choice END AS choice,
  CASE WHEN a.case_id IS NOT NULL THEN 'first' WHEN b.case_id IS NOT NULL THEN 'second' END AS origin
  FROM cases c LEFT JOIN a USING (case_id) LEFT JOIN b USING (case_id)""")
def j2(spark, folder):
    a = T.human_runs(spark, folder).groupBy("case_id").agg(F.min("parsed_choice").alias("choice"))
    b = T.model_runs(spark, folder).groupBy("case_id").agg(F.max("parsed_choice").alias("choice"))
    return J.lookup_cases(T.cases(spark, folder).select("case_id"), a, b, ["choice"])


@query("j6_pending_work", with_ctes("cases", "models14", "own") + """SELECT case_id, rater, unnest(range(done, 4)) AS run FROM
  (SELECT c.case_id, m.rater, coalesce(s.runs_completed,0) AS done FROM cases c CROSS JOIN models14 m
   LEFT JOIN own s ON s.case_id=c.case_id AND s.rater=m.rater) WHERE done<4""")
def j6(spark, folder):
    done = T.model_summary(spark, folder)
    return J.pending_work(T.cases(spark, folder), done, T.MODELS, 4)
