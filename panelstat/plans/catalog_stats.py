"""Correlation, regression, profile and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.operators import correlate as C
from panelstat.operators import glm as G
from panelstat.operators import merge as J
from panelstat.operators import metrics as M
from panelstat.operators import profiles as P
from panelstat.operators import rankpairs as RP
from panelstat.operators import resample as RS
from panelstat.operators import summary as SM
from panelstat.plans import oracle as O
from panelstat.plans.catalog_metrics import PANEL, R, r9, rounded, summary
from panelstat.plans.oracle import ATTRS, cells_sql, join_ctes, jsd_sql, newton, softmax_sql, u32, with_ctes
from panelstat.plans.positions import case_positions
from panelstat.plans.registry import query
from panelstat.plans.reuse import materialise
from panelstat.schema import ATTRIBUTES, CONSENSUS
from panelstat.sources import tables as T

TEMPERATURE = 0.262
SEED = 42
DRAWS = 1000
PERMUTATIONS = JSD_DRAWS = PANEL_DRAWS = 10_000


def r6(expr: str, name: str) -> str:
    return f"round({expr},6)+0.0 AS {name}"


def erfc_sql(x: str) -> str:
    """1 - erf by the series of positive terms; beyond 6 it is below 1e-16."""
    terms = f"list_sum(list_transform(range(0, 200), lambda k: exp(2*k*ln(2) + (2*k+1)*ln({x}) + lgamma(k+1) - lgamma(2*k+2))))"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x}<1e-12 THEN 1.0 WHEN {x}>6 THEN 0.0 ELSE 1 - 2/sqrt(pi())*exp(-({x})*({x}))*{terms} END"


def clean(x: str) -> str:
    return f"round({x},12)"


# -- ranks and correlations -------------------------------------------------------------------

@query("w3_average_rank", with_ctes("summary", extra="""v AS (SELECT rater, round(entropy,12) AS value FROM summary WHERE entropy IS NOT NULL)""") +
  """SELECT DISTINCT rater, round(value,9)+0.0 AS value, count(*) OVER w AS n,
  (rank() OVER (PARTITION BY rater ORDER BY value) + (count(*) OVER w - 1)/2.0)::double AS rank FROM v WINDOW w AS (PARTITION BY rater, value)""")
def w3(spark, folder):
    s = summary(spark, folder).filter("entropy is not null").withColumn("value", F.round("entropy", 12))
    ranks = C.average_rank(s, ["rater"], "value")
    return ranks.select("rater", R("value", 9).alias("value"), "n", F.col("rank").cast("double").alias("rank"))


def _pearson(x: str, y: str) -> str:
    n = "count(*)"
    vx, vy = f"({n}*sum({x}*{x})-sum({x})*sum({x}))", f"({n}*sum({y}*{y})-sum({y})*sum({y}))"
    return f"CASE WHEN {vx}>1e-9 AND {vy}>1e-9 THEN ({n}*sum({x}*{y})-sum({x})*sum({y}))/sqrt({vx}*{vy}) END"


@query("a9_entropy_correlation", with_ctes("summary") + f"""SELECT a.rater AS rater_a, b.rater AS rater_b,
  {r6(_pearson('a.entropy', 'b.entropy'), 'r')}, count(*) AS n FROM summary a JOIN summary b
  ON a.case_id=b.case_id AND a.rater<b.rater AND a.entropy IS NOT NULL AND b.entropy IS NOT NULL GROUP BY ALL""")
def a9(spark, folder):
    return rounded(C.entropy_correlation_matrix(summary(spark, folder)), 6)


_PAIRS = f"""ep AS (SELECT o.case_id, o.rater, {clean('r.entropy')} AS x, {clean('o.entropy')} AS y FROM summary o
  JOIN summary r USING (case_id) WHERE r.rater='human_consensus' AND o.rater<>'human_consensus'
  AND o.rater NOT LIKE 'human/%' AND r.entropy IS NOT NULL AND o.entropy IS NOT NULL)"""


def _spearman_sql(src: str, by: str, tail: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    partx = f"PARTITION BY {by + ', ' if by else ''}"
    return f"""SELECT {by + ',' if by else ''} {_pearson('rx', 'ry')} AS rho, count(*) AS n FROM (SELECT *,
      rank() OVER ({part} ORDER BY x) + (count(*) OVER ({partx} x)-1)/2.0 AS rx,
      rank() OVER ({part} ORDER BY y) + (count(*) OVER ({partx} y)-1)/2.0 AS ry FROM {src}) {'GROUP BY ' + by if by else ''} {tail}"""


def _model_pairs(spark, folder):
    s = summary(spark, folder)
    panel = SM.models(s).unionByName(s.filter(F.col("rater") == CONSENSUS))
    return C.entropy_pairs(panel, CONSENSUS)


@query("a11_entropy_rank_correlation", with_ctes("summary", extra=_PAIRS + f", sp AS ({_spearman_sql('ep', 'rater')})") +
       f"SELECT rater, {r9('rho', 'rho')}, n FROM sp WHERE n>=3")
def a11(spark, folder):
    return rounded(C.spearman(_model_pairs(spark, folder), ["rater"]).drop("p"))


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom, by its finite sums of powers of a cosine."""
    a = f"atan(abs({t})/sqrt({df}))"
    even = f"list_sum(list_transform(range(0, ({df}//2)::bigint), lambda k: exp(lgamma(2*k+1) - 2*k*ln(2) - 2*lgamma(k+1) + 2*k*ln(cos({a})))))"
    odd = f"list_sum(list_transform(range(1, (({df}+1)//2)::bigint), lambda k: exp(2*(k-1)*ln(2) + 2*lgamma(k) - lgamma(2*k) + (2*k-1)*ln(cos({a})))))"
    return f"CASE WHEN {df}%2=0 THEN 1 - sin({a})*{even} ELSE 1 - 2/pi()*({a} + sin({a})*coalesce({odd}, 0)) END"


@query("a11_entropy_rank_p_values", with_ctes("summary", extra=_PAIRS + f", sp AS ({_spearman_sql('ep', 'rater')})") +
       f"""SELECT rater, {r9('rho', 'rho')}, n, {r9('CASE WHEN rho IS NULL THEN NULL WHEN abs(rho)>=1 THEN 0.0 ELSE ' + t_tail_sql('t', 'df') + ' END', 'p')}
  FROM (SELECT *, n-2 AS df, rho*sqrt((n-2)/nullif(1-rho*rho, 0)) AS t FROM sp WHERE n>=3)""")
def a11_p(spark, folder):
    return rounded(C.spearman(_model_pairs(spark, folder), ["rater"]))


@query("j8_entropy_pairs", with_ctes("summary", extra=_PAIRS) + f"SELECT case_id, rater, {r9('x', 'x')}, {r9('y', 'y')} FROM ep")
def j8(spark, folder):
    p = _model_pairs(spark, folder)
    return p.select("case_id", "rater", R("x", 9).alias("x"), R("y", 9).alias("y"))


@query("a18_rho_overview", with_ctes("summary", extra=_PAIRS + f", sp AS ({_spearman_sql('ep', 'rater')})") +
       f"SELECT {r9('avg(rho)', 'mean_rho')}, {r9('min(rho)', 'min_rho')}, {r9('max(rho)', 'max_rho')}, count(rho) AS n_raters FROM sp WHERE n>=3")
def a18(spark, folder):
    return rounded(C.rho_overview(C.spearman(_model_pairs(spark, folder), ["rater"])))


_COMMON = _PAIRS + """, common AS (SELECT case_id FROM ep GROUP BY case_id HAVING count(DISTINCT rater)=14),
  me AS (SELECT case_id, round(min(x),12) AS x, round(avg(y),12) AS y FROM ep WHERE case_id IN (FROM common) GROUP BY case_id)"""


def _mean_pairs(spark, folder):
    p = _model_pairs(spark, folder)
    return C.mean_entropy_pairs(p, J.common_cases(p, T.MODELS))


@query("a18_mean_entropy_rho", with_ctes("summary", extra=_COMMON + f", sp AS ({_spearman_sql('me', '')})") + f"SELECT {r9('rho', 'rho')}, n FROM sp")
def a18_mean(spark, folder):
    return rounded(C.spearman(_mean_pairs(spark, folder), []).drop("p"))


@query("a18_pooled_rho", with_ctes("summary", extra=_PAIRS + f", sp AS ({_spearman_sql('ep', '')})") + f"SELECT {r9('rho', 'rho')}, n FROM sp")
def a18_pooled(spark, folder):
    return rounded(C.spearman(_model_pairs(spark, folder), []).drop("p"))


@query("a19_linear_trend", with_ctes("summary", extra=_COMMON) + f"""SELECT {r9('regr_slope(y,x)', 'slope')},
  {r9('regr_intercept(y,x)', 'intercept')}, count(*) AS n FROM me""")
def a19(spark, folder):
    return rounded(C.linear_trend(_mean_pairs(spark, folder)))


# -- regression -------------------------------------------------------------------------------

def design(spark, folder):
    return G.design_matrix(summary(spark, folder), T.tags(spark, folder))


def cells(spark, folder):
    return G.design_cells(design(spark, folder), ["rater"])


def fits(spark, folder, sandwich=False):
    return G.fit_cells(cells(spark, folder), ["rater"], sandwich=sandwich)


@query("a20_design_matrix", with_ctes("design") + "SELECT case_id, rater, " + ", ".join(f"x{i}::int AS d_{a}" for i, a in enumerate(ATTRS)) +
       f", {r9('p1', 'p1')}, n::bigint AS n FROM design")
def a20(spark, folder):
    return rounded(design(spark, folder).drop("c1"))


@query("a20_design_cells", with_ctes("cells") + "SELECT rater, " + ", ".join(f"x{i}::int AS d_{a}" for i, a in enumerate(ATTRS)) +
       f", trials, successes, {r9('squares', 'squares')}, {r9('binomial', 'binomial')}, {r9('saturated', 'saturated')}, n_cases FROM cells")
def a20_cells(spark, folder):
    return rounded(cells(spark, folder))


_LONG = ", ".join(f"('{a}', b{i})" for i, a in enumerate(ATTRS))


@query("a21_value_weights", with_ctes("fit") + f"""SELECT rater, t.attribute, {r6('t.beta', 'beta')}, 'converged' AS status
  FROM fit, LATERAL (VALUES {_LONG}) t(attribute, beta)""")
def a21(spark, folder):
    long = G.long_weights(fits(spark, folder), ["rater"])
    return rounded(long.select("rater", "attribute", "beta", "status"), 6)


_ERR = ", ".join(f"('{a}', b{i}, e{i})" for i, a in enumerate(ATTRS))


@query("a22_sandwich_errors", with_ctes("sand") + f"""SELECT rater, t.attribute, {r6('t.beta', 'beta')}, {r6('t.se', 'std_error')}
  FROM sand, LATERAL (VALUES {_ERR}) t(attribute, beta, se)""")
def a22(spark, folder):
    long = G.long_weights(fits(spark, folder, sandwich=True), ["rater"])
    return rounded(long.select("rater", "attribute", "beta", "std_error"), 6)


@query("a22_weight_p_values", with_ctes("sand") + f"""SELECT rater, attribute, {r6('beta', 'beta')}, {r6('se', 'std_error')}, 'converged' AS status,
  round({erfc_sql('x')},6)+0.0 AS p_value FROM (SELECT rater, t.attribute, t.beta, t.se, abs(t.beta/nullif(t.se,0))/sqrt(2) AS x FROM sand, LATERAL (VALUES {_ERR}) t(attribute, beta, se))""")
def a22_p(spark, folder):
    return rounded(G.long_weights(fits(spark, folder, sandwich=True), ["rater"]), 6)


@query("a22_leverage_errors", with_ctes("lev") + f"""SELECT rater, t.attribute, {r6('t.se', 'std_error')}
  FROM lev, LATERAL (VALUES {_ERR}) t(attribute, beta, se)""")
def a22_hc3(spark, folder):
    return rounded(G.leverage_errors(design(spark, folder), fits(spark, folder)).select("rater", "attribute", "std_error"), 6)


@query("a22_leverage_p_values", with_ctes("fit", "lev") + f"""SELECT rater, attribute, {r6('beta', 'beta')}, {r6('se', 'std_error')}, round({erfc_sql('x')},6)+0.0 AS p_value FROM
  (SELECT rater, t.attribute, t.beta, t.se, abs(t.beta/nullif(t.se,0))/sqrt(2) AS x FROM (SELECT fit.*, lev.* EXCLUDE (rater, b0, b1, b2, b3) FROM fit JOIN lev ON lev.rater=fit.rater), LATERAL (VALUES {_ERR}) t(attribute, beta, se))""")
def a22_hc3_p(spark, folder):
    return rounded(G.leverage_errors(design(spark, folder), fits(spark, folder)), 6)


_EXPECT = " + ".join(f"b{i}*x{i}" for i in range(4))
_GOF = f"""lik AS (SELECT rater, sum(successes*eta - trials*ln(1+exp(eta))) AS ll, sum(binomial) AS k, sum(saturated) AS sat,
  sum(trials) AS n, sum(successes) AS s, sum(n_cases)::bigint AS n_cases FROM (SELECT *, {_EXPECT} AS eta FROM cells JOIN fit USING (rater)) GROUP BY rater),
  nul AS (SELECT *, s*ln(s/n) + (n-s)*ln(1-s/n) + k AS ll0 FROM lik)"""


@query("a23_goodness_of_fit", with_ctes("fit", extra=_GOF) + f"""SELECT rater, {r6('ll+k', 'log_likelihood')}, {r6('2*(sat-ll)', 'deviance')},
  {r6('(ll0-ll-k)/ll0', 'mcfadden_r2')}, n_cases FROM nul""")
def a23(spark, folder):
    return rounded(G.goodness_of_fit(fits(spark, folder), ["rater"]), 6)


@query("a24_uniform_null_test", with_ctes("fit", "fit1", extra=_GOF + """,
  lik1 AS (SELECT rater, sum(successes*eta - trials*ln(1+exp(eta))) AS ll1 FROM
    (SELECT *, b0*(x0+x1+x2+x3) AS eta FROM cells JOIN fit1 USING (rater)) GROUP BY rater)""") +
  f"""SELECT rater, {r6('greatest(2*(ll-ll1),0.0)', 'lrt')}, {r6('ll1+k', 'll_null')}, {r6('ll+k', 'll_alt')}, 3 AS df
  FROM lik JOIN lik1 USING (rater)""")
def a24(spark, folder):
    return rounded(G.lrt_uniform_null(cells(spark, folder), ["rater"]).drop("p_value"), 6)


@query("a24_uniform_null_p_values", with_ctes("fit", "fit1", extra=_GOF + """,
  lik1 AS (SELECT rater, sum(successes*eta - trials*ln(1+exp(eta))) AS ll1 FROM
    (SELECT *, b0*(x0+x1+x2+x3) AS eta FROM cells JOIN fit1 USING (rater)) GROUP BY rater),
  ts AS (SELECT rater, greatest(2*(ll-ll1),0.0) AS lrt, ll1+k AS ln, ll+k AS la, sqrt(greatest(2*(ll-ll1),0.0)/2) AS x FROM lik JOIN lik1 USING (rater))""") +
  f"""SELECT rater, {r6('lrt', 'lrt')}, {r6('ln', 'll_null')}, {r6('la', 'll_alt')}, 3 AS df, round({erfc_sql('x')} + sqrt(2*lrt/pi())*exp(-lrt/2),6)+0.0 AS p_value FROM ts""")
def a24_p(spark, folder):
    return rounded(G.lrt_uniform_null(cells(spark, folder), ["rater"]), 6)


def profs(spark, folder):
    return P.value_profiles(fits(spark, folder), TEMPERATURE).select("rater", "profile")


def shared_profs(spark, folder):
    """Profiles for plans that read them in several branches."""
    return materialise(profs(spark, folder), "profiles")


_SHARES = ", ".join(f"('{a}', p{i})" for i, a in enumerate(ATTRS))


@query("a25_value_profiles", with_ctes("prof") + f"SELECT rater, t.attribute, {r6('t.share', 'share')} FROM prof, LATERAL (VALUES {_SHARES}) t(attribute, share)")
def a25(spark, folder):
    return rounded(P.long_profiles(profs(spark, folder), ["rater"]), 6)


@query("p16_softmax_of_preferences", with_ctes("pref", extra="""m AS (SELECT rater, attribute, avg(value) AS v FROM pref GROUP BY ALL),
  e AS (SELECT rater, attribute, exp((v - max(v) OVER (PARTITION BY rater))/0.5) AS e FROM m)""") +
  f"SELECT rater, attribute, {r9('e/sum(e) OVER (PARTITION BY rater)', 'share')} FROM e")
def p16(spark, folder):
    pref = M.value_preference(summary(spark, folder), T.tags(spark, folder))
    return rounded(P.softmax_long(pref, ["rater"], "preference", 0.5).select("rater", "attribute", "share"))


@query("a26_jsd_matrix", with_ctes("jsdm") + f"SELECT a, b, {r6('jsd', 'jsd')} FROM jsdm")
def a26(spark, folder):
    return rounded(P.jsd_matrix(shared_profs(spark, folder)), 6)


GROUPS = ("models", "humans")


def members(df):
    group = F.when(F.col("rater").startswith("human/"), "humans").otherwise("models")
    return df.filter(F.col("rater") != CONSENSUS).select(group.alias("group"), F.col("rater").alias("member"))


@query("a27_mean_within_group", with_ctes("jsdm", "members") + f"""SELECT m.grp AS "group", {r6('avg(jsd)', 'mean_jsd')}, count(*) AS n_pairs
  FROM jsdm JOIN members m ON a=m.member JOIN members k ON b=k.member AND m.grp=k.grp GROUP BY m.grp""")
def a27(spark, folder):
    p = shared_profs(spark, folder)
    return rounded(P.mean_within_group(p, members(p)), 6)


def _subset_cells(spark, folder, name="panel"):
    pooled = SM.pool(SM.models(T.model_summary(spark, folder)), name)
    return G.design_cells(G.design_matrix(pooled, T.tags(spark, folder)), ["rater"])


_POOLM = """pm AS (SELECT case_id, 'panel' AS rater, sum(c1)::double AS c1, sum(valid)::double AS n FROM own WHERE rater NOT LIKE 'human/%' GROUP BY case_id),
  pd AS (SELECT * FROM pm JOIN wide USING (case_id) WHERE n>0)"""
_PN = newton("pfit", "pcells", ["rater"], O.XS)


@query("a28_consensus_profile", with_ctes("own", "wide", extra=_POOLM + f", pcells AS ({cells_sql('pd', 'rater')}), " + join_ctes(_PN) +
       f", pprof AS ({softmax_sql('pfit', 'rater', TEMPERATURE)})") + f"SELECT rater, t.attribute, {r6('t.share', 'share')} FROM pprof, LATERAL (VALUES {_SHARES}) t(attribute, share)")
def a28(spark, folder):
    fit = G.fit_cells(_subset_cells(spark, folder), ["rater"])
    return rounded(P.long_profiles(P.value_profiles(fit, TEMPERATURE), ["rater"]), 6)


@query("a32_interaction_weights")
def a32(spark, folder):
    full = G.interaction_weights(cells(spark, folder), ["rater"])
    return full.select("rater", "status", "penalty", F.transform("raw_beta", lambda x: R(x, 6)).alias("beta"))


def _marginal(spark, folder):
    c = cells(spark, folder)
    base = P.value_profiles(G.fit_cells(c, ["rater"]), TEMPERATURE).select("rater", F.col("profile").alias("base"))
    full = G.interaction_weights(c, ["rater"]).withColumn("beta", F.col("raw_beta"))
    marg = P.value_profiles(G.marginal_weights(full, c, ["rater"]), TEMPERATURE).select("rater", F.col("profile").alias("marginal"))
    return base.join(marg, "rater")


@query("a33_marginal_profiles")
def a33(spark, folder):
    m = _marginal(spark, folder)
    dev = F.array_max(F.zip_with("base", "marginal", lambda a, b: F.abs(a - b)))
    rnd = lambda c: F.transform(c, lambda x: R(x, 6)).alias(c)
    return m.select("rater", rnd("base"), rnd("marginal"), R(dev, 6).alias("max_deviation"))


_TAU = """pp AS (SELECT rater, t.attribute, t.share AS x, n AS y FROM prof JOIN (SELECT rater, avg(refusals::double/(valid+refusals)) AS n FROM summary GROUP BY rater)
  USING (rater), LATERAL (VALUES """ + _SHARES + """) t(attribute, share) WHERE rater<>'model/m7F' AND rater<>'human_consensus')"""


@query("a34_kendall_tau", with_ctes("prof", "summary", extra=_TAU) + f"""SELECT a.attribute,
  {r6('sum(sign(a.x-b.x)*sign(a.y-b.y))/sqrt(sum(abs(sign(a.x-b.x)))*sum(abs(sign(a.y-b.y))))', 'tau')}, count(*) AS n_pairs
  FROM pp a JOIN pp b ON a.attribute=b.attribute AND a.rater<b.rater GROUP BY a.attribute""")
def a34(spark, folder):
    """Shares against refusal rates, with one rater on the exclusion list."""
    shares = P.long_profiles(profs(spark, folder), ["rater"]).filter(F.col("rater") != "model/m7F")
    values = shares.join(M.refusal_rate(summary(spark, folder)), "rater")
    return rounded(RP.kendall_tau(values, ["attribute"], "share", "refusal_rate").select("attribute", "tau", "n_pairs"), 6)


@query("a34_base_against_marginal")
def a34_marginal(spark, folder):
    """Shares of the plain fit against those of the fit with interactions, the pooled rater left out; no SQL for the penalised fits."""
    m = _marginal(spark, folder).filter(F.col("rater") != CONSENSUS)
    names = F.array(*[F.lit(a) for a in ATTRIBUTES])
    z = m.select(F.explode(F.arrays_zip(names.alias("attribute"), F.col("base"), F.col("marginal"))).alias("z"))
    # equal to 12 digits is tied
    values = z.select("z.attribute", F.round("z.base", 12).alias("base"), F.round("z.marginal", 12).alias("marginal"))
    return rounded(RP.kendall_tau(values, ["attribute"], "base", "marginal"), 6)


_MW = """mv AS (SELECT t.attribute, rater LIKE 'model/%' AS g, round(t.share,12) AS v FROM prof, LATERAL (VALUES """ + _SHARES + """) t(attribute, share)
  WHERE rater<>'human_consensus'), mr AS (SELECT *, rank() OVER (PARTITION BY attribute ORDER BY v) + (count(*) OVER (PARTITION BY attribute, v)-1)/2.0 AS r FROM mv)"""


def _group_shares(spark, folder):
    p = shared_profs(spark, folder).filter(F.col("rater") != CONSENSUS)
    long = P.long_profiles(p, ["rater"])
    group = F.when(F.col("rater").startswith("human/"), "humans").otherwise("models")
    return long.select(group.alias("group"), F.col("rater").alias("member"), "attribute", F.round("share", 12).alias("share"))


@query("a30_mann_whitney", with_ctes("prof", extra=_MW) + """SELECT attribute, (sum(r) FILTER (g) - count(*) FILTER (g)*(count(*) FILTER (g)+1)/2.0)::double AS u,
  count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2 FROM mr GROUP BY attribute""")
def a30(spark, folder):
    return C.mann_whitney(_group_shares(spark, folder), ["attribute"], "group", "models", "share").select(
        "attribute", F.col("u").cast("double").alias("u"), "n1", "n2")


@query("a30_mann_whitney_exact")
def a30_exact(spark, folder):
    """The two groups inside each of eight panels, small enough for exact p; tests hold those against every relabelling."""
    shares = _group_shares(spark, folder).withColumn("panel", F.pmod(F.crc32(F.col("member")), F.lit(8)))
    return rounded(C.mann_whitney(shares, ["panel", "attribute"], "group", "models", "share").select("panel", "attribute", "u", "n1", "n2", "p"))


_MWP = _MW + """, ms AS (SELECT attribute, v, count(*) AS t, count(*) FILTER (g) AS k, min(r) AS r FROM mr GROUP BY ALL),
  mu AS (SELECT attribute, sum(k*r)::double AS r1, sum(k)::double AS n1, sum(t)::double AS n, sum(t::double**3-t) AS ties FROM ms GROUP BY attribute),
  mz AS (SELECT attribute, r1-n1*(n1+1)/2 AS u, n1, n-n1 AS n2, greatest(abs(r1-n1*(n1+1)/2-n1*(n-n1)/2)-0.5,0.0)/sqrt(n1*(n-n1)/12*((n+1)-ties/(n*(n-1)))) AS z FROM mu),
  mp AS (SELECT *, """ + erfc_sql("z/sqrt(2)") + """ AS p, 0.05/(SELECT count(*) FROM mz) AS bonferroni FROM mz)"""


@query("a31_significance", with_ctes("prof", extra=_MWP) + f"""SELECT attribute, {r9('u', 'u')}, {r9('z', 'z')}, n1::bigint AS n1, n2::bigint AS n2, {r9('p', 'p')}, {r9('bonferroni', 'bonferroni')},
  CASE WHEN p<bonferroni THEN 'corrected' WHEN p<0.05 THEN 'nominal' ELSE 'none' END AS significance FROM mp""")
def a31(spark, folder):
    tests = C.mann_whitney(_group_shares(spark, folder), ["attribute"], "group", "models", "share")
    return rounded(P.significance(tests))


_AGENT = """ag AS (SELECT f.rater, f.b0, f.b1, f.b2, f.b3, CASE WHEN f.rater LIKE 'human/%' THEN 'humans' ELSE 'models' END AS grp FROM fit f),
  tv AS (SELECT rater, """ + ", ".join(f"exp(avg(value) FILTER (attribute='{a}')) AS e{i}" for i, a in enumerate(ATTRS)) + """ FROM pref GROUP BY rater),
  tt AS (SELECT (10.0**(-1.5+2.5*i/49))::double AS t FROM range(50) r(i)),
  sc AS (SELECT grp, t, """ + ", ".join(f"e{i}/(e0+e1+e2+e3) AS p{i}" for i in range(4)) + ", " + \
  ", ".join(f"exp((b{i}-greatest(b0,b1,b2,b3))/t) AS q{i}" for i in range(4)) + """ FROM ag JOIN tv USING (rater), tt),
  l AS (SELECT grp, t, p0, p1, p2, p3 FROM sc), rr AS (SELECT grp, t, """ + ", ".join(f"p{i}" for i in range(4)) + ", " + \
  ", ".join(f"q{i}/(q0+q1+q2+q3) AS s{i}" for i in range(4)) + " FROM sc)"


def _agents(spark, folder):
    pref = M.value_preference(summary(spark, folder), T.tags(spark, folder))
    true = pref.groupBy("rater").agg(
        F.array(*[F.max(F.when(F.col("attribute") == a, F.col("preference"))) for a in ATTRIBUTES]).alias("v"))
    true = true.filter(~F.exists("v", lambda x: x.isNull())).select("rater", P.softmax("v").alias("weights"))
    group = F.when(F.col("rater").startswith("human/"), "humans").otherwise("models")
    return fits(spark, folder).select("rater", "beta", group.alias("group")).join(true, "rater")


TEMPS = [10.0 ** (-1.5 + 2.5 * i / 49) for i in range(50)]
_J35 = "greatest((" + "+".join(
    f"CASE WHEN p{i}>0 THEN p{i}*log2(p{i}/((p{i}+s{i})/2)) ELSE 0 END + CASE WHEN s{i}>0 THEN s{i}*log2(s{i}/((p{i}+s{i})/2)) ELSE 0 END" for i in range(4)) + ")/2, 0.0)"


@query("a35_temperature_sweep", with_ctes("fit", "pref", extra=_AGENT) + f"""SELECT grp AS "group", {r6('t', 'temperature')},
  {r6(f'avg({_J35})', 'mean_jsd')}, {r6(f'stddev_pop({_J35})', 'std_jsd')}, count(*) AS n, {r6(f'stddev_pop({_J35})/sqrt(count(*))', 'se_jsd')} FROM rr GROUP BY grp, t""")
def a35(spark, folder):
    return rounded(P.temperature_sweep(_agents(spark, folder), TEMPS, "group"), 6)


@query("a35_best_temperature", with_ctes("fit", "pref", extra=_AGENT + f", sw AS (SELECT grp, t, avg({_J35}) AS m FROM rr GROUP BY grp, t)") +
       f"""SELECT grp AS "group", {r6('min_by(t,m)', 'temperature')}, {r6('min(m)', 'mean_jsd')} FROM sw GROUP BY grp""")
def a35_best(spark, folder):
    return rounded(P.best_temperature(P.temperature_sweep(_agents(spark, folder), TEMPS, "group"), "group"), 6)


@query("k6_rating_by_divergence", with_ctes("prof") + f"SELECT a.rater, {r6(jsd_sql('a', 'b'), 'jsd')} FROM prof a, prof b WHERE b.rater='human_consensus' AND a.rater<>b.rater")
def k6(spark, folder):
    return rounded(P.to_reference(shared_profs(spark, folder), CONSENSUS), 6).orderBy("jsd", "rater")


# -- resampling -------------------------------------------------------------------------------

def draws_sql(pos: str, n_samples: int, seed: str, key: str) -> str:
    return f"""(SELECT b, {key}, count(*) AS weight FROM (SELECT s.b, {u32(f"'{seed}|' || s.b || '|' || p.pos")} % p.n AS idx
      FROM {pos} p, range({n_samples}) s(b)) d JOIN {pos} q ON q.pos=d.idx GROUP BY b, {key})"""


_DR = f"dr AS MATERIALIZED {draws_sql('positions', DRAWS, str(SEED), 'case_id')}"


@query("r1_bootstrap_draws", with_ctes("positions", extra=_DR) + "SELECT b, case_id, weight FROM dr")
def r1(spark, folder):
    d = RS.bootstrap_draws(case_positions(T.cases(spark, folder)), DRAWS, SEED)
    return d.select(F.col("b").cast("bigint").alias("b"), "case_id", "weight")


def _pref_samples(spark, folder, raters=None):
    """Samples of all raters, or of some; a rater's samples depend on its own values only."""
    values = M.value_preference_per_case(summary(spark, folder), T.tags(spark, folder))
    values = values.filter(F.col("rater").isin(*raters)) if raters else values
    return RS.bootstrap_means(values, case_positions(T.cases(spark, folder)), ["rater", "attribute"], DRAWS, SEED)


_BM = _DR + ", bm AS (SELECT rater, attribute, b, sum(weight*value)/sum(weight) AS mean FROM dr JOIN pref USING (case_id) GROUP BY ALL)"


@query("r2_bootstrap_preference", with_ctes("positions", "pref", extra=_BM) + f"SELECT rater, attribute, b, {r9('mean', 'mean')} FROM bm")
def r2(spark, folder):
    return rounded(_pref_samples(spark, folder)).withColumn("b", F.col("b").cast("bigint"))


@query("r2_bootstrap_refusal", with_ctes("positions", "own", extra=_DR) + f"""SELECT rater, b, {r9('sum(weight*refusals::double/(valid+refusals))/sum(weight)', 'mean')}
  FROM dr JOIN own USING (case_id) GROUP BY ALL""")
def r2_refusal(spark, folder):
    s = T.summary(spark, folder)
    values = s.select("case_id", "rater", (F.col("refusals") / (F.col("valid") + F.col("refusals"))).alias("value"))
    out = RS.bootstrap_means(values, case_positions(T.cases(spark, folder)), ["rater"], DRAWS, SEED)
    return rounded(out).withColumn("b", F.col("b").cast("bigint"))


@query("r2_bootstrap_agreement", with_ctes("positions", "summary", extra=_DR) + f"""SELECT b, {r9('sum(weight*(x.majority=y.majority)::int)/sum(weight)', 'mean')}
  FROM dr JOIN summary x USING (case_id) JOIN summary y USING (case_id) WHERE x.rater='model/m1F' AND y.rater='human_consensus'
  AND x.majority IS NOT NULL AND y.majority IS NOT NULL GROUP BY b""")
def r2_agreement(spark, folder):
    values = M.agreement_per_case(summary(spark, folder), "model/m1F", CONSENSUS).withColumn("k", F.lit(1))
    out = RS.bootstrap_means(values, case_positions(T.cases(spark, folder)), ["k"], DRAWS, SEED)
    return rounded(out.drop("k")).withColumn("b", F.col("b").cast("bigint"))


@query("r4_preference_intervals", with_ctes("positions", "pref", extra=_BM) + f"""SELECT rater, attribute, {r9('avg(mean)', 'mean')}, {r9('stddev_samp(mean)', 'std')},
  {r9('quantile_cont(mean,0.5)', 'median')}, {r9('quantile_cont(mean,0.025)', 'ci_low')}, {r9('quantile_cont(mean,0.975)', 'ci_high')}, count(*) AS n_samples FROM bm GROUP BY ALL""")
def r4(spark, folder):
    return rounded(RS.summarise(_pref_samples(spark, folder), ["rater", "attribute"], "mean"))


@query("r5_paired_difference", with_ctes("positions", "pref", extra=_BM) + f"""SELECT x.b, x.attribute, {r9('x.mean-y.mean', 'difference')} FROM bm x JOIN bm y
  ON x.b=y.b AND x.attribute=y.attribute WHERE x.rater='model/m1F' AND y.rater='human_consensus'""")
def r5(spark, folder):
    pair = ("model/m1F", CONSENSUS)
    d = RS.paired_difference(_pref_samples(spark, folder, pair), "rater", *pair, "mean", ["attribute"])
    return rounded(d).withColumn("b", F.col("b").cast("bigint"))


@query("r3_bootstrap_weights", None)
def r3(spark, folder):
    """Every rater at the full number of draws. No SQL fits that many; tests hold the operator against single fits."""
    fit = RS.bootstrap_weights(design(spark, folder), case_positions(T.cases(spark, folder)), DRAWS, SEED)
    names = F.array(*[F.lit(a) for a in ATTRIBUTES])
    long = fit.select("rater", F.col("b").cast("bigint").alias("b"), "status", F.explode(F.arrays_zip(names.alias("attribute"), "beta")).alias("z"))
    return rounded(long.select("rater", "b", "status", "z.attribute", "z.beta"), 6)


_MP = """mpos AS (SELECT grp, member, row_number() OVER (PARTITION BY grp ORDER BY md5(member), member)-1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM members)"""


def _side(g: str) -> str:
    return f"""(SELECT b, member, count(*) AS w FROM (SELECT s.b, {u32(f"'{SEED}|{g}|' || s.b || '|' || p.pos")} % p.n AS idx
      FROM mpos p, range({JSD_DRAWS}) s(b) WHERE p.grp='{g}') d JOIN mpos q ON q.pos=d.idx AND q.grp='{g}' GROUP BY ALL)"""


def _side_mean(g: str) -> str:
    return f"""(SELECT x.b, sum(x.w*y.w*jsd)/(SELECT any_value(n)*(any_value(n)-1)/2 FROM mpos WHERE grp='{g}') AS m
      FROM dw_{g} x JOIN jsdm ON jsdm.a=x.member JOIN dw_{g} y ON y.member=jsdm.b AND y.b=x.b GROUP BY x.b)"""


@query("r6_bootstrap_mean_jsd", with_ctes("jsdm", "members", extra=_MP + "".join(f", dw_{g} AS MATERIALIZED {_side(g)}" for g in GROUPS) +
       "".join(f", sm_{g} AS {_side_mean(g)}" for g in GROUPS)) + f"""SELECT m.b, {r6('m.m', 'mean_a')}, {r6('h.m', 'mean_b')}, {r6('m.m-h.m', 'difference')}
  FROM sm_models m JOIN sm_humans h USING (b)""")
def r6_query(spark, folder):
    p = shared_profs(spark, folder)
    out = RS.bootstrap_mean_jsd(p, members(p), GROUPS, JSD_DRAWS, SEED)
    return rounded(out, 6).withColumn("b", F.col("b").cast("bigint"))


_PERM = f"""na AS (SELECT count(*) AS k FROM members WHERE grp='models'),
  lab AS MATERIALIZED (SELECT perm, member, grp, row_number() OVER (PARTITION BY perm ORDER BY md5('{SEED}|' || perm || '|' || grp || '|' || member), grp, member)
    <= (SELECT k FROM na) AS first FROM members, range({PERMUTATIONS}) s(perm))"""
_NULL = _PERM + """, pm AS (SELECT x.perm, x.first, avg(jsd) AS m FROM jsdm JOIN lab x ON x.member=a JOIN lab y ON y.member=b AND y.perm=x.perm AND y.first=x.first GROUP BY ALL),
  nul AS (SELECT perm, abs(sum(CASE WHEN first THEN m ELSE -m END)) AS statistic FROM pm GROUP BY perm)"""


@query("r7_permutation_null", with_ctes("jsdm", "members", extra=_NULL) + f"SELECT perm, {r6('statistic', 'statistic')} FROM nul")
def r7_null(spark, folder):
    p = shared_profs(spark, folder)
    out = RS.permutation_null_jsd(p, members(p), GROUPS, PERMUTATIONS, SEED)
    return rounded(out, 6).withColumn("perm", F.col("perm").cast("bigint"))


@query("r7_permutation_test", with_ctes("jsdm", "members", extra=_NULL + """,
  ob AS (SELECT abs(sum(CASE WHEN grp='models' THEN m ELSE -m END)) AS o FROM (SELECT x.grp, avg(jsd) AS m FROM jsdm JOIN members x ON x.member=a
    JOIN members y ON y.member=b AND y.grp=x.grp GROUP BY x.grp))""") +
  f"SELECT {r6('any_value(o)', 'observed_diff')}, {r9('avg((statistic>=o-1e-12)::int)', 'p_value')}, count(*) AS n_permutations FROM nul, ob")
def r7(spark, folder):
    p = shared_profs(spark, folder)
    out = RS.permutation_test_jsd(p, members(p), GROUPS, PERMUTATIONS, SEED)
    return rounded(out, observed_diff=6, p_value=9)


@query("r9_permutation_means", with_ctes("prof", "members", extra=_PERM + """, mv AS (SELECT m.grp, m.member, t.attribute, round(t.share,12) AS share FROM prof JOIN members m ON m.member=rater,
  LATERAL (VALUES """ + _SHARES + """) t(attribute, share)),
  nd AS (SELECT perm, attribute, avg(share) FILTER (first) - avg(share) FILTER (NOT first) AS d FROM lab JOIN mv USING (grp, member) GROUP BY ALL),
  od AS (SELECT attribute, avg(share) FILTER (grp='models') - avg(share) FILTER (grp='humans') AS o FROM mv GROUP BY attribute)""") +
  f"SELECT attribute, {r6('any_value(o)', 'observed_diff')}, {r9('avg((abs(d)>=abs(o)-1e-12)::int)', 'p_value')} FROM nd JOIN od USING (attribute) GROUP BY attribute")
def r9_query(spark, folder):
    out = RS.permutation_test_means(_group_shares(spark, folder), GROUPS, PERMUTATIONS, SEED)
    return rounded(out, observed_diff=6, p_value=9)


@query("a43_null_histogram", with_ctes("jsdm", "members", extra=_NULL + """, lim AS (SELECT min(statistic) AS lo, max(statistic) AS hi FROM nul)""") +
       "SELECT least(floor((statistic-lo)/((hi-lo)/80)),79)::int AS bin, count(*) AS n FROM nul, lim GROUP BY 1")
def a43(spark, folder):
    p = shared_profs(spark, folder)
    # read three times: for both ends and the counts
    null = materialise(RS.permutation_null_jsd(p, members(p), GROUPS, PERMUTATIONS, SEED), "null")
    return RS.histogram(null, "statistic")


def _reference(spark, folder):
    c = materialise(cells(spark, folder), "cells")
    p = materialise(P.value_profiles(G.fit_cells(c, ["rater"]), TEMPERATURE).select("rater", "profile"), "profiles")
    human = F.col("rater").startswith("human/")
    panel = p.filter(human).select(F.col("rater").alias("member"))
    models = p.filter(F.col("rater").startswith("model/"))
    out = RS.panel_reference(c.filter(human), p.filter(human), panel, models, PANEL_DRAWS, SEED, TEMPERATURE)
    return materialise(out, "reference"), p


@query("r8_panel_reference", None)
def r8(spark, folder):
    return rounded(_reference(spark, folder)[0], 6).withColumn("b", F.col("b").cast("bigint"))


@query("a29_calibration", None)
def a29(spark, folder):
    reference, p = _reference(spark, folder)
    obs = P.to_reference(p, CONSENSUS).filter(F.col("rater").startswith("model/"))
    out = RS.calibration(reference, obs.select(F.col("rater").alias("id"), "jsd"))
    return rounded(out, observed_jsd=6, ci_low=6, ci_high=6, p_value=9)


@query("a29_reference_cut", None)
def a29_cut(spark, folder):
    return rounded(RS.reference_cut(_reference(spark, folder)[0]), 6)


@query("r10_sampled_pairs", f"""WITH a AS (SELECT r_name, row_number() OVER (ORDER BY md5(r_name), r_name)-1 AS pos, count(*) OVER () AS n FROM region),
  b AS (SELECT n_name, row_number() OVER (ORDER BY md5(n_name), n_name)-1 AS pos, count(*) OVER () AS n FROM nation)
  SELECT p_partkey, r_name, n_name FROM part JOIN a ON a.pos={u32("'42|first|' || p_partkey")} % a.n JOIN b ON b.pos={u32("'42|second|' || p_partkey")} % b.n""")
def r10(spark, folder):
    from panelstat.plans.positions import dense_position

    first = dense_position(T.table(spark, folder, "region"), "r_name")
    second = dense_position(T.table(spark, folder, "nation"), "n_name")
    return RS.sampled_pairs(T.table(spark, folder, "part"), "p_partkey", first, second, SEED)
