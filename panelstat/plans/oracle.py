"""Shared pieces of the reference SQL: the logical tables as common table expressions."""

from __future__ import annotations


def uuid_sql(key: str, label: str = "case") -> str:
    h = f"md5('{label}|' || {key})"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-4' || substr({h},14,3) || '-' || "
        f"substr({h},17,4) || '-' || substr({h},21,12))"
    )


def u32(expr: str) -> str:
    return f"('0x' || substr(md5({expr}),1,8))::bigint"


def entropy_sql(k: str, n: str) -> str:
    p = f"({k}::double/{n})"
    return (
        f"CASE WHEN {n}=0 OR {k}=0 OR {k}={n} THEN 0.0 "
        f"ELSE -({p}*log2({p}) + (1-{p})*log2(1-{p})) END"
    )


def _tag(k: int) -> str:
    h = f"substr(md5('tag|' || p_partkey), i*8+{4 * k - 3}, 4)"
    return f"CASE ('0x' || {h})::int % 3 WHEN 0 THEN 'promotes' WHEN 1 THEN 'violates' ELSE 'neutral' END"


def _align(t: str) -> str:
    return f"CASE {t} WHEN 'promotes' THEN 1 WHEN 'violates' THEN -1 ELSE 0 END"


def _summary(src: str) -> str:
    return f"""SELECT case_id, rater, c1, c2, refusals, runs_completed, c1+c2 AS valid,
      CASE WHEN c1+c2=0 THEN NULL WHEN c1>=c2 THEN 'choice_1' ELSE 'choice_2' END AS majority,
      c1::double/nullif(c1+c2,0) AS p1, greatest(c1,c2)::double/nullif(c1+c2,0) AS majority_probability,
      CASE WHEN c1+c2>0 THEN {entropy_sql('c1', '(c1+c2)')} END AS entropy FROM {src}"""


CTES: dict[str, tuple[list[str], str]] = {
    "cases": ([], f"""SELECT {uuid_sql('p_partkey')} AS case_id, p_name || ' ' || p_type AS vignette,
      'Take ' || p_brand AS choice_1, 'Leave ' || p_brand AS choice_2 FROM part"""),
    "raw_tags": ([], f"""SELECT {uuid_sql('p_partkey')} AS case_id, attribute,
      {_tag(1)} AS tag_1, {_tag(2)} AS tag_2
      FROM part, (VALUES (0,'autonomy'),(1,'beneficence'),(2,'nonmaleficence'),(3,'justice')) a(i, attribute)"""),
    "tags": (["raw_tags"], f"""SELECT *, {_align('tag_1')} AS align_1, {_align('tag_2')} AS align_2,
      {_align('tag_1')} - {_align('tag_2')} AS delta FROM raw_tags"""),
    "model_runs": ([], f"""SELECT {uuid_sql('l_partkey')} AS case_id,
      'model/m' || l_linenumber || l_linestatus AS rater,
      CASE l_returnflag WHEN 'A' THEN 'choice_1' WHEN 'R' THEN 'choice_2' ELSE 'REFUSAL' END AS parsed_choice
      FROM lineitem"""),
    "ev": ([], """SELECT *, 'User ' || user_id AS name, 'u' || user_id || '@example.org' AS email,
      event_id % (SELECT count(*) FROM part) AS case_key FROM events"""),
    "responses": (["ev"], f"""SELECT {uuid_sql('case_key')} AS case_id,
      'participant_' || substr(sha256(lower(trim(name)) || '|' || lower(trim(email))),1,8) AS participant_id,
      CASE WHEN event_type IN ('click','purchase') THEN 'choice_1'
           WHEN event_type IN ('view','signup') THEN 'choice_2' ELSE 'REFUSAL' END AS parsed_choice,
      ts, event_id FROM ev"""),
    "latest": (["responses"], """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
      (PARTITION BY case_id, participant_id ORDER BY ts DESC, event_id DESC) AS rn FROM responses) WHERE rn=1"""),
    "runs": (["model_runs", "latest"], """SELECT * FROM model_runs UNION ALL
      SELECT case_id, 'human/' || participant_id, parsed_choice FROM latest"""),
    "counts": (["runs"], """SELECT case_id, rater, count(*) FILTER (parsed_choice='choice_1') AS c1,
      count(*) FILTER (parsed_choice='choice_2') AS c2, count(*) FILTER (parsed_choice='REFUSAL') AS refusals,
      count(*) AS runs_completed FROM runs GROUP BY ALL"""),
    "own": (["counts"], _summary("counts")),
    "pooled": (["counts"], """SELECT case_id, 'human_consensus' AS rater, sum(c1)::bigint AS c1, sum(c2)::bigint AS c2,
      sum(refusals)::bigint AS refusals, sum(runs_completed)::bigint AS runs_completed
      FROM counts WHERE rater LIKE 'human/%' GROUP BY case_id"""),
    "consensus": (["pooled"], f"""SELECT * REPLACE (CASE WHEN c1>c2 THEN 'choice_1' WHEN c2>c1 THEN 'choice_2' END AS majority)
      FROM ({_summary('pooled')})"""),
    "summary": (["own", "consensus"], "SELECT * FROM own UNION ALL SELECT * FROM consensus"),
    "pref": (["summary", "tags"], """SELECT case_id, rater, attribute, (c1*align_1 + c2*align_2)::double/valid AS value
      FROM summary JOIN tags USING (case_id) WHERE valid>0 AND (align_1<>0 OR align_2<>0)"""),
    "tension": (["tags"], """SELECT a.case_id, a.attribute AS x, b.attribute AS y FROM tags a JOIN tags b
      ON a.case_id=b.case_id AND a.attribute<b.attribute AND a.delta*b.delta<0"""),
    "positions": (["cases"], """SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS pos,
      count(*) OVER () AS n FROM cases"""),
    "models14": ([], """SELECT 'model/m' || n || s AS rater FROM range(1,8) t(n), (VALUES ('F'),('O')) u(s)"""),
    "grid": (["cases", "models14", "summary"], """SELECT c.case_id, r.rater, s.entropy FROM cases c
      CROSS JOIN (SELECT rater FROM models14 UNION ALL SELECT 'human_consensus') r
      LEFT JOIN summary s ON s.case_id=c.case_id AND s.rater=r.rater"""),
}


def with_ctes(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named tables and everything they need, in order."""
    done: list[str] = []

    def visit(n: str):
        for d in CTES[n][0]:
            visit(d)
        if n not in done:
            done.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in done]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


# Regression in SQL: a fixed number of Newton steps, each one aggregate and one 4x4 solve.
ATTRS = ["autonomy", "beneficence", "nonmaleficence", "justice"]
PI = "3.141592653589793"

CTES["wide"] = (["tags"], "SELECT case_id, " + ", ".join(
    f"max(delta) FILTER (attribute='{a}')::double AS x{i}" for i, a in enumerate(ATTRS)) + " FROM tags GROUP BY case_id")
CTES["design"] = (["summary", "wide"], """SELECT s.case_id, s.rater, x0, x1, x2, x3, s.c1::double AS c1,
  s.valid::double AS n, s.p1 FROM summary s JOIN wide w USING (case_id) WHERE s.valid>0""")


def cells_sql(src: str, keys: str, weight: str = "1") -> str:
    inside = "(c1>0 AND c1<n)"
    y = "(c1/n)"
    return f"""SELECT {keys}, x0, x1, x2, x3, sum({weight}*n) AS trials, sum({weight}*c1) AS successes, sum({weight}*n*{y}*{y}) AS squares,
      sum(CASE WHEN {inside} THEN -{weight}*n*ln({PI}*{y}*(1-{y})/sin({PI}*{y})) ELSE 0 END) AS binomial,
      sum(CASE WHEN {inside} THEN {weight}*n*({y}*ln({y})+(1-{y})*ln(1-{y})) ELSE 0 END) AS saturated,
      sum({weight})::bigint AS n_cases FROM {src} GROUP BY ALL"""


CTES["cells"] = (["design"], cells_sql("design", "rater"))


def newton(name: str, cells: str, keys: list[str], xs: list[str], steps: int = 9) -> list[tuple[str, str]]:
    """CTEs ``name_<i>`` ending in ``name``: keys, b0..bk after Newton steps from zero."""
    k = len(xs)
    key = ", ".join(keys)
    out = [(f"{name}_0", f"SELECT DISTINCT {key}, " + ", ".join(f"0.0::double AS b{i}" for i in range(k)) + f" FROM {cells}")]
    eta = "+".join(f"b{i}*{x}" for i, x in enumerate(xs))
    for s in range(1, steps + 1):
        h = ", ".join(f"sum(trials*mu*(1-mu)*{xs[i]}*{xs[j]}) AS h{i}{j}" for i in range(k) for j in range(i, k))
        g = ", ".join(f"sum((successes-trials*mu)*{xs[i]}) AS g{i}" for i in range(k))
        bs = ", ".join(f"b{i}" for i in range(k))
        sums = f"SELECT {key}, {bs}, {h}, {g} FROM (SELECT *, 1/(1+exp(-({eta}))) AS mu FROM {cells} JOIN {name}_{s-1} USING ({key})) GROUP BY {key}, {bs}"
        # elimination without pivoting: the information matrix is positive definite
        a = {(i, j): f"h{min(i,j)}{max(i,j)}" for i in range(k) for j in range(k)}
        r = {i: f"g{i}" for i in range(k)}
        steps_sql = []
        for p in range(k):
            for i in range(p + 1, k):
                f = f"f_{p}_{i}"
                steps_sql.append(f"{a[i, p]}/{a[p, p]} AS {f}")
                for j in range(p + 1, k):
                    n = f"a_{p}_{i}_{j}"
                    steps_sql.append(f"{a[i, j]}-{f}*{a[p, j]} AS {n}")
                    a[i, j] = n
                n = f"r_{p}_{i}"
                steps_sql.append(f"{r[i]}-{f}*{r[p]} AS {n}")
                r[i] = n
        for i in reversed(range(k)):
            tail = "".join(f"-{a[i, j]}*z{j}" for j in range(i + 1, k))
            steps_sql.append(f"({r[i]}{tail})/{a[i, i]} AS z{i}")
        new = ", ".join(f"b{i}+z{i} AS b{i}" for i in range(k))
        out.append((f"{name}_{s}", f"SELECT {key}, {new} FROM (SELECT *, {', '.join(steps_sql)} FROM ({sums}))"))
    out.append((name, f"SELECT * FROM {name}_{steps}"))
    return out


def join_ctes(parts: list[tuple[str, str]]) -> str:
    return ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in parts)


XS = ["x0", "x1", "x2", "x3"]
_FIT = newton("fit", "cells", ["rater"], XS)
for _i, (_n, _q) in enumerate(_FIT):
    CTES[_n] = (["cells"] if _i == 0 else [_FIT[_i - 1][0], "cells"], _q)
_FIT1 = newton("fit1", "cells", ["rater"], ["(x0+x1+x2+x3)"])
for _i, (_n, _q) in enumerate(_FIT1):
    CTES[_n] = (["cells"] if _i == 0 else [_FIT1[_i - 1][0], "cells"], _q)


def softmax_sql(src: str, keys: str, t: float) -> str:
    e = [f"exp((b{i}-greatest(b0,b1,b2,b3))/{t})" for i in range(4)]
    tot = "(" + "+".join(e) + ")"
    return f"SELECT {keys}, " + ", ".join(f"{e[i]}/{tot} AS p{i}" for i in range(4)) + f" FROM {src}"


def jsd_sql(p: str, q: str) -> str:
    terms = []
    for i in range(4):
        a, b = f"{p}.p{i}", f"{q}.p{i}"
        m = f"(({a}+{b})/2)"
        terms.append(f"CASE WHEN {a}>0 THEN {a}*log2({a}/{m}) ELSE 0 END + CASE WHEN {b}>0 THEN {b}*log2({b}/{m}) ELSE 0 END")
    return "greatest((" + "+".join(terms) + ")/2, 0.0)"


CTES["prof"] = (["fit"], softmax_sql("fit", "rater", 0.262))
CTES["jsdm"] = (["prof"], f"SELECT a.rater AS a, b.rater AS b, {jsd_sql('a', 'b')} AS jsd FROM prof a JOIN prof b ON a.rater<b.rater")
CTES["members"] = (["prof"], """SELECT CASE WHEN rater LIKE 'human/%' THEN 'humans' ELSE 'models' END AS grp, rater AS member
  FROM prof WHERE rater<>'human_consensus'""")


def inverse_steps(k: int = 4) -> tuple[list[str], dict]:
    """Select items that invert the symmetric matrix h<i><j>, and the names of the inverse's entries."""
    a = {(i, j): f"h{min(i, j)}{max(i, j)}" for i in range(k) for j in range(k)}
    rhs = {(i, c): "1.0" if i == c else "0.0" for i in range(k) for c in range(k)}
    steps = []

    def put(name, expr):
        steps.append(f"{expr} AS {name}")
        return name

    for p in range(k):
        for i in range(p + 1, k):
            f = put(f"f_{p}_{i}", f"{a[i, p]}/{a[p, p]}")
            for j in range(p + 1, k):
                a[i, j] = put(f"a_{p}_{i}_{j}", f"{a[i, j]}-{f}*{a[p, j]}")
            for c in range(k):
                rhs[i, c] = put(f"r_{p}_{i}_{c}", f"{rhs[i, c]}-{f}*{rhs[p, c]}")
    inv = {}
    for i in reversed(range(k)):
        for c in range(k):
            tail = "".join(f"-{a[i, j]}*{inv[j, c]}" for j in range(i + 1, k))
            inv[i, c] = put(f"v{i}{c}", f"({rhs[i, c]}{tail})/{a[i, i]}")
    return steps, inv


_MU = "1/(1+exp(-(" + "+".join(f"b{i}*x{i}" for i in range(4)) + ")))"
_UP = [(i, j) for i in range(4) for j in range(i, 4)]
_STEPS, _INV = inverse_steps()
CTES["invs"] = (["cells", "fit"], f"""SELECT rater, b0, b1, b2, b3, {', '.join(f'v{i}{j}' for i in range(4) for j in range(4))} FROM (SELECT *, {', '.join(_STEPS)} FROM
  (SELECT rater, b0, b1, b2, b3, {', '.join(f'sum(trials*mu*(1-mu)*x{i}*x{j}) AS h{i}{j}' for i, j in _UP)} FROM (SELECT *, {_MU} AS mu FROM cells JOIN fit USING (rater)) GROUP BY ALL))""")


def _errors(src: str, weight: str) -> str:
    m = ", ".join(f"sum({weight}*x{i}*x{j}) AS m{i}{j}" for i, j in _UP)
    var = lambda a: "+".join(f"v{a}{i}*m{min(i, j)}{max(i, j)}*v{j}{a}" for i in range(4) for j in range(4))
    return f"SELECT rater, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(4))}, " + ", ".join(
        f"sqrt({var(a)}) AS e{a}" for a in range(4)) + f""" FROM (SELECT rater, {m} FROM {src} GROUP BY rater) JOIN invs USING (rater)
      GROUP BY rater, {', '.join(f'v{i}{j}' for i in range(4) for j in range(4))}, {', '.join(f'm{i}{j}' for i, j in _UP)}"""


CTES["sand"] = (["invs"], _errors(f"(SELECT *, {_MU} AS mu FROM cells JOIN fit USING (rater))", "(squares-2*mu*successes+mu*mu*trials)"))
_QUAD = "+".join(f"x{i}*x{j}*v{i}{j}" for i in range(4) for j in range(4))
CTES["lev"] = (["invs", "design"], _errors(
    f"(SELECT *, n*(c1/n-mu)/(1-n*mu*(1-mu)*({_QUAD})) AS g FROM (SELECT *, {_MU} AS mu FROM design JOIN invs USING (rater)))", "g*g"))
