"""Scalar functions and survey import queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.operators import merge as J
from panelstat.operators import metrics as M
from panelstat.operators import review as RV
from panelstat.operators import summary as SM
from panelstat.operators import survey as SV
from panelstat.operators import validate as V
from panelstat.plans.catalog_metrics import R, r9, rounded
from panelstat.plans.oracle import CTES, entropy_sql, uuid_sql, with_ctes
from panelstat.plans.registry import query
from panelstat.sources import tables as T

AS_OF = "2026-01-01 00:00:00"
_HEX12 = "md5('doc|' || doc_id)"


# -- scalar functions -------------------------------------------------------------------------

@query("p3_binary_entropy", f"""SELECT l_linenumber AS k, l_quantity::int AS n, {r9(entropy_sql('l_linenumber', 'l_quantity::int'), 'entropy')}, count(*) AS cnt
  FROM lineitem WHERE l_linenumber<=l_quantity GROUP BY ALL""")
def p3(spark, folder):
    l = T.table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("k"), F.col("l_quantity").cast("int").alias("n"))
    cells = l.filter("k <= n").groupBy("k", "n").agg(F.count("*").alias("cnt"))
    return cells.select("k", "n", R(S.binary_entropy("k", "n"), 9).alias("entropy"), "cnt")


@query("p4_participant_id", """SELECT c_custkey, 'participant_' || substr(sha256(lower(trim(' ' || c_name)) || '|' || lower(trim(c_mktsegment || '@X.org '))),1,8) AS participant_id, true AS valid FROM customer""")
def p4(spark, folder):
    c = T.table(spark, folder, "customer")
    pid = S.participant_id(F.concat(F.lit(" "), "c_name"), F.concat("c_mktsegment", F.lit("@X.org ")))
    return c.select("c_custkey", pid.alias("participant_id")).withColumn("valid", S.valid_participant_id("participant_id"))


_HEAD = f"(CASE WHEN lang='en' THEN '  ' || upper({uuid_sql('doc_id', 'doc')}) WHEN lang='fr' THEN {uuid_sql('doc_id', 'doc')} ELSE 'Q' || doc_id END || ' - ' || text)"


def _header():
    u = T.uuid_of("doc_id", "doc")
    lead = F.when(F.col("lang") == "en", F.concat(F.lit("  "), F.upper(u))).when(F.col("lang") == "fr", u).otherwise(
        F.concat(F.lit("Q"), F.col("doc_id").cast("string")))
    return F.concat(lead, F.lit(" - "), "text")


@query("p5_case_uuid_of_header", f"""SELECT doc_id, nullif(lower(regexp_extract(trim({_HEAD}), '^([0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}})', 1)),'') AS case_id FROM documents""")
def p5(spark, folder):
    return T.table(spark, folder, "documents").select("doc_id", S.extract_case_uuid(_header()).alias("case_id"))


@query("p6_case_id_of_file", f"""SELECT doc_id, {uuid_sql('doc_id', 'doc')} AS case_id, substr({uuid_sql('doc_id', 'doc')},20,1) IN ('8','9','a','b') AS is_v4 FROM documents""")
def p6(spark, folder):
    d = T.table(spark, folder, "documents")
    name = S.case_file_name(T.uuid_of("doc_id", "doc"), F.substring(F.md5("text"), 1, 12))
    return d.select("doc_id", S.case_id_from_filename(name).alias("case_id")).withColumn("is_v4", S.is_uuid4("case_id"))


_MAIL = "(CASE WHEN c_acctbal<0 THEN c_name ELSE replace(c_name,'#','. ') END || '@ Example.ORG')"


@query("p7_normalise_email", f"""SELECT c_custkey, lower(replace({_MAIL},' ','')) AS email, c_acctbal>=0 AS valid FROM customer""")
def p7(spark, folder):
    c = T.table(spark, folder, "customer")
    raw = F.concat(F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit(". "))), F.lit("@ Example.ORG"))
    return c.select("c_custkey", S.normalise_email(raw).alias("email")).withColumn("valid", S.valid_email("email"))


_FMT = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ"]


@query("p8_parse_timestamp", """SELECT event_id, CASE WHEN event_id%7=6 THEN NULL WHEN event_id%7 IN (1,3) THEN strftime(ts,'%Y-%m-%d %H:%M:00') ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def p8(spark, folder):
    """Every accepted layout in turn, and one that is not."""
    e = T.table(spark, folder, "events")
    text = F.lit("not a time")
    for i, f in enumerate(S.TIMESTAMP_FORMATS):
        text = F.when(F.col("event_id") % 7 == i, F.date_format("ts", f)).otherwise(text)
    return e.select("event_id", F.date_format(S.parse_timestamp(F.concat(F.lit(" "), text)), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("p9_match_choice", """SELECT l_orderkey, l_returnflag, count(*) AS n, CASE l_returnflag WHEN 'A' THEN 'choice_1' WHEN 'R' THEN 'choice_2' END AS choice FROM lineitem GROUP BY ALL""")
def p9(spark, folder):
    l = T.table(spark, folder, "lineitem")
    c = S.match_choice(F.concat(F.lit(" "), "l_returnflag"), F.lit("A "), F.lit("R"))
    return l.groupBy("l_orderkey", "l_returnflag", c.alias("choice")).agg(F.count("*").alias("n"))


@query("p10_review_decisions", """SELECT word, CASE WHEN word IN ('approve','approved','yes','accept') THEN 'approve' WHEN word IN ('reject','rejected','no') THEN 'reject'
  WHEN word IN ('skip','skipped','n/a','') THEN 'skip' ELSE 'unknown' END AS decision, count(*) AS n FROM
  (SELECT unnest(string_split(lower(text),' ')) AS word FROM documents) GROUP BY ALL""")
def p10(spark, folder):
    words = T.table(spark, folder, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    # the words are compared as they are; a word that is only other white space stays unknown in both
    plain = F.regexp_replace("word", r"[^\x21-\x7E]", "x")
    return counts.select("word", F.when(F.col("word") == "", "skip").otherwise(S.normalise_review_decision(plain)).alias("decision"), "n")


def _json_sql(t: str) -> str:
    return f"""('"' || array_to_string(list_transform(string_split({t},''), lambda c: CASE WHEN c=chr(92) THEN chr(92)||chr(92) WHEN c='"' THEN chr(92)||'"' WHEN c=chr(10) THEN chr(92)||'n'
      WHEN c=chr(13) THEN chr(92)||'r' WHEN c=chr(9) THEN chr(92)||'t' WHEN c=chr(8) THEN chr(92)||'b' WHEN c=chr(12) THEN chr(92)||'f' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
      WHEN unicode(c)<65536 THEN chr(92) || printf('u%04x', unicode(c)) ELSE chr(92) || printf('u%04x', 55296+((unicode(c)-65536)//1024)) || chr(92) || printf('u%04x', 56320+((unicode(c)-65536)%1024)) END),'') || '"')"""


@query("p11_content_hash", f"""WITH j AS (SELECT doc_id, '{{"choice_1": {{"autonomy": "promotes", "choice": ' || {_json_sql("'Keep \"' || source || '\"'")} || '}}, "choice_2": {{"autonomy": "neutral", "choice": ' ||
  {_json_sql('lang')} || '}}, "vignette": ' || {_json_sql('text')} || '}}' AS doc FROM documents) SELECT doc_id, substr(sha256(doc),1,12) AS content_hash FROM j""")
def p11(spark, folder):
    d = T.table(spark, folder, "documents")
    one = {"choice": F.concat(F.lit('Keep "'), "source", F.lit('"')), "autonomy": F.lit("promotes")}
    two = {"choice": F.col("lang"), "autonomy": F.lit("neutral")}
    return d.select("doc_id", S.content_hash("text", one, two).alias("content_hash"))


@query("s7_case_file_name", f"""SELECT doc_id, 'case_' || {uuid_sql('doc_id', 'doc')} || '_' || CASE WHEN lang='en' THEN 'draft' ELSE substr(md5(text),1,12) END || '.json' AS file_name FROM documents""")
def s7(spark, folder):
    digest = F.when(F.col("lang") != "en", F.substring(F.md5("text"), 1, 12))
    return T.table(spark, folder, "documents").select("doc_id", S.case_file_name(T.uuid_of("doc_id", "doc"), digest).alias("file_name"))


@query("p12_case_text", "SELECT doc_id, text || chr(10) || chr(10) || 'Choice 1: ' || source || chr(10) || chr(10) || 'Choice 2: ' || coalesce(nullif(lang,'en'),'') AS body FROM documents")
def p12(spark, folder):
    """Option 1 as an object with text, option 2 as bare text; both read from VARIANT."""
    d = T.table(spark, folder, "documents")
    c1 = F.to_variant_object(F.struct(F.col("source").alias("choice")))
    c2 = F.parse_json(F.to_json(F.struct(F.nullif("lang", F.lit("en")).alias("v"))))
    v = d.select("doc_id", "text", c1.alias("c1"), F.try_variant_get(c2, "$.v", "variant").alias("c2"))
    return v.select("doc_id", S.case_text("text", S.option_text("c1"), S.option_text("c2")).alias("body"))


@query("p13_display_names", with_ctes("summary") + """SELECT DISTINCT rater, CASE WHEN rater='human_consensus' THEN 'Panel' WHEN rater='model/m1F' THEN 'First model' WHEN rater LIKE 'human/%' THEN 'Rater ' || upper(substr(rater,19,4))
  ELSE split_part(rater,'/',2) END AS label, replace(rater,'/','-') AS slug FROM summary""")
def p13(spark, folder):
    from panelstat.plans.catalog_metrics import summary

    raters = summary(spark, folder).select("rater").distinct()
    labels = {"human_consensus": "Panel", "m1F": "First model"}
    return raters.select("rater", S.display_name("rater", labels, "Rater").alias("label"), S.rater_slug("rater").alias("slug"))


@query("p14_label_helpers", "SELECT doc_id, CASE WHEN length(text)>150 THEN substr(text,1,150) || '...' ELSE text END AS preview, coalesce(nullif(lang,'fr'),'N/A') || ' vs ' || source AS pair, trunc(n_chars/700.0::double*100)::int AS pct FROM documents")
def p14(spark, folder):
    d = T.table(spark, folder, "documents")
    return d.select("doc_id", S.preview("text", 150).alias("preview"), S.pair_label(F.nullif("lang", F.lit("fr")), "source").alias("pair"),
                    S.similarity_pct(F.col("n_chars") / 700.0).alias("pct"))


@query("p15_prompt_text", "SELECT doc_id, 'Case: ' || text || ' / 1) ' || source || ' / 2) ' || lang AS prompt FROM documents")
def p15(spark, folder):
    d = T.table(spark, folder, "documents").withColumn("template", F.lit("Case: {vignette} / 1) {choice_1} / 2) {choice_2}"))
    return d.select("doc_id", S.prompt_text("template", "text", "source", "lang").alias("prompt"))


def _payloads(spark, folder):
    c = T.table(spark, folder, "conversations")
    message = F.struct(F.struct(F.nullif("text", F.lit("")).alias("content")).alias("message"))
    body = F.struct(
        F.when(F.col("role") == "assistant", F.array(message)).alias("choices"), F.lit("m/x").alias("model"),
        (F.col("conv_id") * 10 + F.col("turn")).alias("created"),
        F.struct(F.length("text").alias("total_tokens"), (F.col("turn") / 4).alias("cost")).alias("usage"))
    return c.select("conv_id", "turn", "role", F.parse_json(F.to_json(body)).alias("full_response"))


@query("p17_response_text", "SELECT conv_id, turn, CASE WHEN role='assistant' THEN text ELSE '' END AS body, 'm/x' AS model, conv_id*10+turn AS created, length(text) AS total_tokens, turn/4.0::double AS cost FROM conversations")
def p17(spark, folder):
    p = _payloads(spark, folder)
    return p.select("conv_id", "turn", S.response_text("full_response").alias("body"), *S.response_meta("full_response"))


@query("p19_change_keys", "SELECT a.doc_id, trim(a.text)<>trim(b.text) OR a.lang<>b.lang AS content, lower(a.source)<>lower(b.source) AS reviewers FROM documents a JOIN documents b ON b.doc_id=a.doc_id+1")
def p19(spark, folder):
    d = T.table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.concat(F.lit(" "), "text").alias("text2"), F.col("lang").alias("lang2"), F.upper("source").alias("source2"))
    j = d.join(nxt, "doc_id").withColumn("none", F.lit(None).cast("string"))
    return j.select("doc_id", RV.content_changed(["text", "lang"], ["text2", "lang2"]).alias("content"),
                    RV.reviewers_changed(["source"], ["source2"], "none", "none").alias("reviewers"))


@query("p20_human_payload", with_ctes("responses") + "SELECT event_id, participant_id, parsed_choice AS body, strftime(ts,'%Y-%m-%dT%H:%M:%S') AS at, epoch(ts)::bigint - (CASE WHEN epoch(ts)::bigint>epoch(ts) THEN 1 ELSE 0 END) AS created FROM responses")
def p20(spark, folder):
    r = T.responses(spark, folder)
    payload = F.to_variant_object(S.human_payload("participant_id", F.lit("n"), F.lit(""), "parsed_choice", "ts"))
    v = r.select("event_id", payload.alias("v"))
    get = lambda f, t: F.variant_get("v", f"$.{f}", t)
    return v.select("event_id", get("participant_id", "string").alias("participant_id"), get("response_text", "string").alias("body"),
                    get("timestamp", "string").alias("at"), get("created", "bigint").alias("created"))


@query("v8_participant_id_format", """SELECT c_custkey, c_acctbal>=0 AS valid FROM customer""")
def v8(spark, folder):
    c = T.table(spark, folder, "customer")
    h = F.substring(F.md5("c_name"), 1, 8)
    pid = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("participant_"), h)).otherwise(F.concat(F.lit("person_"), h, F.lit("00000")))
    return c.select("c_custkey", S.valid_participant_id(pid).alias("valid"))


# -- survey -----------------------------------------------------------------------------------

LINES = list(range(1, 8))


def survey_cases(spark, folder):
    """One case per line number that occurs, but for the last one, which nobody defined."""
    n = T.table(spark, folder, "lineitem").select("l_linenumber").distinct()
    return n.filter("l_linenumber < 7").select(F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("case_id"),
                                               F.lit("Accept").alias("choice_1"), F.lit("Return ").alias("choice_2"))


def survey_rows(spark, folder):
    """A wide survey: one row per order, one column per line number."""
    l = T.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(*[
        F.max(F.when(F.col("l_linenumber") == n, F.col("l_returnflag"))).alias(f"line_{n}") for n in LINES])
    o = T.table(spark, folder, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cust = F.col("o_custkey").cast("string")
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    mail = F.when(price < 20000, F.concat(F.lit("c"), cust, F.lit("(at)example"))).when(
        status == "P", F.concat(F.lit("C"), cust, F.lit(" @example.org"))).otherwise(F.concat(F.lit("C"), cust, F.lit("@example.org")))
    when = F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(
        status == "O", F.date_format("o_orderdate", "MM/dd/yyyy HH:mm")).when(price > 300000, "").when(
        price > 200000, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    cell = lambda n: F.when(F.col(f"line_{n}") == "A", " Accept").when(F.col(f"line_{n}") == "R", "Return").when(
        F.col(f"line_{n}") == "N", "Neither").otherwise("").alias(f"line_{n}")
    return o.select(
        F.col("o_orderkey").alias("row"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise(F.concat(F.lit("Customer "), cust)).alias("name"),
        mail.alias("email"), F.when(price > 250000, F.col("o_orderpriority")).otherwise("").alias("expertise"), when.alias("recorded"),
        *[cell(n) for n in LINES])


CTES["wrows"] = ([], """SELECT o_orderkey AS "row", CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN '' ELSE 'Customer ' || o_custkey END AS name,
  CASE WHEN o_totalprice<20000 THEN 'c' || o_custkey || '(at)example' WHEN o_orderstatus='P' THEN 'C' || o_custkey || ' @example.org' ELSE 'C' || o_custkey || '@example.org' END AS given,
  CASE WHEN o_totalprice>250000 THEN o_orderpriority ELSE '' END AS expertise, CASE WHEN o_orderstatus IN ('F','O') THEN '' WHEN o_totalprice>300000 THEN 'empty' WHEN o_totalprice>200000 THEN 'bad' ELSE '' END AS when_kind,
  o_orderdate, """ + ", ".join(f"(SELECT max(l_returnflag) FROM lineitem WHERE l_orderkey=o_orderkey AND l_linenumber={n}) AS line_{n}" for n in LINES) + " FROM orders")
CTES["wpeople"] = (["wrows"], f"""SELECT *, replace(given,' ','') AS email, CASE WHEN name='' THEN 'incomplete' WHEN given LIKE '%(at)%' THEN 'email' END AS problem,
  CASE WHEN when_kind='' THEN o_orderdate ELSE TIMESTAMP '{AS_OF}' END AS ts,
  'participant_' || substr(sha256(lower(name) || '|' || lower(replace(given,' ',''))),1,8) AS participant_id FROM wrows""")
CTES["wlong"] = (["wpeople"], """SELECT "row", participant_id, ts, case_id, CASE flag WHEN 'A' THEN 'Accept' WHEN 'R' THEN 'Return' ELSE 'Neither' END AS response_text FROM
  (UNPIVOT (SELECT "row", participant_id, ts, """ + ", ".join(f"line_{n}" for n in LINES) + """ FROM wpeople WHERE problem IS NULL) ON """ + ", ".join(f"line_{n}" for n in LINES) + " INTO NAME case_id VALUE flag)")
CTES["wchoice"] = (["wlong"], """SELECT *, CASE WHEN case_id='line_7' THEN NULL WHEN response_text='Accept' THEN 'choice_1' WHEN response_text='Return' THEN 'choice_2' END AS selected_choice FROM wlong""")


def survey(spark, folder):
    return SV.parse_survey(survey_rows(spark, folder), [f"line_{n}" for n in LINES], survey_cases(spark, folder), AS_OF)


@query("x1_unpivot_responses", "SELECT \"row\", case_id, CASE flag WHEN 'A' THEN 'Accept' WHEN 'R' THEN 'Return' ELSE 'Neither' END AS response_text FROM " +
       "(SELECT l_orderkey AS \"row\", 'line_' || l_linenumber AS case_id, max(l_returnflag) AS flag FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY ALL)")
def x1(spark, folder):
    return SV.unpivot_responses(survey_rows(spark, folder), ["row"], [f"line_{n}" for n in LINES])


@query("x2_survey_responses", with_ctes("wchoice") + """SELECT "row", case_id, participant_id, selected_choice, response_text, strftime(ts,'%Y-%m-%d %H:%M:%S') AS at FROM wchoice WHERE selected_choice IS NOT NULL""")
def x2(spark, folder):
    r = survey(spark, folder).responses
    return r.select("row", "case_id", "participant_id", "selected_choice", "response_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("x2_survey_unmatched", with_ctes("wchoice") + "SELECT case_id, participant_id, response_text FROM wchoice WHERE selected_choice IS NULL")
def x2_unmatched(spark, folder):
    return survey(spark, folder).unmatched


@query("x2_survey_participants", with_ctes("wpeople") + """SELECT participant_id, min_by(name,"row") AS name, lower(min_by(email,"row")) AS email,
  coalesce(min_by(expertise,"row") FILTER (expertise<>''),'') AS expertise, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_seen
  FROM wpeople WHERE problem IS NULL GROUP BY participant_id""")
def x2_participants(spark, folder):
    p = survey(spark, folder).participants
    return p.select("participant_id", "name", "email", "expertise", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")])


_BLANKS = "+".join(f"(line_{n} IS NULL)::int" for n in LINES)
_WARN = f"""wk AS (SELECT 'Emails with spaces' AS kind FROM wpeople WHERE given<>email UNION ALL SELECT 'Missing participant data' FROM wpeople WHERE problem='incomplete'
  UNION ALL SELECT 'Timestamp parsing issues' FROM wpeople WHERE when_kind<>'' AND coalesce(problem,'')<>'incomplete' UNION ALL SELECT 'Invalid email formats' FROM wpeople WHERE problem='email'
  UNION ALL SELECT 'Empty responses' FROM wpeople WHERE problem IS NULL AND ({_BLANKS}) BETWEEN 1 AND 6
  UNION ALL SELECT 'Missing case files' FROM wchoice WHERE case_id='line_7' UNION ALL SELECT 'Unmatched responses' FROM wchoice WHERE case_id<>'line_7' AND selected_choice IS NULL)"""


@query("a42_warning_histogram", with_ctes("wpeople", "wchoice", extra=_WARN) + "SELECT kind, count(*) AS n FROM wk GROUP BY kind")
def a42(spark, folder):
    return SV.warning_histogram(survey(spark, folder).warnings, top=None)


@query("a42_top_warnings", with_ctes("wpeople", "wchoice", extra=_WARN) + "SELECT kind, count(*) AS n FROM wk GROUP BY kind ORDER BY n DESC, kind LIMIT 5")
def a42_top(spark, folder):
    return SV.warning_histogram(survey(spark, folder).warnings)


@query("x2_strict_errors", with_ctes("wpeople", "wchoice") + """SELECT "row" FROM wpeople WHERE problem='email' UNION ALL SELECT "row" FROM wchoice WHERE selected_choice IS NULL""")
def x2_errors(spark, folder):
    return survey(spark, folder).errors.select("row")


_PART = """pi AS (SELECT 'participant_' || substr(sha256(lower(trim(name)) || '|' || lower(trim(email))),1,8) AS participant_id, name, email,
  CASE WHEN event_type='signup' THEN 'topic ' || case_key ELSE '' END AS expertise, ts, event_id FROM ev),
  pa AS (SELECT participant_id, min_by(name, event_id) AS name, min_by(email, event_id) AS email, coalesce(min_by(expertise, event_id) FILTER (expertise<>''),'') AS expertise, min(ts) AS f, max(ts) AS l FROM pi GROUP BY participant_id)"""


def participants(spark, folder):
    return SV.merge_participants(T.participants_input(spark, folder).withColumnRenamed("event_id", "seq"))


@query("a41_participants", with_ctes("ev", extra=_PART) + "SELECT participant_id, name, email, expertise, strftime(f,'%Y-%m-%d %H:%M:%S') AS first_seen, strftime(l,'%Y-%m-%d %H:%M:%S') AS last_seen FROM pa")
def a41(spark, folder):
    p = participants(spark, folder)
    return p.select("participant_id", "name", "email", "expertise", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")])


@query("a41_registry_upsert", with_ctes("ev", extra=_PART) + """SELECT participant_id, name, email, expertise, strftime(f,'%Y-%m-%d %H:%M:%S') AS first_seen, strftime(l,'%Y-%m-%d %H:%M:%S') AS last_seen FROM pa""")
def a41_upsert(spark, folder):
    """People seen by clicks and views first, everybody else afterwards: the same registry as at once."""
    seen = T.participants_input(spark, folder).withColumnRenamed("event_id", "seq")
    cols = ["participant_id", "name", "email", "expertise", "ts", "seq"]
    early = SV.merge_participants(seen.select(*cols).filter("expertise = ''"))
    late = SV.merge_participants(seen.select(*cols).filter("expertise <> ''"))
    p = SV.upsert_registry(early, late)
    return p.select("participant_id", "name", "email", "expertise", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")])


@query("a45_import_statistics", with_ctes("latest", "cases", "ev", extra=_PART + """, st AS (SELECT participant_id FROM pi WHERE expertise LIKE 'topic 1%')""") + """SELECT count(DISTINCT latest.case_id) AS cases_updated, count(*) AS responses_saved,
  (SELECT count(*) FROM pa WHERE participant_id NOT IN (FROM st)) AS participants_added FROM latest JOIN cases USING (case_id)""")
def a45(spark, folder):
    stored = T.participants_input(spark, folder).filter(F.col("expertise").startswith("topic 1")).select("participant_id").distinct()
    return SV.import_statistics(J.latest_responses(T.responses(spark, folder)), T.cases(spark, folder), participants(spark, folder), stored)


@query("j13_response_facts", with_ctes("latest", "cases") + "SELECT case_id, participant_id, parsed_choice, vignette FROM latest JOIN cases USING (case_id)")
def j13(spark, folder):
    f = J.response_facts(J.latest_responses(T.responses(spark, folder)), T.cases(spark, folder), participants(spark, folder))
    return f.select("case_id", "participant_id", "parsed_choice", "vignette")
