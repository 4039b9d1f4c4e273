"""The logical tables, read from a folder of parquet tables.

`part` holds the cases, `lineitem` the model runs, `events` the human responses, `documents` with
`labels` the review rows, `embeddings` the case vectors and `conversations` the raw answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.plans.gram import shuffle_partitions
from panelstat.schema import ATTRIBUTES, HUMAN_PREFIX

MODELS = [f"model/m{n}{s}" for n in range(1, 8) for s in ("F", "O")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def uuid_of(key, label: str = "case"):
    """A UUID-shaped id from a numeric key.

    Never NULL: a nullable expression would be evaluated once more per input row, for the null check
    that a join pushes down to the scan.
    """
    h = F.md5(F.concat(F.lit(label + "|"), F.col(key).cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    text = F.concat(
        part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), part(17, 4),
        F.lit("-"), part(21, 12),
    )
    return F.coalesce(text, F.lit(""))


def cases(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        uuid_of("p_partkey").alias("case_id"),
        F.concat_ws(" ", "p_name", "p_type").alias("vignette"),
        F.concat(F.lit("Take "), "p_brand").alias("choice_1"),
        F.concat(F.lit("Leave "), "p_brand").alias("choice_2"),
    )


def tags(spark, folder) -> DataFrame:
    """One row per (case, attribute): both tags, both alignments and their difference."""
    digest = F.md5(F.concat(F.lit("tag|"), F.col("p_partkey").cast("string")))
    long = table(spark, folder, "part").select(uuid_of("p_partkey").alias("case_id"), digest.alias("h")).select(
        "case_id", "h", F.posexplode(F.array(*[F.lit(a) for a in ATTRIBUTES])).alias("i", "attribute")
    )

    def tag(option: int):
        v = F.conv(F.substr("h", F.col("i") * 8 + (4 * option - 3), F.lit(4)), 16, 10).cast("int") % 3
        return F.when(v == 0, "promotes").when(v == 1, "violates").otherwise("neutral")

    tagged = long.select("case_id", "attribute", tag(1).alias("tag_1"), tag(2).alias("tag_2"))
    return tagged.select(
        "*", S.align("tag_1").alias("align_1"), S.align("tag_2").alias("align_2")
    ).withColumn("delta", F.col("align_1") - F.col("align_2"))


def _model_choices(spark, folder) -> DataFrame:
    flag = F.col("l_returnflag")
    choice = F.when(flag == "A", "choice_1").when(flag == "R", "choice_2").otherwise("REFUSAL")
    return table(spark, folder, "lineitem").select("l_partkey", "l_linenumber", "l_linestatus", choice.alias("parsed_choice"))


def _model_ids():
    rater = F.concat(F.lit("model/m"), F.col("l_linenumber").cast("string"), "l_linestatus")
    return [uuid_of("l_partkey").alias("case_id"), F.coalesce(rater, F.lit("")).alias("rater")]


def model_runs(spark, folder) -> DataFrame:
    return _model_choices(spark, folder).select(*_model_ids(), "parsed_choice")


def events(spark, folder) -> DataFrame:
    """Events with the person behind each and the case it is about."""
    e = table(spark, folder, "events")
    # every event is about one of the existing cases
    n = table(spark, folder, "part").agg(F.count("*")).scalar()
    return e.select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_id") % n).alias("case_key"))


def _name():
    return F.concat(F.lit("User "), F.col("user_id").cast("string"))


def _email():
    return F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org"))


def _event_choice():
    kind = F.col("event_type")
    return F.when(kind.isin("click", "purchase"), "choice_1").when(kind.isin("view", "signup"), "choice_2").otherwise("REFUSAL")


def responses(spark, folder) -> DataFrame:
    """All human responses, repeats included: the input of the upsert."""
    return events(spark, folder).select(
        uuid_of("case_key").alias("case_id"), S.participant_id(_name(), _email()).alias("participant_id"),
        _event_choice().alias("parsed_choice"), "ts", "event_id",
    )


def _latest_choices(spark, folder) -> DataFrame:
    from panelstat.operators.merge import latest_responses

    numbered = events(spark, folder).select("case_key", "user_id", _event_choice().alias("parsed_choice"), "ts", "event_id")
    return latest_responses(numbered, ["case_key", "user_id"])


def _human_ids():
    rater = F.concat(F.lit(HUMAN_PREFIX), S.participant_id(_name(), _email()))
    return [uuid_of("case_key").alias("case_id"), F.coalesce(rater, F.lit("")).alias("rater")]


def human_runs(spark, folder) -> DataFrame:
    return _latest_choices(spark, folder).select(*_human_ids(), "parsed_choice")


def runs(spark, folder) -> DataFrame:
    """The fact table: model runs and the human responses that are in force."""
    return model_runs(spark, folder).unionByName(human_runs(spark, folder))


def _decorated(summary: DataFrame, ids: list, native: list[str]) -> DataFrame:
    """The summary under its ids, in the session's number of partitions.

    Adaptive execution joins partitions by their bytes, and native keys are a tenth of the ids that follow: what
    a later join or aggregate holds in a task would grow with the tables.
    """
    # in another order of the keys, as Spark drops a repetition of the aggregate's own shuffle
    spread = summary.repartition(shuffle_partitions(summary), *reversed(native))
    return spread.select(*ids, *[c for c in summary.columns if c not in native])


def model_summary(spark, folder) -> DataFrame:
    """Summary of the model runs, counted on the narrow native keys; ids are attached to the result."""
    from panelstat.operators.summary import run_summary

    keys = ["l_partkey", "l_linenumber", "l_linestatus"]
    return _decorated(run_summary(_model_choices(spark, folder), keys), _model_ids(), keys)


def human_summary(spark, folder) -> DataFrame:
    from panelstat.operators.summary import run_summary

    keys = ["case_key", "user_id"]
    return _decorated(run_summary(_latest_choices(spark, folder), keys), _human_ids(), keys)


def summary(spark, folder) -> DataFrame:
    return model_summary(spark, folder).unionByName(human_summary(spark, folder))


def participants_input(spark, folder) -> DataFrame:
    return events(spark, folder).select(
        S.participant_id(_name(), _email()).alias("participant_id"),
        _name().alias("name"),
        _email().alias("email"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("topic "), F.col("case_key").cast("string")))
        .otherwise("")
        .alias("expertise"),
        "ts",
        "event_id",
    )


def review_rows(spark, folder) -> DataFrame:
    """Review table: one row per document, with two reviewers from the labels."""
    d = table(spark, folder, "documents").withColumn("h", F.md5(F.concat(F.lit("row|"), F.col("doc_id").cast("string"))))
    l = table(spark, folder, "labels")
    digit = lambda i: F.substring("h", i, 1)
    tag = lambda i: (
        F.when(digit(i) < "5", "promotes").when(digit(i) < "a", " Violates").when(digit(i) < "f", "neutral")
        .otherwise(F.when(digit(i + 8) < "8", "").otherwise("both"))
    )
    named = {}
    for o in (1, 2):
        for i, a in enumerate(ATTRIBUTES):
            named[f"{a.capitalize()} C{o}"] = tag(4 * o + i - 3)
    return d.join(l, "doc_id", "left").select(
        F.when(digit(31) < "f", uuid_of("doc_id", "doc")).otherwise("").alias("Case ID"),
        F.when(F.col("quality").isNotNull(), "ada").otherwise("").alias("R1"),
        F.when(F.col("quality") == 1, "Approve").otherwise("").alias("R1 Decision?"),
        F.when(F.col("toxic").isNotNull(), "ben").otherwise("").alias("R2"),
        F.when(F.col("toxic") == 1, "Reject").when(F.col("toxic") == 0, "approve").otherwise("").alias("R2 Decision?"),
        F.lit("").alias("R3"),
        F.lit("").alias("R3 Decision?"),
        F.when(F.col("toxic") == 1, "deprecated").when(F.col("toxic") == 0, "approved")
        .otherwise("needs_review").alias("Status"),
        F.col("text").alias("Vignette"),
        F.concat(F.lit("Keep "), "source").alias("Choice 1"),
        F.when(digit(32) < "f", F.concat(F.lit("Drop "), "source")).otherwise("").alias("Choice 2"),
        *[c.alias(n) for n, c in named.items()],
        F.col("lang").alias("Reviewer Comments"),
    )


def embeddings(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("case_id"), "embedding", "label"
    )


def case_records(spark, folder) -> DataFrame:
    """Case histories: one record per order."""
    o = table(spark, folder, "orders")
    return o.select(
        uuid_of("o_orderkey", "record").alias("case_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "needs_review")
        .otherwise("completed").alias("status"),
        F.when(F.col("o_orderpriority") < "3", "literature").otherwise("synthetic").alias("seed_mode"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("value_a"),
        F.col("o_orderstatus").alias("value_b"),
    )


def iterations(spark, folder) -> DataFrame:
    """Versions of each record: one per (order, line number)."""
    l = table(spark, folder, "lineitem")
    v = l.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("part"),
        F.max("l_suppkey").alias("supplier"),
        F.max("l_returnflag").alias("flag"),
        F.max("l_linestatus").alias("state"),
        F.max("l_shipdate").alias("ts"),
    )
    reviewed = F.col("supplier") % 3 != 0
    return v.select(
        uuid_of("l_orderkey", "record").alias("case_id"),
        F.col("l_linenumber").alias("pos"),
        (F.col("l_linenumber") - 1).alias("iteration"),
        "ts",
        F.when(F.col("flag") != "N", F.concat(F.lit("About part "), F.col("part").cast("string"))).alias("vignette"),
        F.when(F.col("flag") != "N", F.lit("Take it")).alias("choice_1"),
        F.when(F.col("flag") != "N", F.lit("Leave it")).alias("choice_2"),
        ((F.col("flag") != "N") & (F.col("state") == "O")).alias("tagged"),
        F.when(reviewed, F.concat(F.lit("reviewer "), (F.col("supplier") / 10).cast("int").cast("string"))).alias("reviewer"),
        F.when(reviewed, F.when(F.col("flag") == "A", "Approved ").when(F.col("flag") == "R", "no")
               .when(F.col("state") == "O", "").otherwise("later")).alias("decision"),
        F.when(reviewed & (F.col("state") == "F"), F.concat(F.lit("see "), F.col("part").cast("string"))).alias("comments"),
    )
