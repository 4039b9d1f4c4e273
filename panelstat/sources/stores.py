"""Registries, case records, embeddings, evaluations and sessions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.schema import ATTRIBUTES, CASE_RECORD, EVALUATION, REGISTRY_ENTRY, SESSION

_REGISTRY_ROW = "participant_id STRING, name STRING, email STRING, expertise STRING, first_seen STRING, last_seen STRING"


def _times(df: DataFrame) -> DataFrame:
    return df.select(
        "participant_id", "name", "email", F.coalesce("expertise", F.lit("")).alias("expertise"),
        F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
    )


def read_registry(spark: SparkSession, path: str, rows: bool = False, entry_lines: bool = False) -> DataFrame:
    """Participants of a registry; a missing one is empty (S3).

    The interchange form is one JSON object keyed by participant id. ``entry_lines`` reads such an object with one entry a
    line, which ``write_registry_parts`` makes, in pieces of any size; JSON has no bare line breaks inside its strings, so a
    line is an entry, and a line that is none fails the job. Any other layout of the object is read as one row. ``rows``
    reads the one-line-per-participant form of ``write_registry``.
    """
    try:
        if rows:
            return _times(spark.read.schema(_REGISTRY_ROW).json(path))
        text = spark.read.option("recursiveFileLookup", entry_lines).text(path, wholetext=not entry_lines)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return _times(spark.createDataFrame([], _REGISTRY_ROW))
    if entry_lines:
        entry = F.regexp_replace(F.trim("value"), r"^[{,]|,$", "")
        text = text.select(F.concat(F.lit("{"), entry, F.lit("}")).alias("value")).filter(~F.col("value").isin("{}", "{}}"))
    parsed = F.from_json("value", f"map<string, {REGISTRY_ENTRY}>", {"mode": "FAILFAST"} if entry_lines else {})
    entries = text.select(F.explode(parsed).alias("participant_id", "e"))
    return _times(entries.select("participant_id", "e.*"))


def write_registry_parts(participants: DataFrame, path: str) -> None:
    """The keyed object as files that continue each other in the order of their paths, an entry a line.

    The first file opens the object with the entry of the least id, the rows are written by all tasks, the last file closes
    it: put together, the files are one JSON document. Ids are unique. ``read_registry(entry_lines=True)`` reads it in parts.
    """
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
    body = F.struct("name", "email", "expertise", iso("first_seen"), iso("last_seen"))
    whole = F.to_json(F.create_map(F.col("participant_id"), body))
    entries = participants.select("participant_id", whole.alias("w")).selectExpr("participant_id", "substring(w, 2, length(w) - 2) AS entry")
    least = entries.agg(F.min("participant_id").alias("least"), F.min_by("entry", "participant_id").alias("entry"))
    save = lambda df, folder: df.write.mode("overwrite").text(f"{path}/{folder}")
    save(least.select(F.concat(F.lit("{"), F.coalesce("entry", F.lit(""))).alias("value")).coalesce(1), "0-open")
    rest = entries.filter(F.col("participant_id") != least.select("least").scalar())
    save(rest.select(F.concat(F.lit(","), "entry").alias("value")), "1-entries")
    save(participants.sparkSession.range(1).select(F.lit("}").alias("value")).coalesce(1), "2-close")


def write_registry(participants: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line per participant with ISO times."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
    participants.select("participant_id", "name", "email", "expertise", iso("first_seen"), iso("last_seen")).write.mode(mode).json(path)


def write_registry_object(participants: DataFrame, file: str) -> None:
    """The interchange form: one JSON object keyed by participant id in one named file.

    The format is a single document, so it is one row of one task; ``write_registry`` makes the form that can be split.
    """
    spark = participants.sparkSession
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
    entry = F.struct("participant_id", F.struct("name", "email", "expertise", iso("first_seen"), iso("last_seen")))
    folder = f"{file}.parts"
    participants.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.mode("overwrite").text(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(path(folder)) if x.getPath().getName().startswith("part-"))
    fs.delete(path(file), False)
    fs.rename(part, path(file))
    fs.delete(path(folder), True)


def read_case_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Case records, leniently: malformed ones are left out, file and its time are kept.

    ``lines`` reads one record per line, which can be split, instead of one per file.
    """
    raw = spark.read.schema(CASE_RECORD).option("multiLine", not lines).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    kept = raw.select(
        "*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    return kept.filter("_corrupt_record is null and case_id is not null").drop("_corrupt_record")


def newest_first(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc("modified"), "case_id")


def record_iterations(records: DataFrame) -> DataFrame:
    """One row per version: texts whether options are strings or objects, tags, evaluation."""
    v = records.select("case_id", "status", F.posexplode("refinement_history").alias("pos", "h"))
    get = lambda p: F.try_variant_get("h.data", p, "string")
    text = lambda o: F.coalesce(get(f"$.choice_{o}.choice"), F.when(get(f"$.choice_{o}.autonomy").isNull(), get(f"$.choice_{o}")))
    tags = [get(f"$.choice_{o}.{a}").alias(f"c{o}_{a}") for o in (1, 2) for a in ATTRIBUTES]
    review = [
        F.try_variant_get("h.human_evaluation", f"$.reviewers.r{i}.{f}", "string").alias(n)
        for i in (1, 2, 3) for f, n in (("name", f"r{i}"), ("decision", f"r{i}_decision"))
    ]
    return v.select(
        "case_id", "status", "pos", F.col("h.iteration").alias("iteration"), F.col("h.step_description").alias("step"),
        F.col("h.timestamp").alias("ts"), get("$.vignette").alias("vignette"), text(1).alias("choice_1"), text(2).alias("choice_2"),
        get("$.choice_1.autonomy").isNotNull().alias("tagged"), *tags, *review,
        F.try_variant_get("h.human_evaluation", "$.comments", "string").alias("comments"),
    )


def record_rubrics(records: DataFrame) -> DataFrame:
    """(case_id, pos, rubric, position, criterion, outcome, suggested_changes) of every rubric of every version."""
    v = records.select("case_id", F.posexplode("refinement_history").alias("pos", "h"))
    named = F.array(*[
        F.struct(F.lit(n).alias("rubric"), F.col(f"h.{n}_evaluation").alias("m")) for n in ("clinical", "ethical", "stylistic", "equipoise")
    ])
    long = v.select("case_id", "pos", F.explode(named).alias("r")).filter("r.m is not null")
    return long.select("case_id", "pos", "r.rubric", F.posexplode(F.map_entries("r.m")).alias("position", "e")).select(
        "case_id", "pos", "rubric", "position", F.col("e.key").alias("criterion"), "e.value.outcome", "e.value.suggested_changes"
    )


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, embedding, created_at) of a JSON store whose values are objects or bare lists."""
    raw = spark.read.schema("embeddings MAP<STRING, VARIANT>").option("multiLine", True).json(path)
    e = raw.select(F.explode("embeddings").alias("case_id", "v"))
    vec = F.coalesce(F.try_variant_get("v", "$.embedding", "array<float>"), F.try_variant_get("v", "$", "array<float>"))
    return e.select("case_id", vec.alias("embedding"), F.try_variant_get("v", "$.created_at", "string").alias("created_at"))


def embedding_metadata(spark: SparkSession, path: str) -> DataFrame:
    fields = "metadata STRUCT<model: STRING, total_embeddings: BIGINT, last_updated: STRING>"
    return spark.read.schema(fields).option("multiLine", True).json(path).select("metadata.*")


def write_embeddings(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Columnar store, one row per case."""
    vectors.write.mode(mode).parquet(path)


def read_evaluations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Archived reviewer votes below a folder (S12), one per file or one per line."""
    return spark.read.schema(EVALUATION).option("multiLine", not lines).option("recursiveFileLookup", True).json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION).option("multiLine", True).json(path)
