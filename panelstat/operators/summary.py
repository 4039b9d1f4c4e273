"""Per (case, rater) summaries and the pooled human rater."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.schema import CONSENSUS, HUMAN_PREFIX


def _derived(df: DataFrame, majority) -> DataFrame:
    valid = F.col("c1") + F.col("c2")
    n = F.nullif(F.col("valid"), F.lit(0))
    return (
        df.withColumn("valid", valid)
        .withColumn("majority", majority)
        .withColumn("p1", F.col("c1") / n)
        .withColumn("majority_probability", F.greatest("c1", "c2") / n)
        .withColumn("entropy", F.when(F.col("valid") > 0, S.binary_entropy("c1", "valid")))
    )


def _counts(choice: str = "parsed_choice"):
    c = F.col(choice)
    return [
        F.count_if(c == "choice_1").alias("c1"),
        F.count_if(c == "choice_2").alias("c2"),
        F.count_if(c == "REFUSAL").alias("refusals"),
        F.count("*").alias("runs_completed"),
    ]


def run_summary(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, majority (a tie goes to choice_1), share and entropy per (case, rater) (A1, A2).

    ``keys`` names other columns that identify case and rater, such as narrow numeric keys.
    """
    counts = runs.groupBy(*(keys or ["case_id", "rater"])).agg(*_counts())
    majority = F.when(F.col("valid") == 0, F.lit(None)).when(F.col("c1") >= F.col("c2"), "choice_1").otherwise("choice_2")
    return _derived(counts, majority)


def pool(summary: DataFrame, name: str) -> DataFrame:
    """One virtual rater from the pooled votes of all rows; a tie has no majority."""
    pooled = summary.groupBy("case_id").agg(
        *[F.sum(c).alias(c) for c in ("c1", "c2", "refusals", "runs_completed")]
    )
    pooled = pooled.select("case_id", F.lit(name).alias("rater"), "c1", "c2", "refusals", "runs_completed")
    majority = F.when(F.col("c1") > F.col("c2"), "choice_1").when(F.col("c2") > F.col("c1"), "choice_2")
    return _derived(pooled, majority)


def humans(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("rater").startswith(HUMAN_PREFIX))


def models(summary: DataFrame) -> DataFrame:
    return summary.filter(~F.col("rater").startswith(HUMAN_PREFIX) & (F.col("rater") != CONSENSUS))


def with_consensus(summary: DataFrame, human: DataFrame | None = None) -> DataFrame:
    """The summary plus the virtual rater, so that every metric is one code path.

    A caller that holds the human rows apart passes them and saves a second pass over the models.
    """
    return summary.unionByName(pool(humans(summary) if human is None else human, CONSENSUS))


def human_consensus(summary: DataFrame) -> DataFrame:
    """Votes, majority and confidence per case with at least one human (A3)."""
    c = pool(humans(summary), CONSENSUS)
    return c.select(
        "case_id",
        F.col("majority").alias("majority_choice"),
        F.col("c1").alias("choice_1_votes"),
        F.col("c2").alias("choice_2_votes"),
        F.col("refusals").alias("refusal_votes"),
        F.col("valid").alias("total_votes"),
        F.col("majority_probability").alias("confidence"),
    )
