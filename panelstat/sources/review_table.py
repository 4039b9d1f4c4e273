"""Review tables as CSV: lenient reading, fixed columns on writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.schema import REVIEW_COLUMNS


def clean_rows(rows: DataFrame) -> DataFrame:
    """Short rows padded with blanks, all-blank rows dropped."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in REVIEW_COLUMNS]
    padded = rows.select(*cells, *[c for c in rows.columns if c not in REVIEW_COLUMNS])
    return padded.filter(F.exists(F.array(*[f"`{c}`" for c in REVIEW_COLUMNS]), lambda c: F.trim(c) != ""))


def with_status(rows: DataFrame, status: str | None) -> DataFrame:
    if not status:
        return rows
    return rows.filter(F.lower(F.trim("Status")) == status.lower())


def read_review_rows(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """Review rows of a CSV file or folder with the fixed header."""
    schema = ", ".join(f"`{c}` STRING" for c in REVIEW_COLUMNS)
    raw = (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("enforceSchema", False).option("mode", "PERMISSIVE")
        .csv(path)
    )
    return with_status(clean_rows(raw), status)


def write_review_rows(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write or append the fixed columns; filter with an anti join first when appending."""
    (
        rows.select(*[f"`{c}`" for c in REVIEW_COLUMNS]).write.mode(mode)
        .option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
