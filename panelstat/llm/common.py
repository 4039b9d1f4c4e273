"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.plans.reuse import materialise

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: one computation, no lineage."""
    return materialise(df, label)


def n_words(text: Column) -> Column:
    """Words as runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_blocks(spark: SparkSession, size: int, per_block: int) -> int:
    """Blocks of at most about per_block each, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / per_block))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of the column ``text``."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
