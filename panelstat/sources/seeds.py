"""Seed lists: filter, positional pick, range slice and random pick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.functions.scalar import hash_u32
from panelstat.schema import SEED


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of seeds with its position in the file."""
    fields = SEED.replace(" STRING", ": STRING")
    lines = spark.read.text(path, wholetext=True).select(
        F.from_json("value", f"array<struct<{fields}>>").alias("items")
    )
    return lines.select(F.posexplode("items").alias("pos", "s")).select("pos", "s.*")


def of_type(seeds: DataFrame, scenario_type: str = "within", type_column: str = "scenario_type") -> DataFrame:
    return seeds.filter(F.col(type_column) == scenario_type)


def seed_at(positions: DataFrame, index: int) -> DataFrame:
    """The seed at a 0-based position of a (…, pos, n) table; out of bounds fails the job."""
    if index < 0:
        raise ValueError("seed index must not be negative")
    n = positions.agg(F.max("n")).scalar()
    guard = F.when(n > index, F.col("pos")).otherwise(F.raise_error(F.lit(f"seed index {index} is out of bounds")).cast("bigint"))
    return positions.withColumn("pos", guard).filter(F.col("pos") == index)


def seed_slice(positions: DataFrame, start: int, end: int) -> DataFrame:
    """Seeds at positions start <= pos < end."""
    return positions.filter((F.col("pos") >= start) & (F.col("pos") < end))


def random_seed_row(seeds: DataFrame, key: str, seed: int) -> DataFrame:
    """One random seed: the one whose hash is smallest."""
    rest = [c for c in seeds.columns if c != key]
    h = F.struct(hash_u32(F.lit(str(seed)), F.col(key)).alias("_h"), *[key, *rest])
    return seeds.agg(F.min(h).alias("v")).select("v.*").select(*seeds.columns)
