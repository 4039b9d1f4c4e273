"""Materialise a result that several branches of a plan read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelstat.session import shared_folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the cluster's shared folder and read back.

    Branches then share one computation and the lineage is cut; a lost executor costs a re-read.
    Meant for results that are small against their input, such as fits and profiles.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
