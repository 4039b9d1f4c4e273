"""The corpus pipeline: documents in, packed training bins out.

``STAGES`` lists (name, function) with function(spark, docs, sf_dir) -> DataFrame. Each stage's result is
written as Parquet to the shared folder and read again as the next one's documents. All stages but the last
return the columns of documents; the last returns the pieces of documents in bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelstat.llm import mixing, packing, simhash, substring, toxicity
from panelstat.llm.catalog import learn_toxicity
from panelstat.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores under the threshold."""
    return toxicity.drop_toxic(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose SimHash fingerprints differ in at most 3 bits or whose five-word shingles are alike to 0.8 or more."""
    return simhash.first_alike(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 13 words or more that an earlier document has are cut out; other documents stay as they are."""
    return substring.dedup(docs, carry=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix takes it."""
    return mixing.mix_rows(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with bin and place; repeats of a document never share a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mix", mix_sources),
    ("pack", pack_bins),
]
ORACLE_SQL = None  # a trained classifier and XXH64 are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
