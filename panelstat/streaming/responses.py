"""Incremental forms of the tallies, the upsert and the registry on a stream of responses.

Aggregating streams emit changed rows only. Each micro-batch is written to its own folder, named by the
import, the stream (the id in its checkpoint) and the batch. A replayed batch replaces itself, another
stream's batches are left alone, and a read takes the newest row per key: what is rewritten never grows
with the table. ``compact`` folds the folders into one when there are many.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelstat.operators.merge import latest_responses
from panelstat.operators.summary import _counts


def read_events(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """File stream of events; the event time becomes a zoned timestamp, as watermarks need."""
    s = spark.readStream.schema(schema).options(**options).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def vote_tally(responses: DataFrame) -> DataFrame:
    """Running counts per (case, rater)."""
    return responses.groupBy("case_id", "rater").agg(*_counts())


def registry_ranges(responses: DataFrame) -> DataFrame:
    """First and last time each participant was seen."""
    return responses.groupBy("participant_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n")
    )


def deduplicated(events: DataFrame, key: str = "event_id", delay: str | None = None) -> DataFrame:
    """Events once each although the source delivers at least once (T4).

    Without ``delay`` every key is remembered and nothing is lost, whatever the order of arrival. With it
    state is dropped past the watermark, and events that come later than that are dropped as well.
    """
    if delay is None:
        return events.dropDuplicates([key])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def hourly_tally(events: DataFrame, *keys: str, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Counts per time window and key (T5). Without ``delay`` late events count; with it they are dropped past the watermark."""
    events = events if delay is None else events.withWatermark("ts", delay)
    return events.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"))


LOG_COLUMNS = ("import", "stream", "batch")


def write_changes(stream: DataFrame, path: str, checkpoint: str, prepare=None, import_no: int = 0) -> StreamingQuery:
    """Run an aggregating stream over everything available and log its changes by import, stream and batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        meta = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        out = prepare(batch) if prepare else batch
        out.write.mode("overwrite").parquet(f"{path}/import={import_no}/stream={json.loads(meta)['id']}/batch={batch_id}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_upserts(responses: DataFrame, path: str, checkpoint: str, import_no: int = 0) -> StreamingQuery:
    """Log the newest response per (participant, case) of every batch (T2). A later import has a larger number."""
    return write_changes(responses, path, checkpoint, latest_responses, import_no)


def write_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append to a parquet folder."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current(spark: SparkSession, path: str, keys: list[str], order: Column | None = None) -> DataFrame:
    """Newest logged row per key: by import and batch, or by ``order`` first where given."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in keys and c not in LOG_COLUMNS]
    by = ([order.alias("_order")] if order is not None else []) + [F.col(c) for c in ("import", "batch")]
    value = F.struct(*by, *rest)
    return log.groupBy(*keys).agg(F.max(value).alias("v")).select(*keys, *[f"v.{c}" for c in rest])


def current_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses in force: those of the newest import that has the key, in it the newest by (ts, event_id)."""
    log = spark.read.parquet(path)
    keys = ["case_id", "participant_id"]
    rest = [c for c in log.columns if c not in keys and c not in LOG_COLUMNS]
    order = ["import", "ts", "event_id", *[c for c in rest if c not in ("ts", "event_id")]]
    return log.groupBy(*keys).agg(F.max(F.struct(*order)).alias("v")).select(*keys, *[f"v.{c}" for c in rest])


def compact(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """Fold a change log into one folder, older than any import."""
    current(spark, path, keys).write.mode("overwrite").parquet(f"{target}/import=-1/stream=compact/batch=0")
