"""Streams of log rows: replay by key and sessions, the streaming forms of the ledger's batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idempotent_stream(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once, as long as its copies come within ``delay``; state beyond the watermark is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """``key, started, ended, n_events`` of sessions that end after ``gap`` of silence; rows later than ``delay`` are left out."""
    window = F.session_window(time, gap)
    counts = events.withWatermark(time, delay).groupBy(key, window.alias("w")).agg(F.count("*").alias("n_events"))
    return counts.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def upsert_batches(batch: DataFrame, batch_id: int, folder: str) -> None:
    """A ``foreachBatch`` body that writes each batch once: a replayed batch finds its folder and overwrites the same rows."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
