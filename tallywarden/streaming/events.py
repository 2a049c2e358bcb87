"""Duplicate removal on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame


def distinct_events(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Each event once: the first to arrive of those with equal keys whose times lie
    within ``delay`` of each other.

    The state holds the keys of the time that the watermark leaves open, no more:
    they go as the watermark passes them. Events older than the watermark when they
    arrive are late and dropped, as nothing is known of their copies any more. Keys
    spread over the state stores of all executors; a restart goes on from the
    checkpoint.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def ingest_events(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], event_time: str, delay: str
) -> None:
    """Appends the distinct events of all files that are there now to a table."""
    query = (
        distinct_events(stream, keys, event_time, delay)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
