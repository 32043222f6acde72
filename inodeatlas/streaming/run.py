"""Run a streaming query to its end, for a time, or until it idles."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.packing import assign_lanes, pack_documents
from ..operators.reduction import reduce_events
from ..sinks.documents import write_documents
from ..sinks.writers import write_changes
from ..sources.changelog import poll_batches


def start(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Hand every micro-batch to ``handle(batch, number)``.

    The position in the source is committed after the batch. Without an ``interval``
    the query takes what is there now, in as many batches as the source limits ask
    for, and ends.
    """
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def run_to_end(stream: DataFrame, handle, checkpoint: str, timeout: float | None = None) -> bool:
    """Run until the source is drained, or at most ``timeout`` seconds. True when drained.

    A handler with a ``finish`` emits what it holds back once the query has ended.
    """
    query = start(stream, handle, checkpoint)
    finished = query.awaitTermination(timeout) if timeout else query.awaitTermination() is None
    if not finished:
        query.stop()
    if hasattr(handle, "finish"):
        handle.finish()
    return bool(finished)


def stop_when_idle(query: StreamingQuery, seconds: float, poll: float = 0.5) -> None:
    """Stop a running query that has seen no new rows for a while."""
    last_busy, seen = time.monotonic(), None
    while query.isActive:
        progress = query.lastProgress
        if progress is not None and progress["batchId"] != seen:
            seen = progress["batchId"]
            if progress["numInputRows"] > 0:
                last_busy = time.monotonic()
        if time.monotonic() - last_busy > seconds and not query.status["isTriggerActive"]:
            query.stop()
            return
        time.sleep(poll)


def stamp_ingest_time(df: DataFrame) -> DataFrame:
    """Time of processing; nothing here depends on event time."""
    return df.withColumn("ingested_at", F.current_timestamp())


def count_stream(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running totals; write in update mode and take the last value per key."""
    return stream.groupBy(*keys).agg(F.count("*").alias("count"))


def pass_through_stream(profile: str, destination: str, reduce: bool = True, poll_size: int = 10_000, **options):
    """Batch handler that forwards the reduced events and keeps no state.

    Polls are ``poll_size`` record ids, so a hot object is at most that many rows in one task; a
    micro-batch that ends within a poll ends the poll.
    """

    def handle(batch: DataFrame, number: int) -> None:
        events = poll_batches(batch, poll_size)
        write_changes(reduce_events(events, profile, reduce), destination, **options)

    return handle


def document_stream(max_bytes: float, receipts: str, sender=None, lanes: int | None = None, max_seconds: float | None = None):
    """Batch handler that packs and sends documents; receipts go to one folder per batch.

    Each task packs what it has read, unless a number of lanes is given.
    """

    def handle(batch: DataFrame, number: int) -> None:
        packed = pack_documents(assign_lanes(batch, lanes) if lanes else batch, max_bytes, max_seconds)
        out = stamp_ingest_time(write_documents(packed, sender))
        out.write.mode("overwrite").parquet(f"{receipts}/batch={number}")

    return handle
