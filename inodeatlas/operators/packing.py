"""Pack documents into batches for a bulk sink.

A batch closes as soon as its bytes reach the limit, then counting starts again. A lane
is one independent stream of documents, as one writer would see it: a partition, unless documents
name theirs. The fold runs over record batches and holds one number.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_lanes(docs: DataFrame, lanes: int) -> DataFrame:
    """Spread documents evenly; choose enough lanes that one fits a task."""
    return docs.withColumn("lane", F.pmod(F.xxhash64("subject"), F.lit(lanes)))


class _Fold:
    """Batch numbers of documents, as they come; holds the open batch's bytes and the moment it was opened."""

    def __init__(self, max_bytes: float, max_seconds: float | None, clock: Callable[[], float]):
        self.max_bytes, self.max_seconds, self.clock = max_bytes, max_seconds, clock
        self.number, self.held, self.opened = 0, 0, None

    def __call__(self, sizes):
        import numpy as np

        if self.max_seconds is not None:
            now = self.clock()
            if self.opened is not None and now - self.opened >= self.max_seconds:
                self.number, self.held, self.opened = self.number + 1, 0, None
        out, total = np.empty(len(sizes), dtype=np.int64), np.cumsum(sizes)
        at, base = 0, -self.held
        while at < len(total):
            # first document that brings the batch to the limit
            end = int(np.searchsorted(total, self.max_bytes + base, side="left"))
            closes = end < len(total)
            end = end + 1 if closes else len(total)
            out[at:end] = self.number
            if closes:
                self.number, base = self.number + 1, int(total[end - 1])
            at = end
        self.held = int(total[-1]) - base if len(total) else self.held
        if self.max_seconds is not None:
            self.opened = None if not self.held else now if closes or self.opened is None else self.opened
        return out


def pack_documents(docs: DataFrame, max_bytes: float, max_seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """Add ``lane``, ``batch`` (number within the lane) and ``bytes`` to subject, document.

    A partition is a lane, its documents are taken as they lie there, and nothing is shuffled. Documents with a
    column ``lane`` are brought together by it, in the order of their subjects. A batch that has been open for
    ``max_seconds`` when documents arrive closes without them.
    """
    lanes = "lane" in docs.columns

    def fold(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        folds, lane_now = {}, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sizes = batch.column("bytes").to_numpy(zero_copy_only=False)
            if not lanes:
                own = folds.setdefault(None, _Fold(max_bytes, max_seconds, clock))
                where = pa.array(np.full(len(sizes), TaskContext.get().partitionId(), np.int64))
                yield batch.append_column("lane", where).append_column("batch", pa.array(own(sizes)))
                continue
            lane = batch.column("lane").to_numpy(zero_copy_only=False)
            out = np.empty(len(sizes), dtype=np.int64)
            edges = [0, *(np.flatnonzero(lane[1:] != lane[:-1]) + 1), len(lane)]
            for start, stop in zip(edges[:-1], edges[1:]):
                if lane_now is None or lane[start] != lane_now:
                    lane_now, folds = lane[start], {None: _Fold(max_bytes, max_seconds, clock)}
                out[start:stop] = folds[None](sizes[start:stop])
            yield batch.append_column("batch", pa.array(out))

    sized = docs.withColumn("bytes", F.length("document").cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema.fields)
    if not lanes:
        return sized.mapInArrow(fold, schema + ", lane long, batch long")
    ordered = sized.repartition("lane").sortWithinPartitions("lane", "subject")
    return ordered.mapInArrow(fold, schema + ", batch long")


def batch_totals(packed: DataFrame) -> DataFrame:
    return packed.groupBy("lane", "batch").agg(
        F.count("*").alias("documents"), F.sum("bytes").alias("bytes")
    )
