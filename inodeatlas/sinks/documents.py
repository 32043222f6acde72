"""Bulk document sink: packed batches go to a user function, receipts come back as rows."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names in requests and receipts.
LIST_TYPE = "GMetaList"
LIST_FIELD = "gmeta"

# What a task tells of each batch; the receipt itself is made by column functions.
TOLD = (
    "lane long, batch long, documents long, bytes long, single string, answer string, "
    "fault struct<type: string, message: string, traceback: array<string>>"
)
# What is told goes to Spark together, up to so many rows or characters.
TOLD_ROWS, TOLD_CHARS = 1000, 4 << 20


def failure_record() -> Column:
    """The fault of a batch as JSON text."""
    no = F.lit(False)
    return F.to_json(F.struct(no.alias("acknowledged"), no.alias("success"), "fault.type", "fault.message", "fault.traceback"))


def receipt(dry: bool, list_type: str = LIST_TYPE) -> Column:
    """Receipt text of a batch: plain fields by ``to_json``, texts that are JSON already behind them."""
    megabytes = F.col("bytes") / F.lit(float(1 << 20))
    plain = F.to_json(
        F.struct(
            F.lit(dry).alias("mock"),
            F.format_string("ingested %d docs (%d bytes, %.2f MB)", "documents", "bytes", megabytes).alias("msg"),
            F.col("fault").isNull().alias("succeed"),
            F.when(F.col("fault").isNotNull(), failure_record()).alias("resp"),
        )
    )
    request = F.concat(F.lit(f'{{"ingest_type":"{list_type}","ingest_data":{{"{LIST_FIELD}":['), "single", F.lit("]}}"))
    behind = F.concat(
        F.coalesce(F.concat(F.lit(',"data":'), request), F.lit("")), F.coalesce(F.concat(F.lit(',"resp":'), "answer"), F.lit("")), F.lit("}")
    )
    return F.concat(F.regexp_replace(plain, r"\}$", ""), behind)


def write_documents(
    packed: DataFrame,
    sender: Callable[[dict], Any] | None = None,
    list_type: str = LIST_TYPE,
) -> DataFrame:
    """Send each packed batch and return its receipt (``value`` is JSON text).

    ``packed`` comes from the packing step, whose partitions hold whole lanes in order.
    Without a ``sender`` this is a dry run, which returns single documents in the
    receipt. A sender gets one request; a task that is run again sends again, so the
    receiving side should overwrite by subject. Read the receipts once, or store them.
    """

    def call(documents):
        """Answer text and fault of one request."""
        import json
        import traceback

        try:
            listed = [json.loads(d) for d in documents]
            return json.dumps(sender({"ingest_type": list_type, "ingest_data": {LIST_FIELD: listed}})), None
        except Exception as fault:  # noqa: BLE001 - a failed batch is a result, not a crash
            lines = traceback.format_exception(fault)
            return None, {"type": type(fault).__name__, "message": str(fault), "traceback": "".join(lines).splitlines()}

    def send(batches):
        import pyarrow as pa

        fault_type = pa.struct([("type", pa.string()), ("message", pa.string()), ("traceback", pa.list_(pa.string()))])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [fault_type]
        schema = pa.schema(list(zip(("lane", "batch", "documents", "bytes", "single", "answer", "fault"), kinds)))

        def told(rows):
            (lane, batch), documents = rows[0][:2], [r[2] for r in rows]
            answer, fault = (None, None) if sender is None else call(documents)
            single = documents[0] if sender is None and len(documents) == 1 else None
            return dict(zip(schema.names, (lane, batch, len(rows), sum(r[3] for r in rows), single, answer, fault)))

        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lane", "batch", "document", "bytes"))))
        held, size = [], 0
        for _, own in itertools.groupby(rows, key=lambda r: r[:2]):
            held.append(told(list(own)))  # a batch is bounded by its bytes
            size += len(held[-1]["single"] or "") + len(held[-1]["answer"] or "")
            if len(held) >= TOLD_ROWS or size >= TOLD_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    sent = packed.mapInArrow(send, TOLD)
    return sent.select("lane", "batch", "documents", "bytes", receipt(sender is None, list_type).alias("value"))
