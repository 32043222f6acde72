"""Change-log records: JSON messages with paths and text lines with fids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.events import event_code
from ..schemas import GPFS_MESSAGE


def tag_gpfs(raw: DataFrame, payload: str = "value", offset: str = "offset") -> DataFrame:
    """Normalise JSON messages; ``reject`` is null for usable events.

    A message needs inode, path and event, none of them zero or empty. The first
    token other than the directory flag is the event.
    """
    body = F.col(payload).cast("string")
    kept = [c for c in raw.columns if c not in (payload, offset)]
    # generated, not projected: later filters must not repeat the JSON parse
    message = F.explode(F.array(F.from_json(body, GPFS_MESSAGE))).alias("m")
    parsed = raw.select(*kept, F.col(offset).alias("eid"), body.alias("_body"), message)
    tokens = F.filter(F.split(text.strip("m.event"), r"\s+"), lambda t: t != "")
    named = F.filter(tokens, lambda t: t != "IN_ISDIR")
    first = F.get(named, F.lit(0))
    code = event_code(first, "inotify")
    empty = F.col("_body").isNull() | (F.col("_body") == "")
    lacking = (
        (F.coalesce(F.col("m.inode"), F.lit(0)) == 0)
        | (F.coalesce(F.col("m.path"), F.lit("")) == "")
        | (F.coalesce(F.col("m.event"), F.lit("")) == "")
    )
    reject = (
        F.when(empty, "empty payload")
        .when(lacking, "missing field or bad JSON")
        .when(first.isNull(), "no event beside the directory flag")
        .when(code.isNull(), "unknown event")
    )
    return parsed.select(
        *kept,
        "eid",
        F.col("m.inode").alias("inode"),
        F.array_contains(tokens, "IN_ISDIR").alias("is_dir"),
        code.alias("event_type"),
        F.col("m.path").alias("path"),
        F.col("m.fileSize").alias("size"),
        *[F.col(f"m.{c}").alias(c) for c in ("atime", "ctime", "mtime", "permissions")],
        F.col("m.ownerUserId").alias("uid"),
        F.col("m.ownerGroupId").alias("gid"),
        reject.alias("reject"),
    )


def parse_gpfs(raw: DataFrame, payload="value", offset="offset") -> tuple[DataFrame, DataFrame]:
    tagged = tag_gpfs(raw, payload, offset)
    return (
        tagged.filter(F.col("reject").isNull()).drop("reject"),
        tagged.filter(F.col("reject").isNotNull()).select("eid", "reject"),
    )


def _fid(cell: Column, skip: int) -> Column:
    return text.strip_brackets(F.substring(cell, F.lit(skip + 1), F.length(cell)))


def tag_lustre(lines: DataFrame) -> DataFrame:
    """Split change-log lines on white space and pick the fields of each event type.

    Blank lines are left out without a reject.
    """
    line = text.strip("value")
    kept = [c for c in lines.columns if c != "value"]
    fields = F.explode(F.array(F.split(line, r"\s+"))).alias("_f")
    cut = lines.filter(line != "").select(*kept, F.col("value").alias("line"), fields)
    at = lambda i: F.get(F.col("_f"), F.lit(i))
    n = F.size("_f")
    code = event_code(at(1), "fid")
    named = code.isin("01CREAT", "02MKDIR", "06UNLNK", "07RMDIR", "08RENME")
    rename = code == "08RENME"
    owner = F.split(F.substring_index(at(7), "=", -1), ":")
    reject = (
        F.when(n < 9, "too few fields")
        .when(at(0).try_cast("long").isNull(), "record id is not a number")
        .when(code.isNull(), "unknown event")
        .when(~F.contains(at(7), F.lit("=")) | (F.size(owner) != 2), "no owner")
        .when((named & (n < 11)) | (rename & (n < 14)), "too few fields for the event")
        .when((code == "10OPEN") & ((n < 10) | ~F.contains(at(9), F.lit("="))), "no open mode")
    )
    return cut.select(
        *kept,
        at(0).try_cast("long").alias("eid"),
        code.alias("event_type"),
        F.when(F.startswith(at(5), F.lit("t=")), _fid(at(5), 2)).alias("target_fid"),
        F.get(owner, F.lit(0)).alias("uid"),
        F.get(owner, F.lit(1)).alias("gid"),
        F.when(named, _fid(at(9), 2)).alias("parent_fid"),
        F.when(named, at(10)).alias("name"),
        F.when(rename, _fid(at(11), 2)).alias("source_fid"),
        F.when(rename, _fid(at(12), 3)).alias("source_parent_fid"),
        F.when(rename, at(13)).alias("old_name"),
        F.when(code == "10OPEN", F.regexp_extract(at(9), "(?s)^[^=]*=(.*)$", 1)).alias("mode"),
        reject.alias("reject"),
        "line",
    )


def parse_lustre(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    tagged = tag_lustre(lines)
    return (
        tagged.filter(F.col("reject").isNull()).drop("reject", "line"),
        tagged.filter(F.col("reject").isNotNull()).select("line", "reject"),
    )


def after_record(events: DataFrame, last: int | None) -> DataFrame:
    """Only records behind the last one already read."""
    return events if last is None else events.filter(F.col("eid") > last)


def poll_batches(events: DataFrame, size: int = 10_000, eid: str = "eid") -> DataFrame:
    """Number the poll batches of a replay: ``size`` consecutive record ids per batch."""
    return events.withColumn("batch_id", F.floor(F.col(eid) / F.lit(size)).cast("long"))


def kafka_options(servers: str, topic: str, start="earliest", end="latest", partition=None) -> dict:
    """Reader options for one topic or one of its partitions.

    ``start`` is ``earliest``, ``latest``, an epoch in milliseconds or a map
    ``{partition: offset}``; ``committed`` means the checkpoint decides. ``end`` is
    ``latest`` or such a map.
    """
    import json

    options = {"kafka.bootstrap.servers": servers}
    if partition is None:
        options["subscribe"] = topic
    else:
        options["assign"] = json.dumps({topic: [partition]})

    def offsets(given):
        return json.dumps({topic: {str(p): o for p, o in given.items()}})

    if isinstance(start, int):
        options["startingTimestamp"] = str(start)
    elif isinstance(start, dict):
        options["startingOffsets"] = offsets(start)
    elif start != "committed":
        options["startingOffsets"] = start
    if end is not None:
        options["endingOffsets"] = offsets(end) if isinstance(end, dict) else end
    return options


def read_kafka(spark: SparkSession, servers: str, topic: str, **kwargs) -> DataFrame:
    """Bounded scan of a topic; needs the Kafka connector on the class path."""
    return spark.read.format("kafka").options(**kafka_options(servers, topic, **kwargs)).load()


def stream_kafka(spark: SparkSession, servers: str, topic: str, max_per_trigger=None, **kwargs) -> DataFrame:
    options = kafka_options(servers, topic, end=None, **kwargs)
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return spark.readStream.format("kafka").options(**options).load()
