"""Queries that run as streams over the given tables and read their own output back."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..operators.aggregate import joined_sum
from ..operators.counts import latest_counts
from ..operators.dimensions import explode_dimensions
from ..session import checkpoint_dir
from ..streaming.complete import HIGHS, LOWS, SUMS, complete_stream, row_partials, state_store
from ..streaming.follow import follow_namespace
from ..streaming.run import count_stream, run_to_end
from . import query
from .changes import _path_feed_sql
from .tables import FILES_SQL, GPFS_SQL, KEYS_SQL, files, gpfs_rows, table

POLL_SIZE = 1000  # records of a poll
BATCH_POLLS = 33  # polls of a micro-batch, and some records: none ends where a poll does
FILE_ROWS = 16_000  # of a stream of files
MOST_BATCHES = 25  # before micro-batches grow,
MOST_TIMES = 64  # to so many times their size at most


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(
    "stream_running_counts",
    "SELECT event_type AS name, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY 1",
)
def running_counts(spark, sf_dir):
    """Running totals in update mode; the last one per key counts."""
    folder = f"{checkpoint_dir(spark)}/{uuid.uuid4()}"
    running = count_stream(_stream(spark, sf_dir, "events"), ["event_type"])
    query_ = (
        running.writeStream.outputMode("update")
        .foreachBatch(lambda b, n: b.withColumn("offset", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/{n}"))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    told = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out")
    messages = told.select(
        F.lit("event").alias("kind"), F.col("event_type").alias("name"), F.lit(0).alias("worker"), "count", "offset"
    )
    return latest_counts(messages).select("name", "count")


def _date_files(spark, folder: str) -> None:
    """Date the files by their part: a stream of files takes the oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.listFiles(path, True)
    while found.hasNext():
        file = found.next().getPath()
        part = re.search(r"/part=(\d+)/", file.toString())
        if part:
            store.setTimes(file, 1_000_000_000_000 + 1000 * int(part.group(1)), -1)


def _times(batches: int) -> int:
    """By how much micro-batches grow if there were so many: each has a cost of its own."""
    return max(1, min(-(-batches // MOST_BATCHES), MOST_TIMES))


def _micro_batches(spark, rows, size: int, folder: str, tasks: int = 4, unit: int = 1):
    """Rows as a stream whose micro-batches are ``size`` record ids, written and read by ``tasks`` tasks each.

    A task's file holds whole groups of ``unit`` record ids.
    """
    part = F.floor(F.col("eid") / size)
    share = F.pmod(F.floor(F.col("eid") / unit), F.lit(tasks))
    parts = rows.withColumn("part", part).withColumn("share", share).repartition("part", "share").sortWithinPartitions("part", "share")
    parts.write.partitionBy("part", "share").parquet(folder)
    _date_files(spark, folder)
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", tasks).option("recursiveFileLookup", True)
    return reader.parquet(folder)


@query("stream_namespace_feed", f"WITH {GPFS_SQL}, {_path_feed_sql('gpfs', 3)}")
def namespace_feed(spark, sf_dir):
    """The feed of the whole log, followed in micro-batches that cut polls and flushes; larger ones for a long log."""
    folder = f"{checkpoint_dir(spark)}/{uuid.uuid4()}"
    rows = gpfs_rows(table(spark, sf_dir, "events")).drop("batch_id")
    size = BATCH_POLLS * POLL_SIZE
    times = _times(rows.select(F.floor(F.col("eid") / size)).distinct().count())
    stream = _micro_batches(spark, rows, size * times + 7, f"{folder}/log", 4 * times)
    handle = follow_namespace(spark, "inotify", folder, reduce=False, poll_size=POLL_SIZE, flush_every=3)
    run_to_end(stream, handle, f"{folder}/checkpoint")
    told = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/changes")
    return told.select("flush", "op", "fid", "path", "size", "mtime", "uid")


@query(
    "stream_complete_keys",
    f"""WITH {FILES_SQL}, {KEYS_SQL} SELECT kind, name, CAST(count(*) AS BIGINT) AS count, CAST(sum(size) AS BIGINT) AS size_sum,
      min(size) AS size_min, max(mtime) AS mtime_max, CAST(sum(atime) AS BIGINT) AS atime_sum, true AS complete
    FROM keyed WHERE kind <> 'prefix' GROUP BY kind, name""",
)
def complete_keys(spark, sf_dir):
    """Summaries of users and groups, each told once by the micro-batch that completes it; larger ones for many files."""
    folder, dims = f"{checkpoint_dir(spark)}/{uuid.uuid4()}", ("usr", "grp")
    inv = files(spark, sf_dir)
    inv.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/files")
    written = spark.read.schema(inv.schema).parquet(f"{folder}/files")
    expected = explode_dimensions(written, dims).groupBy("kind", "name").agg(F.count("*").alias("count"))
    expected.write.parquet(f"{folder}/expected")
    times = _times(-(-len(written.inputFiles()) // 4))
    stream = spark.readStream.schema(inv.schema).option("maxFilesPerTrigger", 4 * times).parquet(f"{folder}/files")
    told = complete_stream(row_partials(stream, dims), spark.read.parquet(f"{folder}/expected"), ["kind", "name"], SUMS, LOWS, HIGHS)
    with state_store(spark):
        running = (
            told.writeStream.format("parquet").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append").trigger(availableNow=True).start()
        )
    running.awaitTermination()
    out = spark.read.schema(told.schema).parquet(f"{folder}/told")
    return out.select(
        "kind", "name", "count", joined_sum("size_hi", "size_lo").cast("long").alias("size_sum"), "size_min", "mtime_max",
        joined_sum("atime_hi", "atime_lo").cast("long").alias("atime_sum"), "complete",
    )
