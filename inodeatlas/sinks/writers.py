"""Batch writers and the sink dispatch. Every one writes in parallel from the tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counts import report_order
from ..schemas import QUANTILES
from ..session import cut_lineage, exists, named_folders, remove_folder
from ..sources.sqlite import read_listed


def kafka_value(df: DataFrame) -> DataFrame:
    """Each row as one JSON text in column ``value``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """At-least-once delivery; needs the Kafka connector on the class path."""
    writer = kafka_value(df).write.format("kafka")
    writer.option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line."""
    df.write.mode(mode).json(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_changes(df: DataFrame, destination: str, **options) -> None:
    """Write a feed to ``kafka``, ``json`` or ``none``, as configured."""
    if destination == "kafka":
        write_kafka(df, options["servers"], options["topic"])
    elif destination == "json":
        write_json(df, options["path"])
    elif destination == "none":
        discard(df)
    else:
        raise ValueError(f"unknown destination {destination!r}")


def write_counts_csv(counts: DataFrame, path: str) -> None:
    """Ordered count report; part files are in order."""
    columns = [c for c in ("kind", "name", "worker", "count") if c in counts.columns]
    lines = report_order(counts).select(F.concat_ws(", ", *columns))
    lines.write.mode("overwrite").text(path)


def write_quantile_csv(report: DataFrame, path: str, kind: str) -> None:
    """Quantile report of users or groups, ordered by id and metric, with header."""
    key = {"user": "uid", "group": "gid"}[kind]
    rows = report.filter(F.col("kind") == kind).select(
        F.col("name").cast("long").alias(key), "metric", "count", "min", *QUANTILES, "max", "mean"
    )
    rows.orderBy(key, "metric").write.mode("overwrite").option("header", True).csv(path)


def write_csv_chunks(df: DataFrame, path: str, rows: int, mode: str = "append") -> None:
    """Headerless CSV files of at most ``rows`` rows."""
    df.write.mode(mode).option("header", False).option("maxRecordsPerFile", rows).csv(path)


def _finished(spark: SparkSession, progress: str) -> list[str]:
    """Runs whose list of databases is complete: Spark marks a folder when its job has ended."""
    return [run for run in named_folders(spark, progress, "run=") if exists(spark, f"{progress}/run={run}/_SUCCESS")]


def export_entries(
    spark: SparkSession,
    listing: DataFrame,
    out: str,
    progress: str,
    rows: int,
    normalize: Callable[[DataFrame], DataFrame],
    tasks: int | None = None,
) -> int:
    """Export the databases of a listing that no earlier run has exported.

    A run writes its rows to ``out/run=<name>`` and then the paths of its databases to ``progress/run=<name>``. What
    :func:`read_export` returns are the folders that progress names: rows of a run that died in between are not among
    them, and its databases are exported again by the next. Returns how many were left to do.
    """
    todo = listing.filter(~F.col("malformed")).select("path").distinct()
    done = _finished(spark, progress)
    if done:
        known = spark.read.schema("path string").parquet(*[f"{progress}/run={run}" for run in done])
        todo = todo.join(known, "path", "left_anti")
    todo = cut_lineage(todo)
    left = todo.count()
    if left:
        run = uuid.uuid4().hex
        good = normalize(read_listed(todo, tasks).filter(F.col("error").isNull()))
        write_csv_chunks(good, f"{out}/run={run}", rows, mode="errorifexists")
        todo.write.parquet(f"{progress}/run={run}")
    return left


def read_export(spark: SparkSession, out: str, progress: str, schema: str) -> DataFrame:
    """Rows of the finished runs."""
    done = _finished(spark, progress)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv([f"{out}/run={run}" for run in done])


def forget_unfinished(spark: SparkSession, out: str, progress: str) -> list[str]:
    """Remove the rows of runs that died; not while a run is under way. Returns their names."""
    dead = sorted(set(named_folders(spark, out, "run=")) - set(_finished(spark, progress)))
    for run in dead:
        remove_folder(spark, f"{out}/run={run}")
    return dead
