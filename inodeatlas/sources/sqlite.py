"""Data source over many small SQLite files named by a listing.

Spark plans one input partition per slice of the listing; each task opens its own
files. The files must be readable from every executor.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY_COLUMNS = ("name", "type", "mode", "uid", "gid", "size", "atime", "ctime", "mtime")
SCHEMA = "db_path string, " + ", ".join(f"{c} string" for c in ENTRY_COLUMNS) + ", error string"


BATCH_ROWS = 10_000


def as_texts(values: list):
    """Values of a database column as an Arrow array of texts, as ``str`` writes them."""
    import pyarrow as pa

    try:
        column = pa.array(values)
        if pa.types.is_string(column.type) or pa.types.is_int64(column.type) or pa.types.is_null(column.type):
            return column.cast(pa.string())
    except pa.ArrowException:  # of several types
        pass
    return pa.array([None if v is None else str(v) for v in values], pa.string())


def read_entries(db_path: str):
    """Arrow batches of the ``entries`` table of one file, streamed; a bad file gives one error row."""
    import os
    import sqlite3

    import pyarrow as pa

    names = ["db_path", *ENTRY_COLUMNS, "error"]

    def batch(rows, error=None):
        columns = [as_texts(list(c)) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(db_path), len(rows)), *columns, pa.array([error] * len(rows), pa.string())], names)

    nothing = [(None,) * len(ENTRY_COLUMNS)]
    if not os.path.exists(db_path):
        yield batch(nothing, "missing file")
        return
    rows = []
    try:
        with sqlite3.connect(f"file:{db_path}?mode=ro", uri=True) as connection:
            columns = ", ".join(f'"{c}"' for c in ENTRY_COLUMNS)
            for row in connection.execute(f"SELECT {columns} FROM entries"):
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)
    except sqlite3.Error as exc:
        if rows:
            yield batch(rows)
        yield batch(nothing, str(exc))


class SliceOfFiles(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class EntriesReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options.get("files", "[]"))
        self.per_task = int(options.get("filespertask", "64"))

    def partitions(self):
        step = self.per_task
        return [SliceOfFiles(self.files[i : i + step]) for i in range(0, len(self.files), step)]

    def read(self, partition):
        for path in partition.files:
            yield from read_entries(path)


class EntriesSource(DataSource):
    """``spark.read.format("sqlite_entries").option("files", <JSON list>)``."""

    @classmethod
    def name(cls):
        return "sqlite_entries"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return EntriesReader(self.options)


def read_named(spark: SparkSession, files: list[str], per_task: int = 64) -> DataFrame:
    """Scan an explicit, short list of files."""
    spark.dataSource.register(EntriesSource)
    return (
        spark.read.format("sqlite_entries")
        .option("files", json.dumps(files))
        .option("filesPerTask", str(per_task))
        .load()
    )


def read_listed(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """Scan the files of a listing of any length; the names never visit the driver."""

    def scan(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from read_entries(path)

    # a fixed number of tasks: the names are few bytes, and would be merged into one task
    tasks = tasks or int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listing.select("path").repartition(tasks, "path").mapInArrow(scan, SCHEMA)
