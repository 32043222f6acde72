"""What sinks write, read back: text, CSV, JSON, Parquet, databases, receipts, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import counts as c
from ..operators import dd, reduction
from ..operators.dimensions import explode_dimensions
from ..operators.documents import aggregate_documents, receipt_totals, receipts_to_report
from ..operators.packing import pack_documents
from ..operators.primary import document_text, primary_documents
from ..schemas import INTEGER_COLUMNS, QUANTILES
from ..session import checkpoint_dir, cut_lineage
from ..sinks import writers
from ..sinks.documents import write_documents
from ..sources import inventory, reports
from ..streaming.run import document_stream, pass_through_stream, run_to_end
from . import query
from .changes import GPFS_FOLD
from .counting import WORKER_SQL, _bucketed, _long_worker
from .snapshot import DD_SQL, INVENTORY_COLUMNS
from .streams import POLL_SIZE, _micro_batches, _times
from .tables import FILES_SQL, GPFS_SQL, KEYS_SQL, files, gpfs_events, gpfs_rows, table


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/{uuid.uuid4()}"


@query("text_round_trip", f"WITH {FILES_SQL} SELECT {INVENTORY_COLUMNS} FROM files")
def text_round_trip(spark, sf_dir):
    """Snapshot lines written as text files and scanned again."""
    folder = _folder(spark)
    inventory.render_inventory(files(spark, sf_dir)).write.text(folder)
    good, _ = inventory.parse_inventory(inventory.read_lines(spark, folder))
    return good.select(*[x.strip() for x in INVENTORY_COLUMNS.split(",")])


@query(
    "quoted_csv_round_trip",
    f"""WITH {FILES_SQL} SELECT type, CAST(mode AS VARCHAR) AS mode, CAST(uid AS VARCHAR) AS uid, CAST(gid AS VARCHAR) AS gid,
      size, atime, ctime, mtime FROM files""",
)
def quoted_csv(spark, sf_dir):
    """Headerless CSV in chunks of 5,000 rows, scanned as quoted CSV of nine columns."""
    folder = _folder(spark)
    columns = ["type", "mode", "uid", "gid", "size", "atime", "ctime", "mtime", "path"]
    writers.write_csv_chunks(files(spark, sf_dir).select(*columns), folder, 5000)
    return inventory.typed_base_columns(inventory.read_quoted_csv(spark, folder, 9))


@query(
    "json_feed_round_trip",
    f"""WITH {GPFS_SQL}, ev AS (SELECT batch_id, CAST(inode AS VARCHAR) AS slot, eid, event_type FROM gpfs), {GPFS_FOLD}
    SELECT batch_id, slot, eid, event_type, path, size FROM reduced JOIN (SELECT eid, path, size FROM gpfs) USING (eid)""",
)
def json_feed(spark, sf_dir):
    """The reduced feed through the JSON sink; the sink that discards takes it as well."""
    folder = _folder(spark)
    feed = cut_lineage(reduction.pass_through(gpfs_events(spark, sf_dir), "inotify"))
    writers.write_changes(feed, "none")
    writers.write_changes(feed, "json", path=folder)
    return spark.read.schema("batch_id long, slot string, eid long, event_type string, path string, size long").json(folder)


@query(
    "parquet_round_trip",
    f"WITH {FILES_SQL} SELECT fileset, gid, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS size FROM files GROUP BY ALL",
)
def parquet(spark, sf_dir):
    """A table in a folder for each fileset; only the folders' own columns and sizes are read again."""
    folder = _folder(spark)
    writers.write_parquet(files(spark, sf_dir), folder, ["fileset"])
    return reports.read_table(spark, folder).groupBy("fileset", "gid").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query(
    "counts_csv_round_trip",
    f"WITH {WORKER_SQL} SELECT kind, name, worker, CAST(count AS BIGINT) AS count FROM shrunk",
)
def counts_csv(spark, sf_dir):
    """The ordered count report as text, parsed as a file of expected counts."""
    folder = _folder(spark)
    writers.write_counts_csv(c.shrink_workers(c.rollup_prefixes(_bucketed(spark, sf_dir))), folder)
    return _long_worker(inventory.parse_expected_counts(inventory.read_lines(spark, folder)))


@query(
    "quantile_csv_round_trip",
    f"SELECT CAST(name AS BIGINT) AS gid, metric, count, min, p10, p25, p50, p75, p90, p99, max FROM ({DD_SQL}) WHERE kind = 'group'",
)
def quantile_csv(spark, sf_dir):
    """The report of groups with a header, read with the columns that a run's report has."""
    folder = _folder(spark)
    report = dd.dd_report(files(spark, sf_dir), ("grp",)).drop("sum")
    writers.write_quantile_csv(report, folder, "group")
    schema = "gid long, metric string, count long, min long, " + ", ".join(f"{p} long" for p in QUANTILES) + ", max long, mean double"
    return spark.read.csv(folder, schema=schema, header=True).drop("mean")


CRC_SQL = """
crc0(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc0 WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc0 WHERE k = 8)"""


@query(
    "worker_buckets_crc",
    f"""WITH RECURSIVE {CRC_SQL}, {FILES_SQL},
    lines AS (SELECT *, concat_ws(',', type, mode, uid, gid, size, atime, ctime, mtime, '"' || path || '"') AS line FROM files),
    hashed AS (SELECT l.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(line, ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 64 AS worker FROM lines l, crc)
    SELECT 'user' AS kind, CAST(uid AS VARCHAR) AS name, worker, CAST(count(*) AS BIGINT) AS count FROM hashed GROUP BY ALL
    UNION ALL SELECT 'group', CAST(gid AS VARCHAR), worker, CAST(count(*) AS BIGINT) FROM hashed GROUP BY ALL""",
)
def worker_buckets(spark, sf_dir):
    """Counts in the bucket that the checksum of each line picks."""
    good, _ = inventory.parse_inventory(inventory.render_inventory(files(spark, sf_dir)))
    return _long_worker(c.key_counts(good, ("usr", "grp")))


@query(
    "tagged_keys",
    f"""WITH {FILES_SQL}, {KEYS_SQL} SELECT CASE kind WHEN 'user' THEN 'u' WHEN 'group' THEN 'g' ELSE '' END || name AS tag,
      kind, name, CAST(count(*) AS BIGINT) AS n FROM keyed GROUP BY kind, name""",
)
def tagged_keys(spark, sf_dir):
    """Keys in one column by a letter, and back."""
    tags = explode_dimensions(files(spark, sf_dir)).groupBy(text.tagged_key("kind", "name").alias("tag")).agg(F.count("*").alias("n"))
    return tags.select("tag", text.untag_key("tag").alias("k"), "n").select("tag", "k.kind", "k.name", "n")


@query(
    "receipts_to_report",
    f"SELECT kind, name, metric, count, min, p10, p25, p50, p75, p90, p99, max, mean FROM ({DD_SQL}) WHERE kind <> 'prefix'",
)
def receipts_report(spark, sf_dir):
    """Summary documents sent one by one in a dry run; the receipts' texts give the report again."""
    docs = aggregate_documents(dd.dd_report(files(spark, sf_dir), ("usr", "grp")), ["g1"])
    receipts = cut_lineage(write_documents(pack_documents(document_text(docs), 1)))
    return receipts_to_report(receipts)


def _refuse(request: dict) -> dict:
    """A service that refuses requests with a document of certain users."""
    if any(int(d["content"]["user_id"]) % 10 == 3 for d in request["ingest_data"]["gmeta"]):
        raise ValueError("refused")
    return {"acknowledged": True}


@query(
    "receipt_totals",
    f"""WITH {FILES_SQL}, docs AS (SELECT path, uid % 10 = 3 AS refused FROM files)
    SELECT NOT refused AS succeed, CASE WHEN refused THEN 'ValueError' END AS type, CASE WHEN refused THEN 'refused' END AS message,
      CAST(count(*) AS BIGINT) AS receipts, CAST(count(*) AS BIGINT) AS documents FROM docs GROUP BY refused""",
)
def totals_of_receipts(spark, sf_dir):
    """Every file's document as a request of its own; a service refuses some, and their receipts say why."""
    packed = pack_documents(document_text(primary_documents(files(spark, sf_dir), ["g1"])), 1)
    # read once: a second look would send again
    told = write_documents(packed, _refuse).select("value", F.from_json("value", "succeed boolean, resp string").alias("r")).select("value", "r.succeed", F.from_json("r.resp", "type string, message string").alias("f"))
    kinds = receipt_totals(told.select("succeed", F.col("f.type").alias("type"), F.col("f.message").alias("message"), "value"), by=("succeed", "type", "message"))
    documents = F.sum("documents").over(Window.partitionBy("succeed"))
    return kinds.filter("succeed is not null").select("succeed", "type", "message", "receipts", documents.alias("documents"))


ENTRIES = ["type", *INTEGER_COLUMNS, "path"]


def _write_databases(inv, root: str):
    """A database file for each folder (column ``folder``) below ``root``, in one transaction; lists them.

    A task holds whole folders, sorted: a database is open while its rows pass, and one that a failed attempt
    left behind is written anew. Files that a later step reads need not survive the machine: nothing is synced.
    """

    def values(column):
        if column.null_count:
            return column.to_pylist()
        return column.to_numpy(zero_copy_only=False).tolist()

    def run(batches):
        import os
        import sqlite3

        import pyarrow as pa
        import pyarrow.compute as pc

        path = con = None
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            columns, start = [values(c) for c in batch.columns[1:]], 0
            for folder, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if f"{root}{folder}/db.sqlite" != path:
                    if con:
                        con.commit()
                        con.close()
                        yield pa.RecordBatch.from_arrays([pa.array([f"{path},1"])], ["value"])
                    path = f"{root}{folder}/db.sqlite"
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    con = sqlite3.connect(path)
                    con.execute("PRAGMA synchronous = OFF")
                    con.execute("DROP TABLE IF EXISTS entries")
                    con.execute("CREATE TABLE entries (name, type, mode, uid, gid, size, atime, ctime, mtime)")
                con.executemany("INSERT INTO entries VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", zip(*(c[start:end] for c in columns)))
                start = end
        if con:
            con.commit()
            con.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path},1"])], ["value"])

    columns = ["folder", "name", "type", *INTEGER_COLUMNS]
    return inv.select(*columns).repartition("folder").sortWithinPartitions("folder").mapInArrow(run, "value string")


@query(
    "database_export",
    f"""WITH {FILES_SQL} SELECT type, CAST(mode AS VARCHAR) AS mode, uid, gid, size, atime, ctime, mtime,
      '/g' || gid || '_' || (size % 8) || '/' || regexp_extract(path, '[^/]*$') AS path FROM files""",
)
def database_export(spark, sf_dir):
    """Databases named by a listing, exported in two runs: the second finds the rest only."""
    root = checkpoint_dir(spark).removeprefix("file:") + f"/{uuid.uuid4()}"
    folder = F.concat(F.lit("/g"), F.col("gid").cast("string"), F.lit("_"), (F.col("size") % 8).cast("string"))
    inv = files(spark, sf_dir).withColumn("folder", folder).withColumn("name", F.substring_index("path", "/", -1))
    listed = inventory.parse_listing(cut_lineage(_write_databases(inv, f"{root}/in")).distinct())
    fix = lambda df: inventory.normalize_entries(df, f"{root}/in", "/db.sqlite").filter("reject is null").select(*ENTRIES)
    for part in (listed.filter(F.endswith("path", F.lit("0/db.sqlite"))), listed):
        writers.export_entries(spark, part, f"{root}/out", f"{root}/progress", 5000, fix)
    schema = "type string, mode string, uid long, gid long, size long, atime long, ctime long, mtime long, path string"
    return writers.read_export(spark, f"{root}/out", f"{root}/progress", schema)


@query(
    "stream_pass_through",
    f"""WITH {GPFS_SQL}, ev AS (SELECT batch_id, CAST(inode AS VARCHAR) AS slot, eid, event_type FROM gpfs), {GPFS_FOLD}
    SELECT batch_id, slot, eid, event_type FROM reduced""",
)
def stream_pass_through(spark, sf_dir):
    """The reduced feed without state, from micro-batches of whole polls through the JSON sink.

    A long log has micro-batches of more files, of the same size, up to a bound: each micro-batch has a cost of its own.
    """
    folder = _folder(spark)
    rows = gpfs_rows(table(spark, sf_dir, "events")).drop("batch_id")
    size = 5 * 8 * POLL_SIZE
    times = _times(rows.select(F.floor(F.col("eid") / size)).distinct().count())
    stream = _micro_batches(spark, rows, size * times, f"{folder}/log", 4 * times, POLL_SIZE)
    run_to_end(stream, pass_through_stream("inotify", "json", poll_size=POLL_SIZE, path=f"{folder}/out"), f"{folder}/checkpoint")
    return spark.read.schema("batch_id long, slot string, eid long, event_type string").json(f"{folder}/out")


@query(
    "stream_documents",
    f"WITH {FILES_SQL} SELECT CAST(count(*) AS BIGINT) AS documents FROM files",
)
def stream_documents(spark, sf_dir):
    """Documents packed and sent micro-batch by micro-batch; the receipts count them."""
    folder = _folder(spark)
    docs = document_text(primary_documents(files(spark, sf_dir), ["g1"]))
    docs.write.option("maxRecordsPerFile", 40_000).parquet(f"{folder}/documents")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/documents")
    run_to_end(stream, document_stream(1 << 20, f"{folder}/receipts"), f"{folder}/checkpoint")
    return receipt_totals(spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/receipts")).select("documents")
