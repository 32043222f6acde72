"""Snapshot queries: parsing, documents, summaries, quantile reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, dd, ranks
from ..operators.aggregate import summary_stats
from ..operators.dimensions import explode_dimensions, long_metrics
from ..operators.documents import aggregate_documents, report_from_documents
from ..operators.primary import primary_documents
from ..schemas import METRICS
from ..sources import inventory
from . import query
from .tables import FILES_SQL, KEYS_SQL, LONG_SQL, files

INVENTORY_COLUMNS = "type, mode, uid, gid, size, atime, ctime, mtime, path"


@query(
    "inventory_nine_columns",
    f"WITH {FILES_SQL} SELECT {INVENTORY_COLUMNS} FROM files",
)
def inventory_nine(spark, sf_dir):
    lines = inventory.render_inventory(files(spark, sf_dir), "nine")
    good, _ = inventory.parse_inventory(lines, "nine")
    return good.select(*[c.strip() for c in INVENTORY_COLUMNS.split(",")])


@query(
    "inventory_ten_columns",
    f"WITH {FILES_SQL} SELECT {INVENTORY_COLUMNS}, fileset FROM files",
)
def inventory_ten(spark, sf_dir):
    lines = inventory.render_inventory(files(spark, sf_dir), "ten")
    good, _ = inventory.parse_inventory(lines, "ten")
    return good.select(*[c.strip() for c in INVENTORY_COLUMNS.split(",")], "fileset")


@query(
    "inventory_rejects",
    f"""WITH {FILES_SQL} SELECT CASE WHEN gid % 5 = 0 THEN 'column count'
            WHEN gid % 5 = 1 THEN 'not an integer' ELSE 'good' END AS verdict,
            CAST(count(*) AS BIGINT) AS n FROM files GROUP BY 1""",
)
def inventory_rejects(spark, sf_dir):
    """Every fifth group is cut short and every fifth holds a word for a number."""
    inv = files(spark, sf_dir)
    line = F.concat_ws(
        ",",
        "type",
        F.when(F.col("gid") % 5 == 1, "none").otherwise(F.col("mode").cast("string")),
        *["uid", "gid", "size", "atime", "ctime"],
        F.when(F.col("gid") % 5 != 0, F.col("mtime").cast("string")),
        F.when(F.col("gid") % 5 != 0, F.col("path")),
    )
    tagged = inventory.tag_inventory(inv.select(line.alias("value")), "nine")
    return tagged.groupBy(F.coalesce("reject", F.lit("good")).alias("verdict")).agg(
        F.count("*").alias("n")
    )


@query(
    "policy_listing",
    f"WITH {FILES_SQL} SELECT {INVENTORY_COLUMNS}, fileset FROM files",
)
def policy_listing(spark, sf_dir):
    inv = files(spark, sf_dir)
    from ..functions.modes import mode_to_text

    symbolic = F.concat(
        F.when(F.col("type") == "l", "l").otherwise("-"), F.substring(mode_to_text("mode"), 2, 9)
    )
    blank = F.lit("x")
    cells = [blank] * 18
    for at, c in {4: "size", 5: "fileset", 9: "uid", 10: "gid", 12: "atime", 13: "ctime", 15: "mtime"}.items():
        cells[at] = F.col(c).cast("string")
    cells[11] = symbolic
    encoded = F.url_encode(F.concat(F.lit("/mnt/fs"), F.col("path")))
    cells[17] = F.replace(encoded, F.lit("+"), F.lit("%20"))
    lines = inv.select(F.concat_ws(" ", *cells).alias("value"))
    good, _ = inventory.parse_policy_listing(lines, "/mnt/fs")
    # a link carries its own type bits; show the permission bits with the regular type
    mode = F.when(F.col("type") == "l", F.col("mode") - (0o120000 - 0o100000)).otherwise(F.col("mode"))
    return good.withColumn("mode", mode).select(
        *[c.strip() for c in INVENTORY_COLUMNS.split(",")], "fileset"
    )


@query(
    "primary_documents",
    f"""WITH {FILES_SQL} SELECT path AS subject, 'urn:group:id:g1' AS visible_to, type AS file_type,
      size AS file_size, CAST(uid AS VARCHAR) AS user_id, CAST(gid AS VARCHAR) AS group_id,
      '-' AS mode_first_char,
      CASE mode WHEN 33188 THEN '-rw-r--r--' WHEN 33261 THEN '-rwxr-xr-x' ELSE '-rw-rw-r--' END AS mode,
      strftime(to_timestamp(atime) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' +00:00' AS access_date,
      strftime(to_timestamp(ctime) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' +00:00' AS change_date,
      strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' +00:00' AS mod_date,
      mode AS raw_mode, uid AS raw_user, mtime AS raw_mod FROM files""",
)
def primary_document_fields(spark, sf_dir):
    docs = primary_documents(files(spark, sf_dir), ["g1"])
    return docs.select(
        "subject",
        F.array_join("visible_to", ",").alias("visible_to"),
        *[
            f"content.{c}"
            for c in (
                "file_type", "file_size", "user_id", "group_id", "mode_first_char", "mode",
                "access_date", "change_date", "mod_date",
            )
        ],
        F.col("content._raw.mode").alias("raw_mode"),
        F.col("content._raw.user_id").alias("raw_user"),
        F.col("content._raw.mod_date").alias("raw_mod"),
    )


@query(
    "dimension_fanout",
    f"""WITH {FILES_SQL}, {KEYS_SQL} SELECT kind, name, CAST(count(*) AS BIGINT) AS n,
        CAST(sum(size) AS BIGINT) AS total FROM keyed GROUP BY kind, name""",
)
def dimension_fanout(spark, sf_dir):
    keys = explode_dimensions(files(spark, sf_dir), keep=("size",))
    return keys.groupBy("kind", "name").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


def _stats_sql():
    cols = []
    for m in METRICS:
        cols.append(
            f"CAST(sum({m}) AS BIGINT) AS {m}_sum, min({m}) AS {m}_min, max({m}) AS {m}_max, "
            f"CAST(sum({m}) // count(*) AS BIGINT) AS {m}_avg"
        )
    return (
        f"WITH {FILES_SQL}, {KEYS_SQL} SELECT kind, name, CAST(count(*) AS BIGINT) AS count, "
        + ", ".join(cols)
        + " FROM keyed GROUP BY kind, name"
    )


@query("summary_stats", _stats_sql())
def summary(spark, sf_dir):
    out = summary_stats(files(spark, sf_dir))
    return out.select(
        *[F.col(c).cast("long").alias(c) if c.endswith("_sum") else c for c in out.columns]
    )


@query(
    "merged_partials",
    _stats_sql().replace("FROM keyed GROUP", "FROM keyed WHERE kind = 'group' GROUP"),
)
def merged_partials(spark, sf_dir):
    """Partials saved per fileset and merged again."""
    inv = files(spark, sf_dir)
    keyed = inv.select(
        F.lit("group").alias("kind"), F.col("gid").cast("string").alias("name"), "fileset", *METRICS
    )
    saved = aggregate.partial_stats(keyed, ["kind", "name", "fileset"])
    out = aggregate.finish_stats(aggregate.merge_stats(saved, ["kind", "name"]), ["kind", "name"])
    return out.select(
        *[F.col(c).cast("long").alias(c) if c.endswith("_sum") else c for c in out.columns]
    )


DD_SQL = f"""WITH {FILES_SQL}, {KEYS_SQL}, {LONG_SQL},
g AS (SELECT CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE) AS gamma),
buckets AS (
  SELECT kind, name, metric,
         CASE WHEN value > 0 THEN CAST(ceil(ln(CAST(value AS DOUBLE)) / ln(gamma)) AS BIGINT) END AS b,
         count(*) AS cnt, sum(value) AS s, min(value) AS lo, max(value) AS hi
  FROM long, g GROUP BY ALL
),
placed AS (
  SELECT *, sum(cnt) OVER (PARTITION BY kind, name, metric ORDER BY b NULLS FIRST) AS cum,
         sum(cnt) OVER (PARTITION BY kind, name, metric) AS n FROM buckets
),
picked AS (
  SELECT kind, name, metric, sum(cnt) AS count, min(lo) AS min, max(hi) AS max, sum(s) AS sum,
         {", ".join(f"min(CASE WHEN cum > CAST({q} AS DOUBLE) * (n - 1) THEN coalesce(b, -1) END) AS {p}"
                    for p, q in (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99)))}
  FROM placed GROUP BY kind, name, metric
)
SELECT kind, name, metric, CAST(count AS BIGINT) AS count, min,
  {", ".join(f"CASE WHEN {p} < 0 THEN 0 ELSE CAST(floor(pow(gamma, {p}) * (2 / (1 + gamma))) AS BIGINT) END AS {p}"
             for p in ("p10", "p25", "p50", "p75", "p90", "p99"))},
  max, CAST(sum // count AS BIGINT) AS mean FROM picked, g"""


@query("quantiles_dd", DD_SQL)
def quantiles_dd(spark, sf_dir):
    return dd.dd_report(files(spark, sf_dir)).drop("sum")


@query(
    "dd_sketch_table",
    f"""WITH {FILES_SQL}, {KEYS_SQL}, {LONG_SQL}
    SELECT kind, name, metric,
      CAST(ceil(ln(CAST(value AS DOUBLE)) / ln(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE))) AS BIGINT) AS bucket,
      CAST(count(*) AS BIGINT) AS cnt FROM long GROUP BY ALL""",
)
def dd_sketch_table(spark, sf_dir):
    table = dd.key_buckets(files(spark, sf_dir))
    return table.select(
        "kind", "name", "metric", (F.col("bucket") - dd.ORIGIN).cast("long").alias("bucket"), "cnt"
    )


def _exact_sql(where: str = "") -> str:
    picks = (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99))
    inner = ", ".join(
        f"CAST({q} AS DOUBLE) * (n - 1) - floor(CAST({q} AS DOUBLE) * (n - 1)) AS t_{p}, "
        f"CAST(max(CASE WHEN rn - 1 = floor(CAST({q} AS DOUBLE) * (n - 1)) THEN value END) AS DOUBLE) AS a_{p}, "
        f"CAST(max(CASE WHEN rn - 1 = least(floor(CAST({q} AS DOUBLE) * (n - 1)) + 1, n - 1) THEN value END) AS DOUBLE) AS b_{p}"
        for p, q in picks
    )
    outer = ", ".join(
        f"CAST(trunc(CASE WHEN t_{p} < 0.5 THEN a_{p} + (b_{p} - a_{p}) * t_{p} "
        f"ELSE b_{p} - (b_{p} - a_{p}) * (1 - t_{p}) END) AS BIGINT) AS {p}"
        for p, _ in picks
    )
    return f"""WITH {FILES_SQL}, {KEYS_SQL}, {LONG_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY kind, name, metric ORDER BY value) AS rn,
                 count(*) OVER (PARTITION BY kind, name, metric) AS n FROM long {where}),
    s AS (SELECT kind, name, metric, n, min(value) AS min, max(value) AS max,
                 round(CAST(sum(value) AS DOUBLE) / n, 4) AS mean, {inner}
          FROM r GROUP BY kind, name, metric, n)
    SELECT kind, name, metric, CAST(n AS BIGINT) AS count, min, {outer}, max, mean FROM s"""


@query("quantiles_exact", _exact_sql("WHERE kind <> 'prefix'"))
def quantiles_exact(spark, sf_dir):
    """Exact reports are made for users and groups."""
    out = ranks.exact_report(files(spark, sf_dir), ("usr", "grp"))
    return out.withColumn("mean", F.round("mean", 4))


@query(
    "aggregate_documents",
    f"""WITH d AS ({DD_SQL})
    SELECT CASE kind WHEN 'user' THEN 'user_id::' WHEN 'group' THEN 'group_id::' ELSE 'dir::' END || name AS subject,
      CAST(max(count) AS VARCHAR) AS file_count,
      CAST(max(CASE WHEN metric = 'size' THEN p50 END) AS VARCHAR) AS file_size_median_in_bytes,
      max(CASE WHEN metric = 'size' THEN p99 END) AS raw_file_size_99p,
      strftime(to_timestamp(max(CASE WHEN metric = 'atime' THEN mean END)) AT TIME ZONE 'UTC',
               '%Y-%m-%d %H:%M:%S') || ' +00:00' AS access_date_average,
      max(CASE WHEN metric = 'mtime' THEN max END) AS raw_mod_date_max,
      strftime(to_timestamp(max(CASE WHEN metric = 'ctime' THEN p10 END)) AT TIME ZONE 'UTC',
               '%Y-%m-%d %H:%M:%S') || ' +00:00' AS change_date_10p
    FROM d GROUP BY kind, name""",
)
def summary_documents(spark, sf_dir):
    docs = aggregate_documents(dd.dd_report(files(spark, sf_dir)), ["g1"])
    return docs.select(
        "subject",
        "content.file_count",
        "content.file_size_median_in_bytes",
        F.col("content._raw.file_size_99p_in_bytes").alias("raw_file_size_99p"),
        "content.access_date_average",
        F.col("content._raw.mod_date_max").alias("raw_mod_date_max"),
        "content.change_date_10p",
    )


@query(
    "report_from_documents",
    f"SELECT kind, name, metric, count, min, p10, p25, p50, p75, p90, p99, max, mean FROM ({DD_SQL})"
    " WHERE kind <> 'prefix'",
)
def documents_to_report(spark, sf_dir):
    """Receipts with document lists, back to long report rows."""
    docs = aggregate_documents(dd.dd_report(files(spark, sf_dir), ("usr", "grp")), ["g1"])
    return report_from_documents(docs)


@query(
    "validity_counts",
    f"""WITH {FILES_SQL} SELECT CAST(count(*) AS BIGINT) AS total_rows,
      CAST(count(*) FILTER (WHERE gid % 5 <> 0) AS BIGINT) AS valid_rows,
      CAST(count(*) FILTER (WHERE gid % 5 = 0) AS BIGINT) AS invalid_rows FROM files""",
)
def validity(spark, sf_dir):
    inv = files(spark, sf_dir).withColumn("mtime", F.when(F.col("gid") % 5 != 0, F.col("mtime")))
    return aggregate.validity_counts(inv, ["type", "mode", "uid", "gid", "size", "atime", "ctime", "mtime"])


@query(
    "unpivot_metrics",
    f"""WITH {FILES_SQL} SELECT uid, metric, CAST(sum(value) AS BIGINT) AS total,
      CAST(count(*) AS BIGINT) AS n FROM (
      SELECT uid, 'size' AS metric, size AS value FROM files UNION ALL SELECT uid, 'atime', atime FROM files
      UNION ALL SELECT uid, 'ctime', ctime FROM files UNION ALL SELECT uid, 'mtime', mtime FROM files)
      GROUP BY uid, metric""",
)
def unpivot_metrics(spark, sf_dir):
    rows = long_metrics(files(spark, sf_dir), METRICS, ["uid"])
    return rows.groupBy("uid", "metric").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
