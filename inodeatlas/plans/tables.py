"""Views of the given tables in the shapes the operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share out a scan that has fewer splits than the cluster has cores.

    A table of many files already has enough splits and is left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def epoch(c: str) -> Column:
    """Whole seconds since 1970, the same for both kinds of timestamp column."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows: one file per line item, in five directory levels."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    line = spread(line).withColumn("atime", epoch("l_shipdate"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", epoch("o_orderdate").alias("ctime")
    )
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # the smaller tables meet first: the rows of line items are shuffled once; either side may be the small one
    owned = (
        spread(orders).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    joined = line.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    link = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")
    mode = F.when(F.col("l_returnflag") == "A", 33188).when(F.col("l_returnflag") == "N", 33261)
    leaf = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    return joined.select(
        F.when(link, "l").otherwise("f").alias("type"),
        mode.otherwise(33204).alias("mode"),
        F.col("c_custkey").alias("uid"),
        F.col("c_nationkey").cast("long").alias("gid"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"),
        "atime",
        "ctime",
        F.greatest("atime", "ctime").alias("mtime"),
        F.col("c_mktsegment").alias("fileset"),
        F.concat(
            F.lit("/"),
            F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name", "o_orderkey", leaf),
        ).alias("path"),
    )


FILES_SQL = """
files AS (
  SELECT CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 'l' ELSE 'f' END AS type,
         CASE l_returnflag WHEN 'A' THEN 33188 WHEN 'N' THEN 33261 ELSE 33204 END AS mode,
         c_custkey AS uid, CAST(c_nationkey AS BIGINT) AS gid,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS size,
         CAST(epoch(l_shipdate) AS BIGINT) AS atime,
         CAST(epoch(o_orderdate) AS BIGINT) AS ctime,
         greatest(CAST(epoch(l_shipdate) AS BIGINT), CAST(epoch(o_orderdate) AS BIGINT)) AS mtime,
         c_mktsegment AS fileset,
         '/' || r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name || '/' || o_orderkey
             || '/' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of uneven depth: URLs without scheme, query and fragment."""
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("/"), bare).alias("path"),
        F.length("html").cast("long").alias("size"),
        F.substring_index(bare, "/", 1).alias("host"),
    )


WEB_SQL = """
web AS (
  SELECT page_id, '/' || bare AS path, CAST(length(html) AS BIGINT) AS size,
         split_part(bare, '/', 1) AS host
  FROM (SELECT page_id, html,
               regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS bare
        FROM pages)
)"""

# All keys of each file, one row per user, group and directory level.
KEYS_SQL = """
parts AS (SELECT *, string_split(path, '/') AS p FROM files),
keyed AS (
  SELECT 'user' AS kind, CAST(uid AS VARCHAR) AS name, size, atime, ctime, mtime FROM files
  UNION ALL
  SELECT 'group', CAST(gid AS VARCHAR), size, atime, ctime, mtime FROM files
  UNION ALL
  SELECT 'prefix', array_to_string(p[1:k + 1], '/'), size, atime, ctime, mtime
  FROM parts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(p) - 2 >= k
)"""
LONG_SQL = """
long AS (
  SELECT kind, name, 'size' AS metric, size AS value FROM keyed
  UNION ALL SELECT kind, name, 'atime', atime FROM keyed
  UNION ALL SELECT kind, name, 'ctime', ctime FROM keyed
  UNION ALL SELECT kind, name, 'mtime', mtime FROM keyed
)"""


def gpfs_events(spark: SparkSession, sf_dir: str, crowded: bool = False) -> DataFrame:
    """Path-based change log: one event per row of ``events``."""
    return gpfs_rows(table(spark, sf_dir, "events"), crowded)


def gpfs_rows(events: DataFrame, crowded: bool = False) -> DataFrame:
    """Event rows as path-based changes.

    ``crowded`` lets several inodes share a path, so that renames collide.
    """
    kind = F.col("event_type")
    event = (
        F.when(kind == "signup", "IN_CREATE")
        .when(kind == "click", "IN_MODIFY")
        .when(kind == "error", "IN_DELETE")
        .when(kind == "purchase", "IN_MOVED_TO")
        .otherwise("IN_OPEN")
    )
    folder = F.get_json_object("props", "$.k")
    owner = F.pmod("user_id", F.lit(10)) if crowded else F.col("user_id")
    at = epoch("ts")
    return events.select(
        F.col("event_id").alias("eid"),
        F.floor(F.col("event_id") / 1000).cast("long").alias("batch_id"),
        (F.col("user_id") + 1).alias("inode"),
        F.lit(False).alias("is_dir"),
        event.alias("event_type"),
        F.concat(F.lit("/d"), folder, F.lit("/u"), owner.cast("string")).alias("path"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        at.alias("atime"),
        at.alias("ctime"),
        at.alias("mtime"),
        F.lit("rw-r--r--").alias("permissions"),
        F.col("user_id").alias("uid"),
        F.lit(0).cast("long").alias("gid"),
    )


GPFS_SQL = """
gpfs AS (
  SELECT event_id AS eid, event_id // 1000 AS batch_id, user_id + 1 AS inode,
         CASE event_type WHEN 'signup' THEN 'IN_CREATE' WHEN 'click' THEN 'IN_MODIFY'
              WHEN 'error' THEN 'IN_DELETE' WHEN 'purchase' THEN 'IN_MOVED_TO'
              ELSE 'IN_OPEN' END AS event_type,
         '/d' || json_extract_string(props, '$.k') || '/u' || user_id AS path,
         CAST(round(value * 100) AS BIGINT) AS size, epoch_us(ts) // 1000000 AS atime,
         user_id AS uid
  FROM events
)"""


def lustre_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fid-based change log: one event per row of ``events``."""
    kind = F.col("event_type")
    code = (
        F.when(kind == "signup", "01CREAT")
        .when(kind == "click", "13TRUNC")
        .when(kind == "view", "11CLOSE")
        .when(kind == "error", "06UNLNK")
        .otherwise("08RENME")
    )
    fid = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    parent = F.concat(F.lit("d"), F.get_json_object("props", "$.k"))
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("eid"),
        F.floor(F.col("event_id") / 1000).cast("long").alias("batch_id"),
        code.alias("event_type"),
        fid.alias("fid"),
        parent.alias("parent"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("leaf"),
        F.col("user_id").cast("string").alias("uid"),
    )
    rename = F.col("event_type") == "08RENME"
    structural = F.col("event_type").isin("01CREAT", "06UNLNK", "08RENME")
    # the parent an object had before: that of its previous structural event
    earlier = Window.partitionBy("fid").orderBy("eid").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(structural, F.col("parent")), ignorenulls=True).over(earlier)
    return base.select("*", before.alias("_before")).select(
        "eid",
        "batch_id",
        "event_type",
        F.when(rename, "0:0x0:0x0").otherwise(F.col("fid")).alias("target_fid"),
        "uid",
        F.lit("0").alias("gid"),
        F.when(structural, F.col("parent")).alias("parent_fid"),
        F.when(structural, F.col("leaf")).alias("name"),
        F.when(rename, F.col("fid")).alias("source_fid"),
        F.when(rename, F.coalesce("_before", F.lit("gone"))).alias("source_parent_fid"),
    )


LUSTRE_SQL = """
lustre0 AS (
  SELECT event_id AS eid, event_id // 1000 AS batch_id,
         CASE event_type WHEN 'signup' THEN '01CREAT' WHEN 'click' THEN '13TRUNC'
              WHEN 'view' THEN '11CLOSE' WHEN 'error' THEN '06UNLNK' ELSE '08RENME' END AS event_type,
         'u' || user_id AS fid, 'd' || json_extract_string(props, '$.k') AS parent,
         'f' || user_id AS name, user_id
  FROM events
),
lustre AS (
  SELECT *, CASE WHEN event_type = '08RENME' THEN coalesce(
             last_value(CASE WHEN event_type IN ('01CREAT', '06UNLNK', '08RENME') THEN parent END
                        IGNORE NULLS) OVER (PARTITION BY fid ORDER BY eid
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'gone') END AS source_parent
  FROM lustre0
)"""


def resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known paths of directories that the change log never created."""
    folder = F.get_json_object("props", "$.k")
    return (
        table(spark, sf_dir, "events")
        .select(F.concat(F.lit("d"), folder).alias("fid"), F.concat(F.lit("/m/d"), folder).alias("path"))
        .distinct()
    )


# The logs with directories: the first DIRS events make directories, TOPS of them at the top, the others
# below one of these; later events move the others about and work on files below all of them.
DIRS, TOPS, POLL = 60, 12, 500


def _tree_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``i``, ``u``, the lower directory ``d`` that they speak of, and whether they move it."""
    i, u = F.col("i"), F.col("u")
    rows = table(spark, sf_dir, "events").select("*", F.col("event_id").alias("i"), F.col("user_id").alias("u"))
    moves = (F.col("event_type") == "purchase") & (i % 7 == 0) & (i >= DIRS)
    lower = F.when(moves, i).otherwise(u + i) % (DIRS - TOPS) + TOPS
    return rows.select("*", moves.alias("moves"), lower.alias("d"), F.floor(i / POLL).cast("long").alias("batch_id"))


def tree_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fid-based change log with nested directories that move; holds all event types."""
    i, u, kind = F.col("i"), F.col("u"), F.col("event_type")
    leaf_dir = u % 10 == 9  # directories that stay empty
    name = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    touched = F.array(*map(F.lit, ("13TRUNC", "14SATTR", "17MTIME", "18CTIME", "19ATIME")))
    code = (
        F.when(i < DIRS, "02MKDIR").when(kind == "purchase", "08RENME")
        .when(kind == "signup", F.when(leaf_dir, "02MKDIR").otherwise("01CREAT"))
        .when(kind == "error", F.when(leaf_dir, "07RMDIR").otherwise("06UNLNK"))
        .when(kind == "click", F.element_at(touched, (i % 5 + 1).cast("int")))
        .otherwise(F.when(i % 2 == 0, "10OPEN").otherwise("11CLOSE"))
    )
    fid = F.when(i < DIRS, name("D", i)).when(F.col("moves"), name("D", F.col("d"))).when(leaf_dir, name("S", u)).otherwise(name("F", u))
    parent = (
        F.when(i < TOPS, "root").when((i < DIRS) | F.col("moves"), name("D", i % TOPS)).otherwise(name("D", (u + i) % DIRS))
    )
    leaf = F.when(i < DIRS, name("n", i)).when(F.col("moves"), F.concat(name("n", F.col("d")), name("_", i))).otherwise(F.lower(fid))
    base = _tree_columns(spark, sf_dir).select(
        i.alias("eid"), "batch_id", code.alias("event_type"), fid.alias("fid"), parent.alias("parent"), leaf.alias("leaf"), u.cast("string").alias("uid")
    )
    rename = F.col("event_type") == "08RENME"
    structural = F.col("event_type").isin("01CREAT", "02MKDIR", "06UNLNK", "07RMDIR", "08RENME")
    earlier = Window.partitionBy("fid").orderBy("eid").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(structural, F.col("parent")), ignorenulls=True).over(earlier)
    return base.select("*", before.alias("_before")).select(
        "eid",
        "batch_id",
        "event_type",
        F.when(rename, "0:0x0:0x0").otherwise(F.col("fid")).alias("target_fid"),
        "uid",
        F.lit("0").alias("gid"),
        F.when(structural, F.col("parent")).alias("parent_fid"),
        F.when(structural, F.col("leaf")).alias("name"),
        F.when(rename, F.col("fid")).alias("source_fid"),
        F.when(rename, F.coalesce("_before", F.lit("gone"))).alias("source_parent_fid"),
    )


TREE_SQL = f"""
numbered AS (
  SELECT event_id AS i, user_id AS u, event_type AS kind, event_id // {POLL} AS batch_id,
         event_type = 'purchase' AND event_id % 7 = 0 AND event_id >= {DIRS} AS moves, user_id % 10 = 9 AS leaf_dir FROM events
),
lower_dirs AS (SELECT *, CASE WHEN moves THEN i ELSE u + i END % {DIRS - TOPS} + {TOPS} AS d FROM numbered),
tree0 AS (
  SELECT i AS eid, batch_id, u,
         CASE WHEN i < {DIRS} THEN '02MKDIR' WHEN kind = 'purchase' THEN '08RENME'
              WHEN kind = 'signup' THEN CASE WHEN leaf_dir THEN '02MKDIR' ELSE '01CREAT' END
              WHEN kind = 'error' THEN CASE WHEN leaf_dir THEN '07RMDIR' ELSE '06UNLNK' END
              WHEN kind = 'click' THEN ['13TRUNC', '14SATTR', '17MTIME', '18CTIME', '19ATIME'][i % 5 + 1]
              WHEN i % 2 = 0 THEN '10OPEN' ELSE '11CLOSE' END AS event_type,
         CASE WHEN i < {DIRS} THEN 'D' || i WHEN moves THEN 'D' || d WHEN leaf_dir THEN 'S' || u ELSE 'F' || u END AS fid,
         CASE WHEN i < {TOPS} THEN 'root' WHEN i < {DIRS} OR moves THEN 'D' || (i % {TOPS}) ELSE 'D' || ((u + i) % {DIRS}) END AS parent,
         CASE WHEN i < {DIRS} THEN 'n' || i WHEN moves THEN 'n' || d || '_' || i WHEN leaf_dir THEN 's' || u ELSE 'f' || u END AS name
  FROM lower_dirs
),
tree AS (
  SELECT *, CASE WHEN event_type = '08RENME' THEN coalesce(
             last_value(CASE WHEN event_type IN ('01CREAT', '02MKDIR', '06UNLNK', '07RMDIR', '08RENME') THEN parent END IGNORE NULLS)
               OVER (PARTITION BY fid ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'gone') END AS source_parent
  FROM tree0
)"""


def path_tree_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-based change log with nested directories; a lower one moves away and comes back."""
    i, u, d, kind = F.col("i"), F.col("u"), F.col("d"), F.col("event_type")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    event = (
        F.when((i < DIRS) | (kind == "signup"), "IN_CREATE").when(kind == "click", "IN_MODIFY").when(kind == "error", "IN_DELETE")
        .when(kind == "purchase", "IN_MOVED_TO").otherwise("IN_OPEN")
    )
    home = text("/t", d % TOPS, "/s", d)
    path = (
        F.when(i < TOPS, text("/t", i)).when(i < DIRS, text("/t", i % TOPS, "/s", i))
        .when(F.col("moves"), F.when(i % 2 == 0, home).otherwise(text("/t", i % TOPS, "/s", d, "_", i)))
        .otherwise(F.concat(home, text("/u", u)))
    )
    number = F.when(i < DIRS, 10_000_000 + i).when(F.col("moves"), 10_000_000 + d).otherwise(u + 1)
    return _tree_columns(spark, sf_dir).select(
        i.alias("eid"),
        "batch_id",
        number.cast("long").alias("inode"),
        ((i < DIRS) | F.col("moves") | (u % 10 == 9)).alias("is_dir"),
        event.alias("event_type"),
        path.alias("path"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        *[i.alias(c) for c in ("atime", "ctime", "mtime")],
        F.lit("rw-r--r--").alias("permissions"),
        u.alias("uid"),
        F.lit(0).cast("long").alias("gid"),
    )


PATH_TREE_SQL = TREE_SQL.split("tree0 AS")[0] + f"""
ptree AS (
  SELECT i AS eid, batch_id,
         CASE WHEN i < {DIRS} OR kind = 'signup' THEN 'IN_CREATE' WHEN kind = 'click' THEN 'IN_MODIFY' WHEN kind = 'error' THEN 'IN_DELETE'
              WHEN kind = 'purchase' THEN 'IN_MOVED_TO' ELSE 'IN_OPEN' END AS event_type,
         CAST(CASE WHEN i < {DIRS} THEN 10000000 + i WHEN moves THEN 10000000 + d ELSE u + 1 END AS VARCHAR) AS fid, i < {DIRS} OR moves AS holds,
         CASE WHEN i < {TOPS} THEN '/t' || i WHEN i < {DIRS} THEN '/t' || (i % {TOPS}) || '/s' || i
              WHEN moves AND i % 2 <> 0 THEN '/t' || (i % {TOPS}) || '/s' || d || '_' || i
              WHEN moves THEN '/t' || (d % {TOPS}) || '/s' || d ELSE '/t' || (d % {TOPS}) || '/s' || d || '/u' || u END AS path
  FROM lower_dirs
)"""
