"""Change-log queries: parsing, slots, reduction, namespace feeds, summaries kept current."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import aggregate, namespace, reduction, refresh
from ..sources import changelog
from . import query
from .tables import GPFS_SQL, LUSTRE_SQL, gpfs_events, lustre_events, resolver, spread, table


@query(
    "parse_json_events",
    f"""WITH {GPFS_SQL} SELECT eid, inode, inode % 7 = 0 AS is_dir, event_type, path, size, atime, uid FROM gpfs
    WHERE event_type <> 'IN_OPEN' AND inode % 10 <> 3""",
)
def parse_json(spark, sf_dir):
    """Messages with an ignored type, and with an empty path, drop out."""
    ev = gpfs_events(spark, sf_dir)
    flagged = F.when(F.col("inode") % 7 == 0, F.concat("event_type", F.lit(" IN_ISDIR"))).otherwise(F.col("event_type"))
    message = F.to_json(
        F.struct(
            "inode",
            F.when(F.col("inode") % 10 == 3, "").otherwise(F.col("path")).alias("path"),
            flagged.alias("event"),
            F.col("size").alias("fileSize"),
            "atime", "ctime", "mtime", "permissions",
            F.col("uid").alias("ownerUserId"),
            F.col("gid").alias("ownerGroupId"),
        )
    )
    raw = ev.select(F.col("eid").alias("offset"), message.alias("value"))
    good, _ = changelog.parse_gpfs(raw)
    kept = reduction.drop_event_types(good, "IN_OPEN, IN_UNKNOWN")
    return kept.select("eid", "inode", "is_dir", "event_type", "path", "size", "atime", "uid")


@query(
    "reader_audit",
    f"""WITH {GPFS_SQL} SELECT CAST(count(*) AS BIGINT) AS polled,
      CAST(count(*) FILTER (WHERE eid % 11 = 0) AS BIGINT) AS errors,
      CAST(count(*) FILTER (WHERE eid % 11 <> 0 AND event_type = 'IN_OPEN') AS BIGINT) AS ignored,
      CAST(count(*) FILTER (WHERE eid % 11 <> 0 AND event_type <> 'IN_OPEN') AS BIGINT) AS emitted FROM gpfs""",
)
def audit(spark, sf_dir):
    """Every eleventh message is broken JSON."""
    body = F.to_json(F.struct("inode", "path", F.col("event_type").alias("event")))
    raw = gpfs_events(spark, sf_dir).select(
        F.col("eid").alias("offset"), F.when(F.col("eid") % 11 == 0, "{broken").otherwise(body).alias("value")
    )
    return reduction.reader_audit(changelog.tag_gpfs(raw), "IN_OPEN")


def _lines(ev):
    wrap = lambda c: F.concat(F.lit("["), F.col(c), F.lit("]"))
    return ev.select(
        F.concat_ws(
            " ",
            "eid", "event_type", F.lit("12:00:00.0"), F.lit("2024.01.01"), F.lit("0x0"),
            F.concat(F.lit("t="), wrap("target_fid")), F.lit("ef=0xf"),
            F.concat(F.lit("u="), "uid", F.lit(":"), "gid"), F.lit("nid=10.0.0.1@tcp"),
            F.concat(F.lit("p="), wrap("parent_fid")), "name",
            F.concat(F.lit("s="), wrap("source_fid")), F.concat(F.lit("sp="), wrap("source_parent_fid")),
            F.when(F.col("event_type") == "08RENME", F.concat(F.col("name"), F.lit("_old"))),
        ).alias("value")
    )


@query(
    "parse_fid_events",
    f"""WITH {LUSTRE_SQL} SELECT eid, event_type,
      CASE WHEN event_type = '08RENME' THEN '0:0x0:0x0' ELSE fid END AS target_fid, CAST(user_id AS VARCHAR) AS uid,
      CASE WHEN event_type IN ('01CREAT', '06UNLNK', '08RENME') THEN parent END AS parent_fid,
      CASE WHEN event_type IN ('01CREAT', '06UNLNK', '08RENME') THEN name END AS name,
      CASE WHEN event_type = '08RENME' THEN fid END AS source_fid, source_parent AS source_parent_fid,
      CASE WHEN event_type = '08RENME' THEN name || '_old' END AS old_name
    FROM lustre WHERE eid > 100""",
)
def parse_fid(spark, sf_dir):
    good, _ = changelog.parse_lustre(_lines(lustre_events(spark, sf_dir)))
    return changelog.after_record(good, 100).select(
        "eid", "event_type", "target_fid", "uid", "parent_fid", "name", "source_fid", "source_parent_fid", "old_name"
    )


@query(
    "slot_order",
    f"""WITH {GPFS_SQL} SELECT batch_id, eid, min(eid) OVER (PARTITION BY batch_id, inode) AS first_eid,
      CAST(inode AS VARCHAR) AS slot FROM gpfs""",
)
def slots(spark, sf_dir):
    return reduction.slot_order(gpfs_events(spark, sf_dir), "inotify").select("batch_id", "eid", "first_eid", "slot")


def _fold_sql(cases: str) -> str:
    """Kept events per (batch_id, slot) by a fold over lists; input ``ev``."""
    return f"""
    folded AS (
      SELECT batch_id, slot, min(eid) AS first_eid,
        list_reduce(list([{{'e': eid, 't': event_type}}] ORDER BY eid),
          lambda acc, x: CASE {cases} ELSE list_concat(acc, x) END) AS kept
      FROM ev GROUP BY batch_id, slot),
    reduced AS (SELECT batch_id, slot, first_eid, k.e AS eid, k.t AS event_type
      FROM (SELECT batch_id, slot, first_eid, unnest(kept) AS k FROM folded))"""


GPFS_FOLD = _fold_sql(
    """WHEN x[1].t = 'IN_DELETE' AND len(list_filter(acc, lambda k: k.t = 'IN_CREATE')) > 0
       THEN list_filter(acc, lambda k: k.e <> list_max(list_transform(
              list_filter(acc, lambda m: m.t = 'IN_CREATE'), lambda m: m.e)))"""
)
FID_FOLD = _fold_sql(
    """WHEN x[1].t IN ('13TRUNC', '11CLOSE')
         AND len(list_filter(acc, lambda k: k.t IN ('13TRUNC', '11CLOSE', '17MTIME', '01CREAT'))) > 0 THEN acc
       WHEN x[1].t = '06UNLNK' AND list_last(list_filter(acc, lambda k: k.t IN ('01CREAT', '08RENME'))).t = '01CREAT'
       THEN list_filter(acc, lambda k: k.e <> list_last(list_filter(acc, lambda m: m.t IN ('01CREAT', '08RENME'))).e)"""
)


@query(
    "reduce_path_events",
    f"""WITH {GPFS_SQL}, ev AS (SELECT batch_id, CAST(inode AS VARCHAR) AS slot, eid, event_type FROM gpfs), {GPFS_FOLD}
    SELECT batch_id, slot, first_eid, eid, event_type FROM reduced""",
)
def reduce_path(spark, sf_dir):
    ev = spread(gpfs_events(spark, sf_dir))
    return reduction.reduce_events(ev, "inotify").select("batch_id", "slot", "first_eid", "eid", "event_type")


@query(
    "reduce_fid_events",
    f"""WITH {LUSTRE_SQL}, ev AS (SELECT batch_id, fid AS slot, eid, event_type FROM lustre), {FID_FOLD}
    SELECT batch_id, slot, first_eid, eid, event_type FROM reduced""",
)
def reduce_fid(spark, sf_dir):
    out = reduction.pass_through(lustre_events(spark, sf_dir), "fid")
    return out.select("batch_id", "slot", "first_eid", "eid", "event_type")


@query(
    "reduction_audit",
    f"""WITH {LUSTRE_SQL}, ev AS (SELECT batch_id, fid AS slot, eid, event_type FROM lustre), {FID_FOLD},
    r AS (SELECT batch_id, count(*) AS received FROM ev GROUP BY 1),
    a AS (SELECT batch_id, count(*) AS accepted FROM reduced GROUP BY 1)
    SELECT batch_id, CAST(received AS BIGINT) AS received, CAST(received - accepted AS BIGINT) AS reduced,
      CAST(accepted AS BIGINT) AS accepted FROM r JOIN a USING (batch_id)""",
)
def reduction_counts(spark, sf_dir):
    return reduction.reduction_audit(lustre_events(spark, sf_dir), "fid")


@query(
    "event_counts",
    f"""WITH {GPFS_SQL} SELECT event_type, CAST(count(*) AS BIGINT) AS events FROM gpfs GROUP BY 1""",
)
def counts(spark, sf_dir):
    return reduction.event_counts(gpfs_events(spark, sf_dir))


@query(
    "event_rate",
    f"""WITH {GPFS_SQL} SELECT batch_id, CAST(count(*) AS BIGINT) AS events,
      CAST(max(atime) - min(atime) AS BIGINT) AS seconds,
      round(count(*) / CAST(max(atime) - min(atime) AS DOUBLE), 6) AS per_second FROM gpfs GROUP BY 1""",
)
def rate(spark, sf_dir):
    out = reduction.event_rate(gpfs_events(spark, sf_dir), "atime", ["batch_id"])
    return out.withColumn("per_second", F.round("per_second", 6))


@query(
    "poll_batches",
    "SELECT event_id // 128 AS batch_id, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY 1",
)
def polls(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("eid"))
    return changelog.poll_batches(ev, 128).groupBy("batch_id").agg(F.count("*").alias("events"))


def _path_feed_sql(source: str, k: int) -> str:
    """Feed of path events without directories and without shared paths."""
    return f"""
    own AS (SELECT *, eid AS seq FROM {source} WHERE event_type <> 'IN_CLOSE'),
    marked AS (SELECT *, last_value(CASE WHEN event_type IN ('IN_CREATE', 'IN_DELETE') THEN event_type END IGNORE NULLS)
        OVER (PARTITION BY inode ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM own),
    valid AS (SELECT * FROM marked WHERE event_type = 'IN_CREATE' OR before = 'IN_CREATE'),
    state AS (SELECT *, batch_id // {k} AS flush,
        last_value(CASE WHEN event_type IN ('IN_CREATE', 'IN_MOVED_TO') THEN path END IGNORE NULLS)
          OVER (PARTITION BY inode ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now_path,
        last_value(CASE WHEN event_type = 'IN_CREATE' THEN uid END IGNORE NULLS)
          OVER (PARTITION BY inode ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now_uid
      FROM valid),
    flushed AS (SELECT inode, flush, arg_max(event_type, eid) = 'IN_DELETE' AS dead,
        bool_or(event_type = 'IN_DELETE') AS removed, arg_max(now_path, eid) AS path, arg_max(size, eid) AS size,
        arg_max(atime, eid) AS mtime, arg_max(now_uid, eid) AS uid,
        arg_min(now_path, eid) FILTER (WHERE event_type = 'IN_DELETE') AS old_path
      FROM state GROUP BY inode, flush),
    told AS (SELECT *, CASE WHEN removed THEN 'D' ELSE 'U' END AS mark FROM flushed),
    seen AS (SELECT *, lag(mark) OVER (PARTITION BY inode ORDER BY flush) AS earlier FROM told)
    SELECT flush, 'update' AS op, CAST(inode AS VARCHAR) AS fid, path, size, mtime, uid FROM seen WHERE mark = 'U'
    UNION ALL
    SELECT flush, 'delete', CAST(inode AS VARCHAR), old_path, NULL, NULL, NULL FROM seen
    WHERE mark = 'D' AND earlier = 'U'"""


def _path_feed(spark, sf_dir, reduce, k):
    ev = reduction.reduce_events(gpfs_events(spark, sf_dir), "inotify", reduce)
    _, changes = namespace.apply_events(namespace.empty_state(spark), ev, "inotify", flush_every=k)
    return changes.select("flush", "op", "fid", "path", "size", "mtime", "uid")


@query("namespace_path_feed", f"WITH {GPFS_SQL}, {_path_feed_sql('gpfs', 1)}")
def path_feed(spark, sf_dir):
    return _path_feed(spark, sf_dir, False, 1)


@query(
    "namespace_path_feed_reduced",
    f"""WITH {GPFS_SQL}, ev AS (SELECT batch_id, CAST(inode AS VARCHAR) AS slot, eid, event_type FROM gpfs), {GPFS_FOLD},
    kept AS (SELECT gpfs.* FROM gpfs JOIN reduced USING (eid)), {_path_feed_sql('kept', 3)}""",
)
def path_feed_reduced(spark, sf_dir):
    """With rules, emitting after every third batch."""
    return _path_feed(spark, sf_dir, True, 3)


# Which object each rename removes, one event after another: ``live`` has the path of every inode, ``claim`` the
# inode that took every path last, both by number, 0 for none.
CROWD_SQL = GPFS_SQL.replace("gpfs AS", "crowd0 AS").replace("'/u' || user_id AS path", "'/u' || (user_id % 10) AS path") + """,
crowd AS (SELECT *, row_number() OVER (ORDER BY batch_id, first_eid, eid) AS sq
  FROM (SELECT *, min(eid) OVER (PARTITION BY batch_id, inode) AS first_eid FROM crowd0)),
act AS (SELECT *, row_number() OVER (ORDER BY sq) AS i, dense_rank() OVER (ORDER BY path) AS spot
  FROM crowd WHERE event_type IN ('IN_CREATE', 'IN_DELETE', 'IN_MOVED_TO')),
run(i, live, claim, victim) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(CAST(0 AS BIGINT)) FROM range((SELECT max(inode) FROM act))),
         (SELECT list(CAST(0 AS BIGINT)) FROM range((SELECT max(spot) FROM act))), CAST(0 AS BIGINT)
  UNION ALL
  SELECT i, CASE WHEN NOT applies THEN live ELSE list_concat(list_concat(emptied[1:inode - 1], [CASE event_type WHEN 'IN_DELETE' THEN 0 ELSE spot END]), emptied[inode + 1:]) END,
         CASE WHEN NOT applies OR event_type = 'IN_DELETE' THEN claim ELSE list_concat(list_concat(claim[1:spot - 1], [inode]), claim[spot + 1:]) END, victim
  FROM (SELECT *, CASE WHEN victim > 0 THEN list_concat(list_concat(live[1:victim - 1], [CAST(0 AS BIGINT)]), live[victim + 1:]) ELSE live END AS emptied
    FROM (SELECT a.i, a.event_type, a.inode, a.spot, r.live, r.claim, a.event_type = 'IN_CREATE' OR r.live[a.inode] > 0 AS applies,
            CASE WHEN a.event_type = 'IN_MOVED_TO' AND r.live[a.inode] > 0 AND r.claim[a.spot] NOT IN (0, a.inode) AND r.live[r.claim[a.spot]] = a.spot
                 THEN r.claim[a.spot] ELSE 0 END AS victim
          FROM run r JOIN act a ON a.i = r.i + 1))
),
removed AS (
  SELECT 2 * sq AS eid, batch_id, inode, event_type, path, size, atime, uid FROM crowd
  UNION ALL SELECT 2 * sq - 1, batch_id, victim, 'IN_DELETE', NULL, NULL, NULL, NULL FROM run JOIN act USING (i) WHERE victim > 0
)"""


@query("namespace_path_collisions", f"WITH RECURSIVE {CROWD_SQL}, changes AS (WITH {_path_feed_sql('removed', 1)}) SELECT flush, op, fid, path, size FROM changes")
def path_collisions(spark, sf_dir):
    """Inodes share paths, so renames remove other files."""
    ev = reduction.reduce_events(gpfs_events(spark, sf_dir, crowded=True), "inotify", False)
    _, changes = namespace.apply_events(namespace.empty_state(spark), ev, "inotify")
    return changes.select("flush", "op", "fid", "path", "size")


def _fid_feed_sql(stat: bool) -> str:
    listed = "CAST(substr(fid, 2) AS BIGINT) % 3 <> 0" if stat else "true"
    folders = "false" if stat else "true"
    return f"""
    ordered AS (SELECT *, {{'b': batch_id, 'f': min(eid) OVER (PARTITION BY batch_id, fid), 'e': eid}} AS seq FROM lustre),
    anchors AS (SELECT parent AS dir, min(seq) AS since FROM ordered WHERE event_type = '01CREAT' GROUP BY 1),
    marked AS (SELECT o.*, coalesce(since < seq, false) AS up,
        last_value(CASE WHEN event_type IN ('01CREAT', '06UNLNK') THEN event_type END IGNORE NULLS)
          OVER (PARTITION BY fid ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM ordered o LEFT JOIN anchors ON parent = dir),
    valid AS (SELECT * FROM marked WHERE (event_type = '01CREAT' OR before = '01CREAT') AND event_type <> '11CLOSE'),
    lost AS (SELECT *, last_value(CASE WHEN event_type = '01CREAT' THEN false
            WHEN event_type = '08RENME' AND NOT up THEN true END IGNORE NULLS)
          OVER (PARTITION BY fid ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lost_now FROM valid),
    placed AS (SELECT *, last_value(CASE WHEN event_type IN ('01CREAT', '08RENME') AND NOT lost_now THEN '/m/' || parent || '/' || name END IGNORE NULLS)
          OVER (PARTITION BY fid ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now_path FROM lost),
    flushed AS (SELECT fid, batch_id AS flush, bool_or(event_type = '06UNLNK') AS removed,
        CASE WHEN NOT arg_max(lost_now, eid) THEN arg_max(now_path, eid) END AS path,
        arg_min(CASE WHEN lost_now THEN 'FileRemoved' ELSE now_path END, eid) FILTER (WHERE event_type = '06UNLNK') AS old_path
      FROM placed GROUP BY fid, batch_id),
    told AS (SELECT *, CASE WHEN removed THEN 'D' WHEN path IS NOT NULL AND {listed} THEN 'U' END AS mark FROM flushed),
    seen AS (SELECT *, lag(mark) OVER (PARTITION BY fid ORDER BY flush) AS earlier FROM told WHERE mark IS NOT NULL),
    dirs AS (
      SELECT parent AS dir, batch_id AS flush FROM valid WHERE event_type IN ('01CREAT', '06UNLNK')
      UNION SELECT parent, batch_id FROM ordered WHERE event_type = '08RENME'
      UNION SELECT source_parent, batch_id FROM ordered WHERE event_type = '08RENME')
    SELECT flush, 'update' AS op, fid, path FROM seen WHERE mark = 'U'
    UNION ALL SELECT flush, 'delete', fid, old_path FROM seen WHERE mark = 'D' AND earlier = 'U'
    UNION ALL SELECT flush, 'update', dir, '/m/' || dir FROM dirs JOIN anchors USING (dir)
      WHERE since.b <= flush AND {folders}"""


def _fid_feed(spark, sf_dir, stat=None):
    ev = reduction.reduce_events(lustre_events(spark, sf_dir), "fid", False)
    return namespace.apply_events(
        namespace.empty_state(spark), ev, "fid", resolver(spark, sf_dir), stat=stat
    )


@query("namespace_fid_feed", f"WITH {LUSTRE_SQL}, {_fid_feed_sql(False)}")
def fid_feed(spark, sf_dir):
    return _fid_feed(spark, sf_dir)[1].select("flush", "op", "fid", "path")


@query("namespace_fid_feed_stat", f"WITH {LUSTRE_SQL}, {_fid_feed_sql(True)}")
def fid_feed_stat(spark, sf_dir):
    """Only two files in three have attributes at emission; the others give no update."""
    ev = table(spark, sf_dir, "events")
    users = ev.select("user_id").distinct().filter(F.col("user_id") % 3 != 0)
    # every place where a listed file may be
    spots = ev.select("user_id", F.get_json_object("props", "$.k").alias("k")).distinct().join(users, "user_id")
    stat = spots.select(
        F.concat(F.lit("/m/d"), F.col("k"), F.lit("/f"), F.col("user_id").cast("string")).alias("path"),
        F.col("user_id").alias("size"),
    )
    return _fid_feed(spark, sf_dir, stat)[1].select("flush", "op", "fid", "path")


@query(
    "state_children",
    f"""WITH {LUSTRE_SQL}, {_fid_feed_sql(False).split("flushed AS")[0].rstrip().rstrip(',')},
    final AS (SELECT fid, arg_max(event_type = '06UNLNK', eid) AS dead, arg_max(lost_now, eid) AS lost,
        arg_max(now_path, eid) AS path FROM placed GROUP BY fid)
    SELECT split_part(path, '/', 3) AS fid, CAST(count(*) AS BIGINT) AS children,
      string_agg(fid, ',' ORDER BY fid) AS listed FROM final WHERE NOT dead AND NOT lost GROUP BY 1""",
)
def children(spark, sf_dir):
    state = _fid_feed(spark, sf_dir)[0]
    snapshot = namespace.state_snapshot(state).filter(F.col("children").isNotNull())
    return snapshot.join(namespace.child_counts(state).withColumnRenamed("children", "n"), "fid").select(
        "fid", F.col("n").alias("children"), F.array_join("children", ",").alias("listed")
    )


@query(
    "state_children_long",
    f"""WITH {LUSTRE_SQL}, {_fid_feed_sql(False).split("flushed AS")[0].rstrip().rstrip(',')},
    final AS (SELECT fid, arg_max(event_type = '06UNLNK', eid) AS dead, arg_max(lost_now, eid) AS lost,
        arg_max(now_path, eid) AS path FROM placed GROUP BY fid)
    SELECT split_part(path, '/', 3) AS fid, fid AS child FROM final WHERE NOT dead AND NOT lost""",
)
def children_long(spark, sf_dir):
    """A row for each child, whatever the directory holds."""
    return namespace.state_children(_fid_feed(spark, sf_dir)[0])


@query(
    "resolve_fids",
    f"""WITH {LUSTRE_SQL} SELECT eid, parent AS parent_fid, '/m/' || parent AS resolved FROM lustre
    WHERE event_type = '01CREAT'""",
)
def resolve(spark, sf_dir):
    ev = lustre_events(spark, sf_dir).filter(F.col("event_type") == "01CREAT")
    return namespace.resolve_fids(ev, resolver(spark, sf_dir), "parent_fid").select("eid", "parent_fid", "resolved")


@query(
    "refresh_aggregates",
    f"""WITH {GPFS_SQL}, feed AS (WITH {_path_feed_sql('gpfs', 1)}),
    last AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY fid ORDER BY flush DESC) = 1),
    first AS (SELECT * FROM feed WHERE flush < 3 QUALIFY row_number() OVER (PARTITION BY fid ORDER BY flush DESC) = 1),
    base AS (SELECT fid FROM first WHERE op = 'update'),
    live AS (SELECT * FROM last WHERE op = 'update')
    SELECT 'user' AS kind, CAST(uid AS VARCHAR) AS name, CAST(count(*) AS BIGINT) AS count,
      CAST(sum(size) AS BIGINT) AS size_sum, max(mtime) AS mtime_max FROM live GROUP BY ALL
    UNION ALL SELECT 'prefix', '/' || split_part(path, '/', 2), CAST(count(*) AS BIGINT), CAST(sum(size) AS BIGINT),
      max(mtime) FROM live GROUP BY ALL""",
)
def refreshed(spark, sf_dir):
    """Summaries after three flushes, brought up to date with the rest of the feed."""
    ev = reduction.reduce_events(gpfs_events(spark, sf_dir), "inotify", False)
    _, changes = namespace.apply_events(namespace.empty_state(spark), ev, "inotify")
    dims, columns = ("usr", "dir"), ["fid", "path", "size", "atime", "ctime", "mtime", "uid", "gid"]
    early = refresh.latest_changes(changes.filter("flush < 3"))
    before = early.filter(F.col("op") == "update").select(*columns)
    partials = aggregate.key_partials(before, dims, 1, 5)
    fresh = refresh.refresh_aggregates(partials, before, changes.filter("flush >= 3"), dims, 1, 5)
    return fresh.select(
        "kind", "name", "count",
        aggregate.joined_sum("size_hi", "size_lo").cast("long").alias("size_sum"), "mtime_max",
    )
