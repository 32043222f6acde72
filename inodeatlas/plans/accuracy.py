"""Accuracy study: exact ranks, positions, errors of approximate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accuracy, dd
from ..operators.dimensions import explode_dimensions, long_metrics
from ..operators.ranks import cumulative, frequencies, positions, rank_values
from ..schemas import METRICS, QUANTILES
from . import query
from .snapshot import DD_SQL
from .tables import FILES_SQL, files

GID_LONG = """glong AS (
  SELECT gid, 'size' AS metric, size AS value FROM files UNION ALL SELECT gid, 'atime', atime FROM files
  UNION ALL SELECT gid, 'ctime', ctime FROM files UNION ALL SELECT gid, 'mtime', mtime FROM files)"""


@query(
    "rank_values",
    f"""WITH {FILES_SQL}, {GID_LONG} SELECT gid, metric, value,
      row_number() OVER (PARTITION BY gid, metric ORDER BY value) AS rank_1based,
      count(*) OVER (PARTITION BY gid, metric) AS group_size FROM glong""",
)
def ranked_values(spark, sf_dir):
    return rank_values(files(spark, sf_dir), "gid")


@query(
    "quantile_positions",
    f"""WITH {FILES_SQL}, {GID_LONG},
    r AS (SELECT *, row_number() OVER (PARTITION BY gid, metric ORDER BY value) - 1 AS i,
            count(*) OVER (PARTITION BY gid, metric) AS n FROM glong)
    SELECT gid, metric, CAST(n AS BIGINT) AS n,
      {", ".join(f"max(value) FILTER (WHERE i = floor(CAST({q} AS DOUBLE) * (n - 1))) AS {p}" for p, q in QUANTILES.items())}
    FROM r GROUP BY gid, metric, n""",
)
def quantile_positions(spark, sf_dir):
    freq = frequencies(long_metrics(files(spark, sf_dir), METRICS, ["gid"]), ["gid", "metric"])
    return positions(cumulative(freq, ["gid", "metric"]), ["gid", "metric"])


ERRORS_SQL = f"""approx AS (
  SELECT * FROM (SELECT CASE kind WHEN 'user' THEN 'uid' ELSE 'gid' END AS typ, name AS id, metric, 'dd' AS run,
    p10, p25, p50, p75, p90, p99 FROM ({DD_SQL}) WHERE kind <> 'prefix')
  UNPIVOT (approx FOR quantile IN (p10, p25, p50, p75, p90, p99))),
{FILES_SQL},
exact AS (
  SELECT typ, id, metric, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY typ, id, metric) AS n
  FROM (SELECT unnest(['uid', 'gid']) AS typ, unnest([CAST(uid AS VARCHAR), CAST(gid AS VARCHAR)]) AS id,
               size, atime, ctime, mtime FROM files)
  UNPIVOT (value FOR metric IN (size, atime, ctime, mtime))
  WINDOW w AS (PARTITION BY typ, id, metric ORDER BY value)),
asked AS (SELECT *, CAST(CASE quantile WHEN 'p10' THEN 0.1 WHEN 'p25' THEN 0.25 WHEN 'p50' THEN 0.5
    WHEN 'p75' THEN 0.75 WHEN 'p90' THEN 0.9 ELSE 0.99 END AS DOUBLE) AS p FROM approx),
errors AS (
  SELECT typ, id, metric, run, quantile, p, n,
    max(value) FILTER (WHERE rn = floor(p * (n - 1)) + 1) AS exact, approx,
    count(*) FILTER (WHERE value <= approx) AS rank_hat, CAST(floor(p * (n - 1)) + 1 AS BIGINT) AS expected_rank
  FROM asked JOIN exact USING (typ, id, metric) GROUP BY ALL)"""


def _errors(spark, sf_dir):
    inv = files(spark, sf_dir)
    kind = F.when(F.col("kind") == "user", "uid").otherwise("gid").alias("typ")
    rows = explode_dimensions(inv, ("usr", "grp"), keep=METRICS).select(kind, F.col("name").alias("id"), *METRICS)
    report = dd.dd_report(inv, ("usr", "grp"))
    approx = accuracy.stack_labeled({"dd": report}, "run").select(kind, F.col("name").alias("id"), "metric", "run", *QUANTILES)
    return accuracy.row_errors(rows, approx)


@query(
    "rank_errors",
    f"""WITH {ERRORS_SQL} SELECT typ, id, metric, run, quantile, exact, approx, CAST(rank_hat AS BIGINT) AS rank_hat,
      expected_rank, abs(rank_hat - expected_rank) AS rank_error, CAST(n AS BIGINT) AS "N",
      abs(approx - exact) AS abs_val_err, round(abs(approx - exact) / CAST(nullif(abs(exact), 0) AS DOUBLE), 6) AS rel_value_error
    FROM errors""",
)
def errors(spark, sf_dir):
    out = _errors(spark, sf_dir).drop("p", "rank_error_norm")
    return out.withColumn("rel_value_error", F.round("rel_value_error", 6))


@query(
    "error_summary",
    f"""WITH {ERRORS_SQL} SELECT typ, quantile, CAST(count(DISTINCT run) AS BIGINT) AS run_count,
      round(avg(abs(rank_hat - expected_rank) / CAST(n AS DOUBLE)), 6) AS rank_error_norm_mean,
      round(max(abs(rank_hat - expected_rank) / CAST(n AS DOUBLE)), 6) AS rank_error_norm_max,
      round(avg(abs(approx - exact) / CAST(nullif(abs(exact), 0) AS DOUBLE)), 6) AS rel_value_error_mean,
      round(max(abs(approx - exact) / CAST(nullif(abs(exact), 0) AS DOUBLE)), 6) AS rel_value_error_max
    FROM errors WHERE n >= 20 GROUP BY typ, quantile""",
)
def error_summary(spark, sf_dir):
    out = accuracy.summarize_errors(_errors(spark, sf_dir), ["typ", "quantile"], 20)
    return out.select(*[F.round(c, 6).alias(c) if "error" in c else c for c in out.columns])
