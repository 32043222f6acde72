"""Key counts: per worker bucket, rolled up, totalled and verified."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .dimensions import DIMS, KINDS, explode_dimensions, spread_to_ancestors, wanted_dims


def key_counts(inv: DataFrame, dims: Sequence[str] = DIMS, lo: int = 1, hi: int = 5) -> DataFrame:
    """Rows per kind, name and worker; directories by their deepest prefix only.

    ``inv`` carries the snapshot line, whose checksum picks the worker bucket.
    """
    bucketed = inv.withColumn("_w", paths.worker_bucket("line"))
    keys = explode_dimensions(bucketed, dims, lo, hi, deepest=True, worker="_w")
    return keys.groupBy("kind", "name", "worker").agg(F.count("*").alias("count"))


def rollup_prefixes(counts: DataFrame, lo: int = 1, hi: int = 5) -> DataFrame:
    """Add the count of each deepest prefix to every directory above it."""
    spread = spread_to_ancestors(counts, lo, hi)
    keys = [c for c in spread.columns if c != "count"]
    return spread.groupBy(*keys).agg(F.sum("count").alias("count"))


def shrink_workers(counts: DataFrame) -> DataFrame:
    """Coarser buckets for deep directories, counts added up again."""
    slashes = F.length("name") - F.length(F.replace("name", F.lit("/"), F.lit("")))
    worker = F.when(F.col("kind") == "prefix", paths.shrink_worker("worker", slashes)).otherwise(
        F.col("worker")
    )
    return (
        counts.withColumn("worker", worker)
        .groupBy("kind", "name", "worker")
        .agg(F.sum("count").alias("count"))
    )


def total_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("kind", "name").agg(F.sum("count").alias("count"))


def latest_counts(messages: DataFrame, offset: str = "offset") -> DataFrame:
    """Last running total per key: later messages replace earlier ones."""
    return messages.groupBy("kind", "name", "worker").agg(
        F.max_by("count", offset).alias("count")
    )


def expected_counts(
    counts: DataFrame, dims: Sequence[str] = DIMS, lo: int = 1, hi: int = 5
) -> tuple[DataFrame, DataFrame]:
    """``(per worker, per key)`` counts of the wanted kinds and directory levels."""
    kinds = [KINDS[d] for d in wanted_dims(dims)]
    level = paths.depth("name")
    wanted = F.col("kind").isin(*kinds) & (
        (F.col("kind") != "prefix") | ((level >= lo) & (level < hi))
    )
    kept = counts.filter(wanted)
    per_worker = kept.groupBy("kind", "name", "worker").agg(F.sum("count").alias("count"))
    return per_worker, total_counts(kept)


def verify_totals(per_worker: DataFrame, totals: DataFrame) -> DataFrame:
    """Keys whose worker counts do not add up to the stated total; empty when all is well."""
    summed = total_counts(per_worker).withColumnRenamed("count", "worker_sum")
    joined = totals.join(summed, ["kind", "name"], "full_outer")
    return joined.filter(~F.col("count").eqNullSafe(F.col("worker_sum")))


def key_cardinality(counts: DataFrame) -> DataFrame:
    """Number of keys per kind and directory level, with and without the worker bucket.

    Counting distinct keys is two plain aggregations here, not a distinct expand.
    """
    level = F.when(F.col("kind") == "prefix", paths.depth("name"))
    per_key = counts.groupBy("kind", "name").agg(
        F.count_distinct("worker").alias("_workers")
    )
    return (
        per_key.withColumn("level", level)
        .groupBy("kind", "level")
        .agg(F.count("*").alias("keys"), F.sum("_workers").alias("worker_keys"))
    )


def order_columns(worker: bool = True) -> list[Column]:
    """Report order: users, groups, directories; numbers numerically, paths by depth."""
    kind = F.when(F.col("kind") == "user", 0).when(F.col("kind") == "group", 1).otherwise(2)
    slashes = F.length("name") - F.length(F.replace("name", F.lit("/"), F.lit("")))
    number = F.when(F.col("kind") != "prefix", F.col("name").try_cast("long"))
    columns = [kind, F.when(F.col("kind") == "prefix", slashes), number, F.col("name")]
    return columns + ([F.col("worker")] if worker else [])


def report_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*order_columns("worker" in df.columns))


def complete_keys(partials: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial summaries whose row count has reached the expected one.

    A key with another count stays out, as it would wait for ever on a stream. A key
    without an expected count is an error and comes back with a null ``expected``.
    """
    joined = partials.join(expected.withColumnRenamed("count", "expected"), list(keys), "left")
    return joined.filter(F.col("expected").isNull() | (F.col("expected") == F.col("count")))
