"""Quantiles from logarithmic buckets with a relative accuracy guarantee (Masson et al., 2019).

The sketch is a table ``(kind, name, metric, bucket, cnt, ...)``: adding values is a
grouped count, merging is a grouped sum. Integers of 64 bits use about 4,400 buckets
at one percent accuracy, so a window over the buckets of one key is always small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import METRICS, QUANTILES
from .aggregate import LOW_BITS, LOW_MASK, joined_sum
from .dimensions import DIMS, long_metrics, sized_rows, together

ALPHA = 0.01
# Positive buckets start above this number, negative ones mirror them below zero.
ORIGIN = 1 << 20


def gamma(alpha: float = ALPHA) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket_of(value: Column | str, alpha: float = ALPHA) -> Column:
    """Bucket number of an integer; order of buckets is order of values."""
    v = F.col(value) if isinstance(value, str) else value
    index = F.ceil(F.ln(F.abs(v).cast("double")) / F.lit(math.log(gamma(alpha)))).cast("int")
    return (
        F.when(v > 0, index + ORIGIN).when(v == 0, F.lit(0)).when(v < 0, -(index + ORIGIN))
    )


def bucket_value(bucket: Column | str, alpha: float = ALPHA) -> Column:
    """Value that stands for a bucket."""
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    g = gamma(alpha)
    size = F.pow(F.lit(g), (F.abs(b) - ORIGIN).cast("double")) * F.lit(2.0 / (1 + g))
    return F.when(b > 0, size).when(b == 0, F.lit(0.0)).otherwise(-size)


def bucket_table(rows: DataFrame, keys: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """Sketch of ``value`` per key, with the exact sum, minimum and maximum riding along."""
    v = F.col("value")
    return (
        rows.withColumn("bucket", bucket_of("value", alpha))
        .groupBy(*keys, "bucket")
        .agg(
            F.count("*").alias("cnt"),
            F.sum(F.shiftright(v, LOW_BITS)).alias("hi"),
            F.sum(v.bitwiseAND(F.lit(LOW_MASK))).alias("lo"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )


def merge_buckets(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tables.groupBy(*keys, "bucket").agg(
        F.sum("cnt").alias("cnt"),
        F.sum("hi").alias("hi"),
        F.sum("lo").alias("lo"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def sized_buckets(
    inv: DataFrame, dims: Sequence[str] = DIMS, lo: int = 1, hi: int = 5, alpha: float = ALPHA
) -> tuple[DataFrame, DataFrame]:
    """Bucket tables of small keys, whose rows are brought together first, and of large ones, combined in the mapper."""
    small, large = sized_rows(inv, dims, lo, hi)
    return tuple(bucket_table(long_metrics(rows, METRICS, ["kind", "name"]), ["kind", "name", "metric"], alpha) for rows in (together(small), large))


def key_buckets(
    inv: DataFrame, dims: Sequence[str] = DIMS, lo: int = 1, hi: int = 5, alpha: float = ALPHA
) -> DataFrame:
    """Bucket tables of all keys and metrics."""
    small, large = sized_buckets(inv, dims, lo, hi, alpha)
    return small.unionByName(large)


def dd_quantiles(
    buckets: DataFrame,
    keys: Sequence[str] = ("kind", "name", "metric"),
    quantiles: dict[str, float] = QUANTILES,
    alpha: float = ALPHA,
) -> DataFrame:
    """Report rows: count, min, quantiles, max, mean, sum.

    The answer is the first bucket whose running count exceeds ``q * (n - 1)``. The
    window and the aggregation need the same partitioning: one shuffle.
    """
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = buckets.select(
        "*", F.sum("cnt").over(running).alias("cum"), F.sum("cnt").over(per_key).alias("n")
    )
    hits = [
        F.min(F.when(F.col("cum") > F.lit(q) * (F.col("n") - 1), F.col("bucket"))).alias(label)
        for label, q in quantiles.items()
    ]
    grouped = placed.groupBy(*keys).agg(
        F.sum("cnt").alias("count"),
        F.sum("hi").alias("hi"),
        F.sum("lo").alias("lo"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        *hits,
    )
    total = joined_sum("hi", "lo")
    return grouped.select(
        *keys,
        "count",
        "min",
        *[bucket_value(label, alpha).cast("long").alias(label) for label in quantiles],
        "max",
        text.floor_div(total, "count").alias("mean"),
        total.alias("sum"),
    )


def dd_report(
    inv: DataFrame, dims: Sequence[str] = DIMS, lo: int = 1, hi: int = 5, alpha: float = ALPHA
) -> DataFrame:
    small, large = sized_buckets(inv, dims, lo, hi, alpha)
    return dd_quantiles(small, alpha=alpha).unionByName(dd_quantiles(large, alpha=alpha))
