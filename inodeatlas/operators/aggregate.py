"""Count, sum, minimum and maximum of four metrics per user, group and directory.

The first aggregation runs on users, groups and the deepest directory only, with
map-side combine; the levels above are added from its small result. No row is ever
shuffled raw, so a key with a third of all files costs the same as any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import METRICS
from .dimensions import DIMS, explode_dimensions, spread_to_ancestors

# A sum of epoch seconds over a few billion files leaves the range of a long. Two long
# sums of the high and low parts stay in range and in generated code.
LOW_BITS = 20
LOW_MASK = (1 << LOW_BITS) - 1


def high(c: str) -> Column:
    return F.shiftright(F.col(c), LOW_BITS)


def low(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit(LOW_MASK))


def joined_sum(hi: str, lo: str) -> Column:
    """Exact sum of the two parts."""
    wide = F.col(hi).cast("decimal(20,0)") * F.lit(1 << LOW_BITS).cast("decimal(8,0)")
    return (wide + F.col(lo).cast("decimal(20,0)")).cast("decimal(38,0)")


def partial_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mergeable partial row per key; the form to save for later merging."""
    aggs = [F.count("*").alias("count")]
    for m in METRICS:
        aggs += [
            F.sum(high(m)).alias(f"{m}_hi"),
            F.sum(low(m)).alias(f"{m}_lo"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
        ]
    return rows.groupBy(*keys).agg(*aggs)


def merge_stats(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    aggs = [F.sum("count").alias("count")]
    for m in METRICS:
        aggs += [
            F.sum(f"{m}_hi").alias(f"{m}_hi"),
            F.sum(f"{m}_lo").alias(f"{m}_lo"),
            F.min(f"{m}_min").alias(f"{m}_min"),
            F.max(f"{m}_max").alias(f"{m}_max"),
        ]
    return partials.groupBy(*keys).agg(*aggs)


def finish_stats(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums and floor averages; averages round towards minus infinity."""
    out = [*keys, "count"]
    for m in METRICS:
        total = joined_sum(f"{m}_hi", f"{m}_lo")
        out += [
            total.alias(f"{m}_sum"),
            F.col(f"{m}_min"),
            F.col(f"{m}_max"),
            text.floor_div(total, "count").alias(f"{m}_avg"),
        ]
    return partials.select(*out)


def key_partials(
    inv: DataFrame, dims: Sequence[str] = DIMS, lo: int = 1, hi: int = 5
) -> DataFrame:
    """Partials of all keys, directories rolled up."""
    rows = explode_dimensions(inv, dims, lo, hi, deepest=True, keep=METRICS)
    first = partial_stats(rows, ["kind", "name"])
    if "dir" not in dims:
        return first
    return merge_stats(spread_to_ancestors(first, lo, hi), ["kind", "name"])


def summary_stats(
    inv: DataFrame, dims: Sequence[str] = DIMS, lo: int = 1, hi: int = 5
) -> DataFrame:
    return finish_stats(key_partials(inv, dims, lo, hi), ["kind", "name"])


def validity_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Total, valid (all columns present) and invalid rows in one pass."""
    valid = F.lit(True)
    for c in columns:
        valid = valid & F.col(c).isNotNull()
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(valid).alias("valid_rows"),
        F.count_if(~valid).alias("invalid_rows"),
    )
