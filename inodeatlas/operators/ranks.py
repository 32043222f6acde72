"""Exact ranks and quantiles without ever sorting one large group in one task.

Groups of up to ``HELD`` rows are lists: their rows are shuffled once, as they are, and sorted in place.
For larger groups, which are few, nothing is collected. Equal values are counted first. Distinct 64-bit values are then ranked over three
levels of pages (the value, its upper 44 and its upper 24 bits), so that no window
holds more than 2**24 rows however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import METRICS, QUANTILES
from .aggregate import LOW_BITS, LOW_MASK, joined_sum
from .dimensions import DIMS, HELD, explode_dimensions, large_keys, long_metrics, spread_to_ancestors

PAGE_BITS = 20


def frequencies(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, value, cnt`` of a long table; map-side combine folds repeated values."""
    return rows.groupBy(*keys, "value").agg(F.count("*").alias("cnt"))


def key_frequencies(
    inv: DataFrame, dims: Sequence[str] = DIMS, lo: int = 1, hi: int = 5
) -> DataFrame:
    keys = ["kind", "name", "metric"]
    rows = explode_dimensions(inv, dims, lo, hi, deepest=True, keep=METRICS)
    first = frequencies(long_metrics(rows, METRICS, ["kind", "name"]), keys)
    if "dir" not in dims:
        return first
    spread = spread_to_ancestors(first, lo, hi)
    return spread.groupBy(*keys, "value").agg(F.sum("cnt").alias("cnt"))


def cumulative(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``below`` (rows with a smaller value) and ``n`` (rows of the group)."""
    keys = list(keys)
    rest = [c for c in freq.columns if c not in (*keys, "value", "cnt")]
    paged = freq.select(
        "*",
        F.shiftright("value", PAGE_BITS).alias("_p1"),
        F.shiftright("value", 2 * PAGE_BITS).alias("_p2"),
    )

    def before(amount, window):
        return F.coalesce(
            F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )

    group = Window.partitionBy(*keys)
    top = paged.groupBy(*keys, "_p2").agg(F.sum("cnt").alias("_c2"))
    top = top.select(
        *keys,
        "_p2",
        before("_c2", group.orderBy("_p2")).alias("_o2"),
        F.sum("_c2").over(group).alias("n"),
    )
    pages = paged.groupBy(*keys, "_p2", "_p1").agg(F.sum("cnt").alias("_c1"))
    chapter = Window.partitionBy(*keys, "_p2").orderBy("_p1")
    pages = pages.join(top, [*keys, "_p2"]).select(
        *keys, "_p1", (F.col("_o2") + before("_c1", chapter)).alias("_o1"), "n"
    )
    page = Window.partitionBy(*keys, "_p1").orderBy("value")
    inside = paged.select(*keys, "_p1", "value", "cnt", *rest, before("cnt", page).alias("_o0"))
    return inside.join(pages, [*keys, "_p1"]).select(
        *keys, "value", "cnt", *rest, (F.col("_o1") + F.col("_o0")).alias("below"), "n"
    )


def value_at(index):
    """Value at a zero-based position, as an aggregate over the cumulative table."""
    return F.max(
        F.when(
            (F.col("below") <= index) & (index < F.col("below") + F.col("cnt")), F.col("value")
        )
    )


def exact_quantiles(
    ranked: DataFrame, keys: Sequence[str], quantiles: dict[str, float] = QUANTILES
) -> DataFrame:
    """Count, min, interpolated quantiles (cut to integers), max and mean per group."""
    n1 = F.col("n") - 1
    aggs = []
    for label, q in quantiles.items():
        at = F.lit(q) * n1
        aggs += [
            value_at(F.floor(at)).alias(f"_{label}_a"),
            value_at(F.least(F.floor(at) + 1, n1)).alias(f"_{label}_b"),
        ]
    v = F.col("value")
    grouped = ranked.groupBy(*keys).agg(
        F.max("n").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum(F.shiftright(v, LOW_BITS) * F.col("cnt")).alias("hi"),
        F.sum(v.bitwiseAND(F.lit(LOW_MASK)) * F.col("cnt")).alias("lo"),
        *aggs,
    )
    return _interpolated(grouped, keys, quantiles)


def _interpolated(grouped: DataFrame, keys: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Report rows from the values on both sides of each quantile, sums, extremes and counts."""
    total = joined_sum("hi", "lo")
    out = []
    for label, q in quantiles.items():
        at = F.lit(q) * (F.col("count") - 1)
        t = at - F.floor(at)
        a, b = F.col(f"_{label}_a").cast("double"), F.col(f"_{label}_b").cast("double")
        # interpolate from the nearer end, as the usual numeric libraries do
        mixed = F.when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (1 - t))
        out.append(mixed.cast("long").alias(label))
    return grouped.select(
        *keys,
        "count",
        "min",
        *out,
        "max",
        (total.cast("double") / F.col("count")).alias("mean"),
    )


def split_by_size(rows: DataFrame, keys: Sequence[str], most: int = HELD) -> tuple[DataFrame, DataFrame]:
    """The rows of keys with up to ``most`` rows, and those of larger keys."""
    large = large_keys(rows, keys, most)
    return rows.join(large, list(keys), "left_anti"), rows.join(large, list(keys), "left_semi")


def sorted_lists(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """By key: a sorted list of each metric, nulls first, and its sum in two parts (``_hi``, ``_lo``)."""
    sums = [
        s for m in metrics
        for s in (F.sum(F.shiftright(m, LOW_BITS)).alias(f"{m}_hi"), F.sum(F.col(m).bitwiseAND(F.lit(LOW_MASK))).alias(f"{m}_lo"))
    ]
    # brought together before they are collected: lists of single rows are not worth a combine
    held = rows.select(*keys, *metrics).repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct(*metrics)).alias("_rows"), *sums)
    return held.select(*keys, *[F.sort_array(F.col("_rows")[m]).alias(m) for m in metrics], *[f"{m}_{part}" for m in metrics for part in ("hi", "lo")])


def list_quantiles(
    lists: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS, quantiles: dict[str, float] = QUANTILES
) -> DataFrame:
    """``exact_quantiles`` of sorted lists, by key and metric."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("_v"), F.col(f"{m}_hi").alias("hi"), F.col(f"{m}_lo").alias("lo")) for m in metrics]
    long = lists.select(*keys, F.inline(F.array(*rows)))
    n1 = F.size("_v").cast("long") - 1
    picked = []
    for label, q in quantiles.items():
        at = F.floor(F.lit(q) * n1)
        picked += [F.get("_v", at.cast("int")).alias(f"_{label}_a"), F.get("_v", F.least(at + 1, n1).cast("int")).alias(f"_{label}_b")]
    grouped = long.select(
        *keys, "metric", F.size("_v").cast("long").alias("count"), F.array_min("_v").alias("min"), F.array_max("_v").alias("max"), "hi", "lo", *picked
    ).filter("max is not null")
    return _interpolated(grouped, [*keys, "metric"], quantiles)


def exact_report(
    inv: DataFrame, dims: Sequence[str] = DIMS, lo: int = 1, hi: int = 5
) -> DataFrame:
    keys = ["kind", "name"]
    small, large = split_by_size(explode_dimensions(inv, dims, lo, hi, keep=METRICS), keys)
    freq = frequencies(long_metrics(large, METRICS, keys), [*keys, "metric"])
    ranked = exact_quantiles(cumulative(freq, [*keys, "metric"]), [*keys, "metric"])
    return list_quantiles(sorted_lists(small, keys, METRICS), keys).unionByName(ranked)


def positions(
    ranked: DataFrame, keys: Sequence[str], quantiles: dict[str, float] = QUANTILES
) -> DataFrame:
    """Value at position ``int(p * (n - 1))`` of each sorted group, without interpolation."""
    n1 = F.col("n") - 1
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[value_at(F.floor(F.lit(q) * n1)).alias(label) for label, q in quantiles.items()],
    )


CHUNK = 100_000


def rank_values(inv: DataFrame, group: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Every value of every group with its rank and the group size.

    Copies of a value take consecutive ranks. They are unfolded in chunks that a
    shuffle spreads, so a value with billions of copies does not land in one task.
    """
    keys = [group, "metric"]
    ranked = cumulative(frequencies(long_metrics(inv, metrics, [group]), keys), keys)
    starts = F.sequence(F.lit(0).cast("long"), F.col("cnt") - 1, F.lit(CHUNK).cast("long"))
    chunked = ranked.select("*", F.explode(starts).alias("_s"))
    spread = chunked.repartition(*keys, "value", "_s")
    last = F.least(F.col("_s") + CHUNK, F.col("cnt"))
    ranks = F.sequence(F.col("below") + F.col("_s") + 1, F.col("below") + last)
    return spread.select(
        group,
        "metric",
        "value",
        F.explode(ranks).alias("rank_1based"),
        F.col("n").alias("group_size"),
    )
