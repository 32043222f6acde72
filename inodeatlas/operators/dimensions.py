"""Fan-out of inventory rows to user, group and directory keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schemas import KINDS, METRICS
from ..session import stored

DIMS = ("usr", "grp", "dir")


def wanted_dims(spec: str | Sequence[str]) -> tuple[str, ...]:
    """Dimensions named anywhere in a text such as ``usr+dir``, or given as a sequence."""
    return tuple(d for d in DIMS if d in spec)


def wanted_pipelines(spec: str) -> tuple[str, ...]:
    """Pipelines named anywhere in a text: documents, counts, summaries."""
    return tuple(p for p in ("PRI", "CNT", "SND") if p in spec)


def _key(kind: str, name: Column, worker: Column | None) -> Column:
    parts = [F.lit(KINDS[kind]).alias("kind"), name.cast("string").alias("name")]
    if worker is not None:
        parts.append(worker.alias("worker"))
    return F.struct(*parts)


def explode_dimensions(
    inv: DataFrame,
    dims: Sequence[str] = DIMS,
    lo: int = 1,
    hi: int = 5,
    *,
    deepest: bool = False,
    keep: Sequence[str] = (),
    worker: str | None = None,
) -> DataFrame:
    """Rows ``kind, name[, worker], *keep``.

    ``deepest`` emits only the longest directory prefix: the levels above are sums of
    it and are cheaper to add after the first aggregation. ``worker`` names a bucket
    column; full directory fan-out narrows it with depth.
    """
    dims = wanted_dims(dims)
    bucket = None if worker is None else F.col(worker)
    keys = []
    if "usr" in dims:
        keys.append(_key("usr", F.col("uid"), bucket))
    if "grp" in dims:
        keys.append(_key("grp", F.col("gid"), bucket))
    if "dir" in dims and deepest:
        keys.append(_key("dir", paths.deepest_prefix("path", lo, hi), bucket))
    elif "dir" in dims:
        for level in range(lo, hi):
            narrowed = None if bucket is None else paths.shrink_worker(bucket, F.lit(level))
            keys.append(_key("dir", paths.prefix_at("path", level), narrowed))
    # nulls are filtered after the generator: an array filter would leave generated code, and a name that is asked for
    # in a condition too would be made twice
    exploded = inv.select(F.explode(F.array(*keys)).alias("_k"), *keep)
    return exploded.filter(F.col("_k.name").isNotNull()).select("_k.*", *keep)


def spread_to_ancestors(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Repeat every directory row for the prefixes above it; other kinds pass through."""
    folder = F.col("kind") == "prefix"
    # the first slot also serves the kinds that pass through
    slots = [F.when(folder, paths.ancestor_at("name", lo)).otherwise(F.col("name"))]
    slots += [F.when(folder, paths.ancestor_at("name", k)) for k in range(lo + 1, hi)]
    rest = [c for c in df.columns if c not in ("kind", "name")]
    spread = df.select("kind", F.explode(F.array(*slots)).alias("name"), *rest)
    return spread.filter(F.col("name").isNotNull())


def long_metrics(df: DataFrame, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per metric: ``*keep, metric, value``."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    )
    return df.select(*keep, F.inline(pairs))


HELD = 1 << 15  # rows of a key that a task may hold at once


def large_keys(rows: DataFrame, keys: Sequence[str], most: int = HELD) -> DataFrame:
    """The keys with more than ``most`` rows, stored: at most one for each ``most`` rows."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return stored(counted.filter(F.col("_rows") > most).select(*keys))


def sized_rows(
    inv: DataFrame, dims: Sequence[str] = DIMS, lo: int = 1, hi: int = 5, most: int = HELD
) -> tuple[DataFrame, DataFrame]:
    """Rows ``kind, name, *METRICS`` of all keys with up to ``most`` rows, and those of larger keys.

    Rows of a small key are best brought together as they are: partial results of each task would be larger than
    the rows. Those of the large keys, which are few, are best folded before they leave a task. The files are kept
    without the names that no key needs, and read again from there.
    """
    dims = wanted_dims(dims)
    columns = [c for d, c in (("usr", "uid"), ("grp", "gid")) if d in dims]
    if "dir" in dims:
        # any name below the deepest directory has the same keys
        columns.append(F.concat(paths.deepest_prefix("path", lo, hi), F.lit("/-")).alias("path"))
    kept = stored(inv.select(*columns, *METRICS), "zstd")
    rows = explode_dimensions(kept, dims, lo, hi, keep=METRICS)
    large = large_keys(rows, ["kind", "name"], most)
    return rows.join(large, ["kind", "name"], "left_anti"), rows.join(large, ["kind", "name"], "left_semi")


def together(rows: DataFrame) -> DataFrame:
    """Rows with those of a key in one task; for keys of bounded size."""
    return rows.repartition("kind", "name")
