"""Keep summaries current with a change feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import METRICS
from ..session import cut_lineage
from .aggregate import key_partials
from .dimensions import DIMS, explode_dimensions

KEYS = ["kind", "name"]


def latest_changes(changes: DataFrame) -> DataFrame:
    """Last change per object."""
    body = F.struct(*[c for c in changes.columns if c != "fid"])
    return changes.groupBy("fid").agg(F.max_by(body, "flush").alias("_c")).select("fid", "_c.*")


def merge_primary(before: DataFrame, changes: DataFrame) -> DataFrame:
    """Per-file table after the changes; both sides are keyed by ``fid``."""
    last = latest_changes(changes)
    kept = before.join(last.select("fid"), "fid", "left_anti")
    fresh = last.filter(F.col("op") == "update").select(*before.columns)
    return kept.unionByName(fresh)


def _after_changes(partials: DataFrame, minus: DataFrame, plus: DataFrame) -> DataFrame:
    """Partials less those of the old and plus those of the new versions of files.

    ``lost`` tells whether an extreme went that no new version has replaced: it is the old one here.
    """
    sums = ["count", *(f"{m}_{part}" for m in METRICS for part in ("hi", "lo"))]
    sides = {"p": partials, "m": minus, "a": plus}
    body = {k: df.select(*KEYS, F.struct(*[c for c in df.columns if c not in KEYS]).alias(k)) for k, df in sides.items()}
    joined = body["p"].join(body["m"], KEYS, "full_outer").join(body["a"], KEYS, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = [(zero(f"p.{c}") - zero(f"m.{c}") + zero(f"a.{c}")).cast("long").alias(c) for c in sums]
    lost = F.lit(False)
    for m in METRICS:
        for end, pick in (("min", F.least), ("max", F.greatest)):
            held, gone, new = (F.col(f"{k}.{m}_{end}") for k in ("p", "m", "a"))
            best = pick(held, new)
            # the old extreme has gone with a file, and no new version reaches it
            lost = lost | F.coalesce((gone == held) & (new.isNull() | (best != new)), F.lit(False))
            out.append(best.alias(f"{m}_{end}"))
    return joined.select(*KEYS, *out, lost.alias("lost")).filter("count > 0").select(*partials.columns, "lost")


def _extremes(after: DataFrame, keys: DataFrame, dims: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Least and greatest values of the given keys, from the files that belong to one of them."""
    ends = [f(m).alias(f"{m}_{end}") for m in METRICS for end, f in (("min", F.min), ("max", F.max))]
    found = explode_dimensions(after, dims, lo, hi, keep=METRICS).join(keys, KEYS, "left_semi")
    return found.groupBy(*KEYS).agg(*ends)


def refresh_aggregates(
    partials: DataFrame,
    before: DataFrame,
    changes: DataFrame,
    dims: Sequence[str] = DIMS,
    lo: int = 1,
    hi: int = 5,
) -> DataFrame:
    """Partials after the changes.

    Only the changed files are fanned out to their keys, as they were and as they are: counts and sums of the old
    versions are taken back, those of the new ones added. A minimum or maximum cannot be taken back, so keys that
    lost one, and have no new file that reaches it, read their files again; no others do.
    """
    last = latest_changes(changes)
    old = before.join(last.select("fid"), "fid", "left_semi")
    new = last.filter(F.col("op") == "update").select(*before.columns)
    moved = cut_lineage(_after_changes(partials, key_partials(old, dims, lo, hi), key_partials(new, dims, lo, hi)))
    lost = moved.filter("lost").select(*KEYS)
    if lost.isEmpty():
        return moved.drop("lost")
    read = _extremes(merge_primary(before, changes), lost, dims, lo, hi)
    ends = [c for c in read.columns if c not in KEYS]
    body = read.select(*KEYS, F.struct(*ends).alias("_read"))
    mended = moved.join(body, KEYS, "left")
    return mended.select(*[F.when(F.col("lost"), F.col(f"_read.{c}")).otherwise(F.col(c)).alias(c) if c in ends else F.col(c) for c in partials.columns])
