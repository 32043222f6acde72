"""Path arithmetic on string columns.

``substring_index`` cuts a path at the k-th slash without splitting it into an
array, so these stay cheap inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _slashes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def _rooted(path: Column) -> Column:
    return F.concat(F.lit("/"), F.btrim(path, F.lit("/")))


def _cut(rooted: Column, level: Column | int) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.call_function("substring_index", rooted, F.lit("/"), level + 1)


def directory_depth(path: Column | str) -> Column:
    """Number of directories above the last component."""
    return _slashes(_rooted(_col(path))) - 1


def prefix_at(path: Column | str, level: int) -> Column:
    """First ``level`` directories of ``path``; null when the path is too shallow."""
    if level <= 0:
        return F.when(_col(path).isNotNull(), F.lit("/"))
    return F.when(directory_depth(path) >= level, _cut(_rooted(_col(path)), level))


def prefixes(path: Column | str, lo: int, hi: int) -> Column:
    """All directory prefixes with a level in ``[lo, hi)``, shallowest first."""
    return F.array_compact(F.array(*[prefix_at(path, k) for k in range(lo, hi)]))


def deepest_prefix(path: Column | str, lo: int, hi: int) -> Column:
    """The longest directory prefix with a level in ``[lo, hi)``, or null."""
    rooted = _rooted(_col(path))
    if hi - 1 < lo:
        return F.when(F.lit(False), rooted)
    # without its last component a path is its own deepest prefix, or is cut at the highest level
    folder = F.substring(rooted, F.lit(1), F.length(rooted) - F.length(F.substring_index(rooted, "/", -1)) - 1)
    if hi - 1 <= 0:
        return F.lit("/")
    cut = _cut(folder, hi - 1)
    if lo <= 0:
        return F.when(folder == "", F.lit("/")).otherwise(cut)
    return F.when((folder != "") if lo == 1 else (_slashes(folder) >= lo), cut)


def depth(prefix: Column | str) -> Column:
    """Level of a directory prefix; the root has level 0."""
    p = _col(prefix)
    return F.when(p == "/", F.lit(0)).otherwise(_slashes(p))


def ancestor_at(prefix: Column | str, level: int) -> Column:
    """The directory of that level on the way to ``prefix``, itself included; null below it."""
    p = _col(prefix)
    return F.lit("/") if level <= 0 else F.when(depth(p) >= level, _cut(p, level))


def ancestors(prefix: Column | str, lo: int, hi: int) -> Column:
    """A directory prefix and the prefixes above it, levels in ``[lo, hi)``."""
    return F.array_compact(F.array(*[ancestor_at(prefix, k) for k in range(lo, hi)]))


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.rtrim(_col(path), F.lit("/")), "/", -1)


def parent_path(path: Column | str) -> Column:
    """Directory that holds ``path``: ``/`` for top-level names, ``.`` without a slash."""
    p = F.rtrim(_col(path), F.lit("/"))
    head = F.substring(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1)
    return (
        F.when(p == "", F.lit("/"))
        .when(~F.contains(p, F.lit("/")), F.lit("."))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def join_path(parent: Column | str, name: Column | str) -> Column:
    p = _col(parent)
    return F.when(F.endswith(p, F.lit("/")), F.concat(p, _col(name))).otherwise(
        F.concat(p, F.lit("/"), _col(name))
    )


def strip_prefix(path: Column | str, prefix: str) -> Column:
    """Drop a leading mount point when it is present."""
    p = _col(path)
    return F.when(
        F.startswith(p, F.lit(prefix)), F.substring(p, F.lit(len(prefix) + 1), F.length(p))
    ).otherwise(p)


def strip_affixes(path: Column | str, prefix: str, suffix: str) -> Column:
    """Drop both ends; null unless the path has both."""
    p = _col(path)
    kept = F.substring(p, F.lit(len(prefix) + 1), F.length(p) - len(prefix) - len(suffix))
    fits = F.startswith(p, F.lit(prefix)) & F.endswith(p, F.lit(suffix))
    return F.when(fits & (F.length(p) >= len(prefix) + len(suffix)), kept)


def worker_bucket(line: Column | str, n: int = 64) -> Column:
    """Bucket of a whole, unstripped snapshot line."""
    return F.pmod(F.crc32(_col(line)), F.lit(n)).cast("int")


def shrink_worker(worker: Column | str, level: Column | str) -> Column:
    """Fewer buckets for deeper directories: level 2 halves, 3 quarters, 4 and more eighths."""
    w, d = _col(worker), _col(level)
    divisor = F.when(d == 2, 2).when(d == 3, 4).when(d >= 4, 8).otherwise(1)
    return F.floor(w / divisor).cast("int")
