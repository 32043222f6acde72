"""Row layouts, event codes and reduction rules."""

from __future__ import annotations

from pyspark.sql import types as T

METRICS = ("size", "atime", "ctime", "mtime")
QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}
KINDS = {"usr": "user", "grp": "group", "dir": "prefix"}

# Column order of the two snapshot layouts; the path is always last.
SNAPSHOT_COLUMNS = {
    "nine": ("type", "mode", "uid", "gid", "size", "atime", "ctime", "mtime", "path"),
    "ten": ("type", "mode", "uid", "gid", "size", "atime", "ctime", "mtime", "fileset", "path"),
}
INTEGER_COLUMNS = ("mode", "uid", "gid", "size", "atime", "ctime", "mtime")

# Directory levels summarised by default for each layout.
DEFAULT_LEVELS = {"nine": (1, 5), "ten": (0, 5)}

INVENTORY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("uid", T.LongType()),
        T.StructField("gid", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("atime", T.LongType()),
        T.StructField("ctime", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("fileset", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)


def quoted_csv_schema(width: int) -> T.StructType:
    """All-string layout of the quoted CSV scan: eight base columns and the rest unnamed."""
    base = SNAPSHOT_COLUMNS["nine"][:8]
    rest = [f"extra{i}" for i in range(1, width - len(base) + 1)]
    return T.StructType([T.StructField(c, T.StringType()) for c in (*base, *rest)])


# Event names of the path-based change log.
INOTIFY_EVENTS = (
    "IN_ACCESS",
    "IN_ATTRIB",
    "IN_CLOSE_NOWRITE",
    "IN_CLOSE_WRITE",
    "IN_CREATE",
    "IN_DELETE",
    "IN_DELETE_SELF",
    "IN_MODIFY",
    "IN_MOVED_FROM",
    "IN_MOVED_TO",
    "IN_MOVE_SELF",
    "IN_OPEN",
)
# Codes of the fid-based change log.
FID_EVENTS = (
    "01CREAT",
    "02MKDIR",
    "06UNLNK",
    "07RMDIR",
    "08RENME",
    "10OPEN",
    "11CLOSE",
    "13TRUNC",
    "14SATTR",
    "17MTIME",
    "18CTIME",
    "19ATIME",
)
NULL_FID = "0:0x0:0x0"

# What an event does to the namespace; other events change nothing.
INOTIFY_ACTIONS = {
    "create": ("IN_CREATE",),
    "delete": ("IN_DELETE",),
    "rename": ("IN_MOVED_TO",),
    "update": (
        "IN_ACCESS",
        "IN_ATTRIB",
        "IN_CLOSE_NOWRITE",
        "IN_CLOSE_WRITE",
        "IN_MODIFY",
        "IN_OPEN",
    ),
}
FID_ACTIONS = {
    "create": ("01CREAT", "02MKDIR"),
    "delete": ("06UNLNK", "07RMDIR"),
    "rename": ("08RENME",),
    "update": ("13TRUNC", "14SATTR", "17MTIME", "18CTIME", "19ATIME"),
}

# New event -> (what happens, kept events that trigger it).
INOTIFY_RULES = {
    "IN_DELETE": ("cancel", ("IN_CREATE",)),
    "IN_DELETE_SELF": ("cancel", ("IN_CREATE",)),
}
FID_RULES = {
    "13TRUNC": ("ignore", ("13TRUNC", "11CLOSE", "17MTIME", "01CREAT")),
    "11CLOSE": ("ignore", ("13TRUNC", "11CLOSE", "17MTIME", "01CREAT")),
    "17MTIME": ("ignore", ("13TRUNC", "11CLOSE", "17MTIME", "01CREAT", "02MKDIR")),
    "18CTIME": ("ignore", ("18CTIME", "14SATTR", "01CREAT", "02MKDIR")),
    "19ATIME": ("ignore", ("18CTIME", "14SATTR", "01CREAT", "02MKDIR")),
    "14SATTR": ("ignore", ("18CTIME", "14SATTR", "01CREAT", "02MKDIR")),
    "06UNLNK": ("cancel", ("01CREAT",)),
    "07RMDIR": ("cancel", ("02MKDIR",)),
}

GPFS_MESSAGE = T.StructType(
    [
        T.StructField("inode", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("fileSize", T.LongType()),
        T.StructField("atime", T.LongType()),
        T.StructField("ctime", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("permissions", T.StringType()),
        T.StructField("ownerUserId", T.LongType()),
        T.StructField("ownerGroupId", T.LongType()),
    ]
)

# One row per tracked object after the last applied flush.
NAMESPACE_STATE = T.StructType(
    [
        T.StructField("fid", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("anchor", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("atime", T.LongType()),
        T.StructField("ctime", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("permissions", T.StringType()),
        T.StructField("uid", T.LongType()),
        T.StructField("gid", T.LongType()),
        T.StructField("alive", T.BooleanType()),
        T.StructField("emitted", T.BooleanType()),
    ]
)

# Quantile label in a summary document -> report column.
DOCUMENT_LABELS = {
    "10p": "p10",
    "25p": "p25",
    "median": "p50",
    "75p": "p75",
    "90p": "p90",
    "99p": "p99",
}
# Metric -> (field prefix, field suffix) in a summary document.
DOCUMENT_FIELDS = {
    "size": ("file_size", "_in_bytes"),
    "atime": ("access_date", ""),
    "ctime": ("change_date", ""),
    "mtime": ("mod_date", ""),
}

RECEIPT = T.StructType(
    [
        T.StructField("mock", T.BooleanType()),
        T.StructField("msg", T.StringType()),
        T.StructField("succeed", T.BooleanType()),
        T.StructField("data", T.StringType()),
        T.StructField("resp", T.StringType()),
    ]
)
