"""Per-file documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import modes, text


def primary_documents(inv: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One document per file: subject, access list and nested content. A map-only job."""
    mode = modes.mode_to_text("mode")
    stamped = {"access_date": "atime", "change_date": "ctime", "mod_date": "mtime"}
    raw = F.struct(
        F.col("uid").alias("user_id"),
        F.col("gid").alias("group_id"),
        F.col("mode").alias("mode"),
        *[F.col(c).alias(label) for label, c in stamped.items()],
    )
    content = F.struct(
        F.col("type").alias("file_type"),
        F.col("size").alias("file_size"),
        F.col("uid").cast("string").alias("user_id"),
        F.col("gid").cast("string").alias("group_id"),
        modes.mode_first_char(mode).alias("mode_first_char"),
        mode.alias("mode"),
        *[text.utc_text(c).alias(label) for label, c in stamped.items()],
        F.col("path").alias("filename"),
        raw.alias("_raw"),
    )
    return inv.select(
        F.col("path").alias("subject"),
        text.group_urns(groups).alias("visible_to"),
        content.alias("content"),
    )


def document_text(docs: DataFrame) -> DataFrame:
    """JSON text of each document, with its subject for ordering."""
    return docs.select(
        "subject", F.to_json(F.struct("subject", "visible_to", "content")).alias("document")
    )
