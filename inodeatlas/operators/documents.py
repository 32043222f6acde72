"""Summary documents: display text beside raw numbers, and back to report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import DOCUMENT_FIELDS, DOCUMENT_LABELS, METRICS, RECEIPT


def document_fields() -> dict[str, tuple[str, str]]:
    """Document field -> (metric, report column)."""
    fields = {"file_count": ("size", "count"), "file_size_total_in_bytes": ("size", "sum")}
    for metric, (prefix, suffix) in DOCUMENT_FIELDS.items():
        labels = {"average": "mean", **DOCUMENT_LABELS, "min": "min", "max": "max"}
        for label, column in labels.items():
            fields[f"{prefix}_{label}{suffix}"] = (metric, column)
    return fields


def aggregate_documents(report: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One document per key from report rows (kind, name, metric, statistics)."""
    columns = [c for c in report.columns if c not in ("kind", "name", "metric")]
    per_metric = [
        F.first(F.when(F.col("metric") == m, F.struct(*columns)), ignorenulls=True).alias(m)
        for m in METRICS
    ]
    wide = report.groupBy("kind", "name").agg(*per_metric)

    def raw(metric: str, column: str) -> Column:
        return F.col(f"{metric}.{column}").cast("decimal(38,0)" if column == "sum" else "long")

    number = F.col("name").try_cast("long")
    own = {"user_id": "user", "group_id": "group"}
    shown = [F.when(F.col("kind") == k, F.col("name")).alias(f) for f, k in own.items()]
    shown.append(F.when(F.col("kind") == "prefix", F.col("name")).alias("dir"))
    raws = [F.when(F.col("kind") == k, number).alias(f) for f, k in own.items()]
    for field, (metric, column) in document_fields().items():
        value = raw(metric, column)
        raws.append(value.alias(field))
        as_text = value.cast("string") if field.startswith("file_") else text.utc_text(value)
        shown.append(as_text.alias(field))
    content = F.struct(*shown, F.struct(*raws).alias("_raw"))
    return wide.select(
        text.subject("kind", "name").alias("subject"),
        text.group_urns(groups).alias("visible_to"),
        content.alias("content"),
    )


def _raw_schema() -> str:
    fields = ["user_id long", "group_id long"]
    fields += [
        f"{f} decimal(38,0)" if c == "sum" else f"{f} long" for f, (_, c) in document_fields().items()
    ]
    return "struct<" + ", ".join(x.replace(" ", ": ", 1) for x in fields) + ">"


def report_from_documents(docs: DataFrame) -> DataFrame:
    """Long report rows of user and group documents (columns subject, content)."""
    key = text.split_subject("subject")
    raw = F.col("content._raw")
    names = document_fields()

    def row(metric: str) -> Column:
        columns = {c: f for f, (m, c) in names.items() if m == metric and c != "sum"}
        parts = [F.lit(metric).alias("metric"), raw["file_count"].alias("count")]
        for c in ("min", *DOCUMENT_LABELS.values(), "max", "mean"):
            parts.append(raw[columns[c]].alias(c))
        return F.struct(*parts)

    kind = F.when(F.col("k.typ") == "user_id", "user").when(F.col("k.typ") == "group_id", "group")
    return (
        docs.select(key.alias("k"), F.array(*[row(m) for m in METRICS]).alias("rows"))
        .filter(F.col("k.typ").isin("user_id", "group_id"))
        .select(kind.alias("kind"), F.col("k.name").alias("name"), F.inline("rows"))
    )


def receipts_to_report(receipts: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """Report rows of receipt texts; a later receipt of the same key replaces an earlier one."""
    document = f"struct<subject: string, content: struct<_raw: {_raw_schema()}>>"
    data = f"struct<ingest_data: struct<gmeta: array<{document}>>>"
    parsed = receipts.select(
        *([order] if order else []), F.from_json(F.col(column), RECEIPT).alias("r")
    ).filter(F.col("r.succeed") & F.col("r.data").isNotNull())
    listed = F.from_json(F.col("r.data"), data)["ingest_data"]["gmeta"]
    docs = parsed.select(*([order] if order else []), F.explode(listed).alias("d"))
    docs = docs.select(*([order] if order else []), "d.subject", "d.content")
    if order:
        docs = docs.groupBy("subject").agg(F.max_by("content", order).alias("content"))
    return report_from_documents(docs)


def receipt_totals(receipts: DataFrame, column: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Documents and bytes over all receipts, read from their messages; with ``by``, also the receipts of each group."""
    msg = F.from_json(F.col(column), RECEIPT)["msg"]
    pattern = r"ingested (\d+) docs \((\d+) bytes"
    part = lambda i: F.regexp_extract(msg, pattern, i).try_cast("long")
    told = [F.sum(part(1)).alias("documents"), F.sum(part(2)).alias("bytes")]
    return receipts.groupBy(*by).agg(F.count("*").alias("receipts"), *told) if by else receipts.agg(*told)
