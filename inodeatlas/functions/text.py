"""Parsing and rendering of the small text forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(BLANKS))


def unquote_field(text: Column | str) -> Column:
    """Drop double quotes on both ends."""
    return F.btrim(_col(text), F.lit('"'))


def strict_long(text: Column | str) -> Column:
    """Long value, or null when the text is not an integer."""
    return strip(text).try_cast("long")


def utc_text(epoch: Column | str) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss +00:00``, whatever the session time zone is."""
    seconds = _col(epoch).cast("decimal(18,6)")
    moment = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )
    return F.concat(moment.cast("string"), F.lit(" +00:00"))


def url_decode(text: Column | str) -> Column:
    """Percent decoding that keeps ``+``; text that does not decode stays as it is."""
    t = _col(text)
    return F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)


def strip_brackets(text: Column | str) -> Column:
    t = _col(text)
    wrapped = F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]")) & (F.length(t) >= 2)
    return F.when(wrapped, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def parse_count_line(line: Column | str, sep: str = ",") -> Column:
    """``type,name,worker,count`` where the name may hold separators; null when malformed."""
    pattern = f"(?s)^(.*?){sep}(.*){sep}(\\d+){sep}(\\d+)$"
    t = strip(line)
    part = [F.regexp_extract(t, pattern, i) for i in range(1, 5)]
    parsed = F.struct(
        part[0].alias("kind"),
        part[1].alias("name"),
        part[2].try_cast("int").alias("worker"),
        part[3].try_cast("long").alias("count"),
    )
    return F.when(F.rlike(t, F.lit(pattern)), parsed)


def count_line(sep: str = ",") -> Column:
    """Inverse of :func:`parse_count_line` over the columns kind, name, worker, count."""
    return F.concat_ws(sep, "kind", "name", "worker", "count")


def size_text(docs: Column | str, size: Column | str) -> Column:
    """Receipt message with document count, bytes and mebibytes."""
    d, b = _col(docs), _col(size)
    return F.concat(
        F.lit("ingested "),
        d.cast("string"),
        F.lit(" docs ("),
        b.cast("string"),
        F.lit(" bytes, "),
        F.format_string("%.2f", b / F.lit(1024.0 * 1024.0)),
        F.lit(" MB)"),
    )


def group_urns(groups: Sequence[str], prefix: str = "urn:group:id:") -> Column:
    """Access list of a document."""
    return F.array(*[F.lit(prefix + g) for g in groups]).cast("array<string>")


def subject(kind: Column | str, name: Column | str) -> Column:
    """Document subject of a summary key."""
    k = _col(kind)
    label = F.when(k == "user", "user_id").when(k == "group", "group_id").when(k == "prefix", "dir")
    return F.concat(label, F.lit("::"), _col(name))


def split_subject(text: Column | str) -> Column:
    t = _col(text)
    return F.struct(
        F.substring_index(t, "::", 1).alias("typ"),
        F.regexp_extract(t, "(?s)^.*?::(.*)$", 1).alias("name"),
    )


def tagged_key(kind: Column | str, name: Column | str) -> Column:
    """Key with a letter tag: ``u12``, ``g3`` or the path itself."""
    k, n = _col(kind), _col(name)
    return (
        F.when(k == "user", F.concat(F.lit("u"), n))
        .when(k == "group", F.concat(F.lit("g"), n))
        .otherwise(n)
    )


def untag_key(key: Column | str) -> Column:
    k = _col(key)
    letter = F.substring(k, 1, 1)
    rest = F.substring(k, F.lit(2), F.length(k))
    kind = F.when(letter == "u", "user").when(letter == "g", "group").otherwise("prefix")
    return F.struct(
        kind.alias("kind"), F.when(letter.isin("u", "g"), rest).otherwise(k).alias("name")
    )


def base64_text(binary: Column | str) -> Column:
    return F.base64(_col(binary))


def base64_binary(text: Column | str) -> Column:
    return F.unbase64(_col(text))


def floor_div(total: Column | str, count: Column | str) -> Column:
    """Quotient rounded towards minus infinity, exact for decimals."""
    t, n = _col(total).cast("decimal(38,0)"), _col(count).cast("decimal(20,0)")
    return ((t - F.pmod(t, n)) / n).cast("long")


def value_errors(approx: Column | str, exact: Column | str) -> tuple[Column, Column]:
    """Absolute and relative error; the relative one is null when the exact value is 0."""
    gap = F.abs(_col(approx) - _col(exact))
    return gap, F.try_divide(gap.cast("double"), F.abs(_col(exact)).cast("double"))
