"""Snapshot listings: text lines, quoted CSV, policy listings, database listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import modes, paths, text
from ..schemas import INTEGER_COLUMNS, INVENTORY, SNAPSHOT_COLUMNS, quoted_csv_schema


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Bounded scan of text files under a folder or object-store prefix (column ``value``)."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def split_once(lines: DataFrame, cells: Column) -> DataFrame:
    """Add the split cells as a generated column.

    A filter on a projected column is pushed below the projection and would repeat the
    split for every field it tests; it stays above a generator.
    """
    kept = [c for c in lines.columns if c != "value"]
    return lines.select(*kept, F.explode(F.array(cells)).alias("_cells"))


def tag_inventory(lines: DataFrame, layout: str = "nine") -> DataFrame:
    """Parse snapshot lines in one pass.

    Output: the inventory columns, the raw ``line`` and ``reject`` (null for a good
    row, else the reason). The path is the last field and keeps its commas.
    """
    names = SNAPSHOT_COLUMNS[layout]
    cells = F.split(text.strip("value"), ",", len(names))
    raw = split_once(lines.select(F.col("value").alias("line"), "value"), cells)
    field = {c: F.get(F.col("_cells"), F.lit(i)) for i, c in enumerate(names)}
    typed: list[Column] = []
    for f in INVENTORY.fields:
        if f.name not in field:
            column = F.lit(None)
        elif f.name in INTEGER_COLUMNS:
            column = text.strict_long(field[f.name])
        elif f.name == "path":
            column = text.unquote_field(field[f.name])
        else:
            column = field[f.name]
        typed.append(column.try_cast(f.dataType).alias(f.name))
    parsed = raw.select("line", F.size("_cells").alias("_n"), *typed)
    broken = F.lit(False)
    for c in INTEGER_COLUMNS:
        broken = broken | F.col(c).isNull()
    reject = F.when(F.col("_n") != len(names), "column count").when(broken, "not an integer")
    return parsed.select("*", reject.alias("reject")).drop("_n")


def parse_inventory(lines: DataFrame, layout: str = "nine") -> tuple[DataFrame, DataFrame]:
    """``(good rows, rejected lines)``; lines with a wrong column count or number are rejects."""
    tagged = tag_inventory(lines, layout)
    good = tagged.filter(F.col("reject").isNull()).drop("reject")
    return good, tagged.filter(F.col("reject").isNotNull()).select("line", "reject")


def render_inventory(inv: DataFrame, layout: str = "nine") -> DataFrame:
    """Snapshot lines of an inventory; the path is quoted."""
    cells = [
        F.concat(F.lit('"'), F.col(c), F.lit('"')) if c == "path" else F.col(c).cast("string")
        for c in SNAPSHOT_COLUMNS[layout]
    ]
    return inv.select(F.concat_ws(",", *cells).alias("value"))


def read_quoted_csv(spark: SparkSession, path: str, width: int = 9) -> DataFrame:
    """Quoted CSV with an explicit all-string schema.

    Quoted line breaks need whole files per task, so keep the files split at the source.
    """
    return spark.read.csv(
        path,
        schema=quoted_csv_schema(width),
        sep=",",
        quote='"',
        escape='"',
        multiLine=True,
        header=False,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )


def typed_base_columns(raw: DataFrame) -> DataFrame:
    """The eight base columns with numeric metrics; incomplete rows stay, as nulls."""
    base = SNAPSHOT_COLUMNS["nine"][:8]
    numeric = ("size", "atime", "ctime", "mtime")
    return raw.select(*[F.col(c).try_cast("long").alias(c) if c in numeric else c for c in base])


POLICY_COLUMNS = 18
POLICY_MAX_LINE = 2000


def tag_policy_listing(lines: DataFrame, mount: str = "") -> DataFrame:
    """Policy listing of 18 space-separated columns, the last a URL-encoded path.

    Only regular files and links are inventory rows. Everything else is tagged.
    """
    # the length limit counts the line break that the text reader has removed
    line = F.col("value")
    cells = F.split(text.strip(line), " ", POLICY_COLUMNS)
    cut = split_once(lines.select(line.alias("line"), "value"), cells)
    at = lambda i: F.get(F.col("_cells"), F.lit(i))
    letter = F.substring(at(11), 1, 1)
    number = lambda i: text.strict_long(at(i))
    parsed = cut.select(
        "line",
        F.size("_cells").alias("_n"),
        letter.alias("_letter"),
        F.when(letter == "-", "f").when(letter == "l", "l").alias("type"),
        modes.text_to_mode(at(11)).alias("mode"),
        number(9).alias("uid"),
        number(10).alias("gid"),
        number(4).alias("size"),
        number(12).alias("atime"),
        number(13).alias("ctime"),
        number(15).alias("mtime"),
        at(5).alias("fileset"),
        paths.strip_prefix(text.url_decode(at(17)), mount).alias("path"),
    )
    broken = F.lit(False)
    for c in INTEGER_COLUMNS:
        broken = broken | F.col(c).isNull()
    reject = (
        F.when(F.length("line") + 1 > POLICY_MAX_LINE, "too long")
        .when(F.col("_n") != POLICY_COLUMNS, "column count")
        .when(~F.col("_letter").isin("-", "l"), "not a file or link")
        .when(broken, "bad value")
    )
    return parsed.select("*", reject.alias("reject")).drop("_n", "_letter")


def parse_policy_listing(lines: DataFrame, mount: str = "") -> tuple[DataFrame, DataFrame]:
    """``(inventory rows with fileset, rejected lines)``."""
    tagged = tag_policy_listing(lines, mount)
    good = tagged.filter(F.col("reject").isNull()).drop("reject", "line")
    return good, tagged.filter(F.col("reject").isNotNull()).select("line", "reject")


def parse_listing(lines: DataFrame) -> DataFrame:
    """Database listing ``path,size`` split at the last comma.

    Blank, comment and undecodable lines go; a malformed line keeps null columns and
    ``malformed`` set, so that the caller decides whether to stop.
    """
    t = text.strip("value")
    pattern = r"(?s)^(.*),([^,]*)$"
    size = text.strict_long(F.regexp_extract(t, pattern, 2))
    ok = F.rlike(t, F.lit(pattern)) & size.isNotNull()
    keep = ~F.contains(F.col("value"), F.lit("�")) & (t != "") & ~F.startswith(t, F.lit("#"))
    kept = [c for c in lines.columns if c != "value"]
    return lines.filter(keep).select(
        *kept,
        F.when(ok, text.strip(F.regexp_extract(t, pattern, 1))).alias("path"),
        F.when(ok, size).alias("size"),
        (~ok).alias("malformed"),
    )


def parse_expected_counts(lines: DataFrame, sep: str = ", ") -> DataFrame:
    """Count file lines to kind, name, worker, count; malformed lines give no row."""
    return (
        lines.select(text.parse_count_line("value", sep).alias("c"))
        .filter(F.col("c").isNotNull())
        .select("c.*")
    )


def normalize_entries(entries: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Database rows to inventory rows.

    The directory is the database path without prefix and suffix; an empty name
    becomes the word ``null``. ``reject`` tells why a row cannot be used.
    """
    name = F.when(F.col("name").isNull() | (F.col("name") == ""), "null").otherwise(F.col("name"))
    folder = paths.strip_affixes("db_path", prefix, suffix)
    numbers = [text.strict_long(F.col(c).cast("string")).alias(c) for c in INTEGER_COLUMNS]
    # above a generator, so that a filter on ``reject`` does not read the numbers again
    cells = F.struct("type", *numbers, name.alias("_name"), folder.alias("_folder"))
    out = entries.select(F.explode(F.array(cells)).alias("_cells")).select("_cells.*")
    out = out.select("type", *INTEGER_COLUMNS, F.concat("_folder", F.lit("/"), "_name").alias("path"), "_folder")
    missing = F.col("type").isNull()
    for c in INTEGER_COLUMNS:
        missing = missing | F.col(c).isNull()
    reject = F.when(F.col("_folder").isNull(), "unexpected path").when(missing, "null or bad value")
    return out.select("*", reject.alias("reject")).drop("_folder")
