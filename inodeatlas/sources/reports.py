"""Result files: Parquet tables and quantile reports of several runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QUANTILES


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_report_runs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Quantile reports of many runs in one table; the run is the file name without suffix.

    Runs are named after their key: ``uid`` in the name means user reports.
    """
    columns = "id long, metric string, count long, min long, " + ", ".join(
        f"{q} long" for q in QUANTILES
    ) + ", max long, mean double"
    raw = spark.read.csv(paths, schema=columns, header=True, enforceSchema=True)
    run = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return raw.select("*", run.alias("run")).select(
        F.when(F.contains("run", F.lit("uid")), "uid").otherwise("gid").alias("typ"),
        "id",
        "metric",
        "run",
        *QUANTILES,
    )
