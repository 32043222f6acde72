"""Session settings and lineage cutting."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Only what the operators rely on; executor sizes belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows can be long texts: a batch is bounded by its bytes, not by its rows alone
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoint files go when nothing refers to their data any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # sketch buffers are objects: let the hash aggregate hold more keys before sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def build_session(app: str = "inodeatlas", master: str | None = None, **extra) -> SparkSession:
    """A session with the library settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once for each context; they need no path of the driver."""
    context = spark.sparkContext
    if getattr(context, "_inodeatlas_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="inodeatlas-"), "inodeatlas.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                target.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._inodeatlas_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a local one only for local masters."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="inodeatlas-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder; survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` as files in the shared folder, whose size Spark knows when it plans joins.

    The shuffles that made it are removed at once: nothing reads them again.
    """
    spark = df.sparkSession
    path, key = f"{checkpoint_dir(spark)}/{uuid.uuid4()}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def plain_plans(spark: SparkSession):
    """Plan what is run inside without inferred constraints.

    Tables that are cut and united again and again carry constraints on columns of earlier ones, over
    which the optimiser stumbles ("key not found").
    """
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def interpreted_plans(*sessions: SparkSession):
    """Run what is inside without a class for each stage.

    A small micro-batch of many plans spends more time on compiling its stages than on its rows, and has more
    of them than Spark keeps from one micro-batch to the next.
    """
    key = "spark.sql.codegen.wholeStage"
    before = [spark.conf.get(key, "true") for spark in sessions]
    for spark in sessions:
        spark.conf.set(key, "false")
    try:
        yield
    finally:
        for spark, value in zip(reversed(sessions), reversed(before), strict=True):
            spark.conf.set(key, value)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def named_folders(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Names of the entries of a shared folder that begin with ``prefix``, without it; none where it is missing."""
    if not exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in store.listStatus(path)]
    return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))


def numbered_folders(spark: SparkSession, folder: str) -> list[int]:
    """Numbers that name the entries of a shared folder, ascending; none where it is missing."""
    return sorted(int(n) for n in named_folders(spark, folder) if n.isdigit())


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that the library wrote itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
