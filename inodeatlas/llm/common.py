"""What the operators share: settings, tokens of a batch, hashes, shared folders and small tables."""

from __future__ import annotations

import ctypes
import functools
import os
import pickle
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that Arrow steps over long texts rely on; values set by the caller stay."""
    ship_package(spark)
    for key, standard, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "32m", "33554432b"), "4m"),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), "1000"),
    ):
        if spark.conf.get(key, None) in standard:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4()}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_of(parts: list[DataFrame]) -> DataFrame:
    """The rows of several tables."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folder_of(uri: str):
    """File system and path of a shared folder, for steps that write their own file format."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def byte_slices(batch: pa.RecordBatch, column: int, most: int):
    """Slices of a batch with at most ``most`` bytes in a string column, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def rows_where(df: DataFrame, text_col: str, accept, most: int) -> DataFrame:
    """The rows of ``df`` for whose texts ``accept`` (texts to booleans) holds, worked on in slices of ``most`` bytes."""
    at = df.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, at, most):
                kept = batch.filter(pa.array(accept(batch.column(at)), pa.bool_()))
                if kept.num_rows:
                    yield kept

    return df.mapInArrow(lean(run), df.schema)


def is_local(uri: str) -> bool:
    return uri.startswith("file:") or "://" not in uri


def local_path(uri: str) -> str:
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else os.fspath(uri)


def fitted(rows: DataFrame, fit):
    """``fit`` of the batches of a sample of bounded size, in one task: the driver gets the model only."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(list(batches)))], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(lean(run), "model binary").first()
    return pickle.loads(made[0]) if made else fit([])


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Return memory that is free to the system: workers live on, and share that of an executor."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def lean(run):
    """A function of Arrow batches that gives its memory back when it has ended."""

    def ended(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return ended


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * (2.0**-53)


class Words(NamedTuple):
    """White-space tokens of a batch of texts; ``index`` points into ``unique`` and ``hashes``."""

    index: np.ndarray  # of each token
    starts: np.ndarray  # first token of each text, and one past the last text
    unique: pa.Array
    hashes: np.ndarray  # of each unique word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def rows(self) -> np.ndarray:
        """The text that each token belongs to."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Maximal runs without ``[\\x20\\x09-\\x0D]``; null is empty; ``lower`` maps A-Z only."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) and np.frombuffer(texts.buffers()[1], np.int64, 1, 8 * texts.offset)[0]:
        # the ASCII kernels misread slices whose data begin behind the start of the buffer
        texts = texts.take(pa.array(np.arange(len(texts))))
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    index = np.asarray(coded.indices).astype(np.int64)
    unique = coded.dictionary.cast(pa.large_binary())
    # texts that begin or end with white space give empty words
    empty = pc.index(unique, pa.scalar(b"", pa.large_binary())).as_py()
    starts = offsets - offsets[0]
    if empty >= 0:
        keep = index != empty
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        index = index[keep]
    hashes = np.fromiter(map(word_hash, unique.to_pylist()), dtype=U64, count=len(unique))
    return Words(index, starts, unique, hashes)


class Rolling:
    """Hashes of word windows of any size over one sequence, from prefix sums modulo 2^64."""

    _base = 0x9E3779B97F4A7C15
    _up = _down = np.ones(1, U64)

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        if len(Rolling._up) <= self.n:
            size = max(2 * self.n, 1 << 16)
            inverse = pow(self._base, -1, 1 << 64)
            with np.errstate(over="ignore"):
                Rolling._up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, self._base, U64)]))
                Rolling._down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, inverse, U64)]))
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate([np.zeros(1, U64), np.cumsum(h * Rolling._up[: self.n])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words begin..end-1; the size is part of it."""
        with np.errstate(over="ignore"):
            raw = (self.prefix[end] - self.prefix[begin]) * Rolling._down[begin]
            return mix(raw + (end - begin).astype(U64) * U64(0xD1B54A32D192ED03))

    def fixed(self, size: int) -> np.ndarray:
        """Hash of the window of ``size`` words that begins at each place where one fits."""
        begin = np.arange(max(self.n - size + 1, 0))
        return self.of(begin, begin + size)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each range of ``starts``; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def range_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Like ``sums`` for floats, without the rounding of one long running total."""
    out = np.zeros(len(starts) - 1, dtype=values.dtype)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full])
    return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float | None = None) -> tuple[float, float]:
    """Slope (``least`` at least) and shift that calibrate the scores ``x`` of labels ``y``: smoothed targets, damped Newton steps."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    weight = weight * (len(y) / weight.sum())

    def loss(a, b):
        z = a * x + b
        return np.sum(weight * (np.logaddexp(0, z) - target * z))

    a, b = 1.0, 0.0
    now = loss(a, b)
    for _ in range(100):
        p = sigmoid(a * x + b)
        g = np.array([np.sum(weight * (p - target) * x), np.sum(weight * (p - target))])
        q = weight * p * (1 - p)
        hess = np.array([[np.sum(q * x * x), np.sum(q * x)], [np.sum(q * x), np.sum(q)]]) + 1e-6 * np.eye(2)
        move, share = np.linalg.solve(hess, g), 1.0
        while share > 1e-8 and not loss(a - share * move[0], b - share * move[1]) <= now:
            share /= 2
        if share <= 1e-8 or np.abs(move).max() < 1e-10:
            break
        a, b = a - share * move[0], b - share * move[1]
        now = loss(a, b)
    if least is not None and a < least:  # the scores say nothing, or the contrary, of the held-back rows
        a = least
        for _ in range(50):
            p = sigmoid(a * x + b)
            b -= float(np.clip(np.sum(weight * (p - target)) / max(np.sum(weight * p * (1 - p)), 1e-9), -1, 1))
    return float(a), float(b)


def crc_mod(column: str, n: int):
    """crc32 of an id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
