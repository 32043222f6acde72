"""Summaries on a stream that come out, and leave the state, once all their rows have arrived.

Rows are merged within each task, up to a number of keys held at a time, so a key costs few rows for each
micro-batch, however often it occurs. The merged rows meet the state: keys are dealt to buckets by hash,
and a bucket is one row of Spark's arbitrary state, since a call for every key costs far more than
adding it up. When the count of a key reaches the expected one its summary is emitted and the key
removed, with the bucket if it was the last one. A key whose rows never arrive in full is given up
after a time, if one is set, and comes out as incomplete.
"""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.aggregate import high, low
from ..operators.dimensions import explode_dimensions
from ..schemas import METRICS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMS = ("count", *(f"{m}_{part}" for m in METRICS for part in ("hi", "lo")))
LOWS = tuple(f"{m}_min" for m in METRICS)
HIGHS = tuple(f"{m}_max" for m in METRICS)
HELD_ROWS = 1 << 16  # keys that a task merges before it hands them on
BUCKETS = 1024


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state on disk, in no more partitions than the cluster has cores.

    Every partition of the state costs a task and a commit in every micro-batch, however few keys it has.
    """
    partitions = "spark.sql.shuffle.partitions"
    cores = min(int(spark.conf.get(partitions)), max(spark.sparkContext.defaultParallelism, 1))
    inside = {
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        # a commit writes what has changed, not the files of the store
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        partitions: str(cores),
    }
    before = {key: spark.conf.get(key, None) for key in inside}
    for key, value in inside.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def row_partials(inv: DataFrame, dims: Sequence[str], lo: int = 1, hi: int = 5) -> DataFrame:
    """A partial summary for each key of each file: kind, name and the columns that merge."""
    rows = explode_dimensions(inv, dims, lo, hi, keep=METRICS)
    columns = [F.lit(1).cast("long").alias("count")]
    for m in METRICS:
        columns += [high(m).cast("long").alias(f"{m}_hi"), low(m).cast("long").alias(f"{m}_lo"), F.col(m).cast("long").alias(f"{m}_min"), F.col(m).cast("long").alias(f"{m}_max")]
    return rows.select("kind", "name", *columns)


def _merges(sums: Sequence[str], lows: Sequence[str], highs: Sequence[str]) -> list[tuple[str, str]]:
    return [*((c, "sum") for c in sums), *((c, "min") for c in lows), *((c, "max") for c in highs)]


def merged_in_tasks(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], lows: Sequence[str], highs: Sequence[str]) -> DataFrame:
    """A row for each key and at most ``HELD_ROWS`` keys of a task: the keys, and key and merged columns as pickled ``values``."""
    keys, merges = list(keys), _merges(sums, lows, highs)
    columns = [c for c, _ in merges]
    picked = rows.select(*keys, *columns)
    out = T.StructType([*(picked.schema[k] for k in keys), T.StructField("values", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        def merged(parts, schema):
            table = pa.Table.from_batches(parts, schema).group_by(keys).aggregate(merges)
            ordered = table.select([*keys, *(f"{c}_{how}" for c, how in merges)]).rename_columns(schema.names)
            return ordered.cast(schema).combine_chunks().to_batches()

        def packed(parts):
            for part in parts:
                key, value = (zip(*(part.column(c).to_pylist() for c in some)) for some in (keys, columns))
                values = [pickle.dumps(pair) for pair in zip(key, value)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(values, pa.binary())], [*keys, "values"])

        held = []
        for batch in batches:
            held = merged([*held, batch], batch.schema)
            if sum(part.num_rows for part in held) >= HELD_ROWS:
                yield from packed(held)
                held = []
        yield from packed(held)

    return picked.mapInArrow(run, out)


def _added(old: list | None, new: Sequence, merges: Sequence[tuple[str, str]]) -> list:
    if old is None:
        return list(new)
    out = []
    for (_, how), a, b in zip(merges, old, new):
        if a is None or b is None:
            out.append(a if b is None else b)
        else:
            out.append(a + b if how == "sum" else min(a, b) if how == "min" else max(a, b))
    return out


def complete_stream(
    rows: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str] = ("count",),
    lows: Sequence[str] = (),
    highs: Sequence[str] = (),
    timeout_ms: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Summaries of the keys whose ``count`` has reached that of ``expected``, each once (append mode).

    ``rows`` is a stream of partial summaries, ``count`` the first of ``sums``; ``expected`` a static table. A
    key without an expected count comes out at once, incomplete, with a null ``expected``; one that is given up
    after ``timeout_ms`` comes out incomplete with what has arrived. Start the stream inside :func:`state_store`.
    ``buckets`` holds for the life of a checkpoint; a bucket of the state is read and written as a whole.
    """
    keys, merges = list(keys), _merges(sums, lows, highs)
    merged = merged_in_tasks(rows, keys, sums, lows, highs)
    # as text: a null among numbers would make them floats on the way
    wanted = expected.select(*keys, F.col("count").cast("long").cast("string").alias("expected"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    joined = merged.join(wanted, keys, "left").select(bucket, "values", "expected")
    values = [T.StructField(c, rows.schema[c].dataType, True) for c, _ in merges]
    state = T.StructType([T.StructField("held", T.BinaryType())])
    out = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), *values, T.StructField("expected", T.LongType()), T.StructField("complete", T.BooleanType())])
    names = out.names

    def step(_, frames, state):
        import pandas as pd

        # key: (expected count, moment it is given up, merged columns)
        waiting = pickle.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if timeout_ms is not None else None
        told, met = [], {}
        for frame in frames:
            for packed, wants in zip(frame["values"], frame["expected"]):
                key, new = pickle.loads(packed)
                if key not in met:
                    met[key] = None if wants is None else int(wants)
                due, total = waiting[key][1:] if key in waiting else (now and now + timeout_ms, None)
                waiting[key] = (met[key], due, _added(total, new, merges))
        for key, wants in met.items():
            total = waiting[key][2]
            if wants is None or total[0] == wants:
                told.append((*key, *total, wants, wants is not None))
                del waiting[key]
        if now is not None:
            for key in [k for k, (_, due, _) in waiting.items() if due <= now]:
                wants, _, total = waiting.pop(key)
                told.append((*key, *total, wants, False))
        if waiting:
            state.update((pickle.dumps(waiting),))
            if now is not None:
                state.setTimeoutDuration(max(min(due for _, due, _ in waiting.values()) - now, 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame({name: pd.Series(column, dtype=object) for name, column in zip(names, zip(*told))})

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return joined.groupBy("bucket").applyInPandasWithState(step, out, state, "append", timeout)
