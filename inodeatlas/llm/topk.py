"""Exact top-k inner products with block-at-a-time pruning.

Vectors of integers lie in blocks of ``BLOCK`` rows from one range of ids. A block has a forward
index (its rows as a matrix) and, for every dimension, the largest and smallest component. For a
query, the sum over its dimensions of the larger product is a bound on every score in the block.
A cell is a group of queries against a group of blocks: each query takes the blocks in the order
of falling bounds and stops where the bound lies below its k-th score so far. A first cell for
each query gives a k-th score that all others start from. Blocks whose bound equals the k-th score
are scored, since a tie can go to a smaller id.

All cells together are a stated query set against all rows, in blocks of bounded size; a query
sends at most k rows out of a cell.

Defined results: vectors that are null or hold null, NaN or infinite components take no part;
shorter vectors count as padded with zeros; a repeated row is a row of its own; equal scores are
ordered by id; a row without an id is found as any other, with a null id, behind all ids of its
score; where the mark of the queries is null, the row is none; an empty table gives no rows.
Components must fit 64-bit integers after scaling, ids must lie below the largest one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

BLOCK = 128
NO_ID = np.iinfo(np.int64).max  # stands for a null id
SHARD_BLOCKS = 32  # blocks of a cell
QUERY_GROUP = 512
PART_BYTES = 128_000_000  # of components, in a task that makes blocks
CELL_OUT = "query_row long, query_id long, row long, vec_id long, score long"
BLOCKS = "block long, n int, dims int, rows binary, ids binary, width int, matrix binary, maxima binary, minima binary, asks binary"


def scaled(df: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, comps) with floor(scale * x) as integers; unusable vectors are left out."""
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    source = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return source.filter(usable).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("comps"))


def _narrow(matrix: np.ndarray) -> tuple[int, bytes]:
    most = int(np.abs(matrix).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, matrix.astype(f"<i{width}").tobytes()


def block_table(vectors: DataFrame, asks: Column, block: int = BLOCK) -> DataFrame:
    """Blocks of ``vectors`` (vec_id, comps); ``asks`` marks the rows that are queries as well."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            ask = np.asarray(batch.column(2)).astype(bool)
            comps = batch.column(1)
            lengths = np.diff(np.asarray(comps.offsets))
            flat = np.asarray(comps.flatten())
            dims = int(lengths.max(initial=0))
            full = np.zeros((len(ids), dims), np.int64)
            full[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            # inside a range, rows with like signs come together: tighter maxima
            signs = np.zeros(len(ids), np.int64)
            for d in range(min(dims, 16)):
                signs = signs * 2 + (full[:, d] >= 0)
            order = np.lexsort((ids, signs))
            for i in range(0, len(order), block):
                own = order[i : i + block]
                matrix = full[own]
                rows = (np.int64(part) << 34) + made * block + np.arange(len(own))
                width, data = _narrow(matrix)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "block": (part << 30) + made, "n": len(own), "dims": dims, "rows": rows.astype("<i8").tobytes(),
                            "ids": ids[own].astype("<i8").tobytes(), "width": width, "matrix": data,
                            "maxima": matrix.max(axis=0).astype("<i8").tobytes(), "minima": matrix.min(axis=0).astype("<i8").tobytes(),
                            "asks": ask[own].tobytes(),
                        }
                    ],
                    schema=SCHEMA,
                )
                made += 1

    ranged = vectors.select(F.coalesce("vec_id", F.lit(int(NO_ID))).alias("vec_id"), "comps", F.coalesce(asks, F.lit(False)).alias("ask"), F.xxhash64("comps").alias("h"))
    held = vectors.agg(F.sum(8 * F.size("comps"))).first()[0] or 0
    spark = vectors.sparkSession
    # rows without an id, or with the same one, are dealt by their components
    ranged = ranged.repartitionByRange(max(partitions(spark), -(-held // PART_BYTES)), "vec_id", "h").sortWithinPartitions("vec_id", "h")
    return ranged.select("vec_id", "comps", "ask").mapInArrow(run, BLOCKS)


SCHEMA = pa.schema(
    [("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("width", pa.int32())]
    + [(c, pa.binary()) for c in ("matrix", "maxima", "minima", "asks")]
)
GROUPS = "group_no long, n int, dims int, rows binary, ids binary, width int, matrix binary, kth binary"


def query_groups(blocks: DataFrame, size: int = QUERY_GROUP) -> DataFrame:
    """The query rows of the blocks, in groups; their k-th scores are not known yet."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        rows, ids, vectors, held = [], [], [], 0

        def group():
            dims = max((m.shape[1] for m in vectors), default=0)
            matrix = np.concatenate([np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in vectors])
            width, data = _narrow(matrix)
            low = np.full(len(matrix), np.iinfo(np.int64).min)
            return pa.RecordBatch.from_pylist(
                [{"group_no": (part << 30) + made, "n": len(matrix), "dims": dims, "rows": np.concatenate(rows).tobytes(), "ids": np.concatenate(ids).tobytes(), "width": width, "matrix": data, "kth": low.astype("<i8").tobytes()}],
                schema=pa.schema([("group_no", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("width", pa.int32()), ("matrix", pa.binary()), ("kth", pa.binary())]),
            )

        for batch in batches:
            for row in batch.to_pylist():
                ask = np.frombuffer(row["asks"], bool)
                if not ask.any():
                    continue
                rows.append(np.frombuffer(row["rows"], "<i8")[ask])
                ids.append(np.frombuffer(row["ids"], "<i8")[ask])
                vectors.append(_matrix(row)[ask])
                held += int(ask.sum())
                if held >= size:
                    yield group()
                    made += 1
                    rows, ids, vectors, held = [], [], [], 0
        if held:
            yield group()

    return blocks.mapInArrow(run, GROUPS)


def _matrix(row) -> np.ndarray:
    return np.frombuffer(row["matrix"], f"<i{row['width']}").astype(np.int64).reshape(row["n"], row["dims"])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; through floating point only where that is exact."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dims, 1) < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _top(query, score, ids, rows, k):
    """The first k of each query by falling score, then id, then row."""
    order = np.lexsort((rows, ids, -score, query))
    q = query[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, np.int64)
    return order[np.arange(len(q)) - begin < k]


def search_cell(groups: list[dict], blocks: list[dict], k: int):
    """Best rows of each query within a cell: arrays (query, score, vec_id, row), and k-th scores."""
    q = _stack(groups)
    q_rows = np.concatenate([np.frombuffer(g["rows"], "<i8") for g in groups])
    kth = np.concatenate([np.frombuffer(g["kth"], "<i8") for g in groups]).copy()
    dims = max([q.shape[1], *(b["dims"] for b in blocks)])
    bound = np.empty((len(q), len(blocks)), np.int64)
    wide = np.pad(q, ((0, 0), (0, dims - q.shape[1])))
    high = np.stack([np.pad(np.frombuffer(b["maxima"], "<i8"), (0, dims - b["dims"])) for b in blocks])
    low = np.stack([np.pad(np.frombuffer(b["minima"], "<i8"), (0, dims - b["dims"])) for b in blocks])
    bound = _products(np.maximum(wide, 0), high) + _products(np.minimum(wide, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    held = [np.zeros(0, np.int64)] * 4
    alive = np.arange(len(q))
    for step in range(len(blocks)):
        chosen = order[alive, step]
        go = bound[alive, chosen] >= kth[alive]
        alive, chosen = alive[go], chosen[go]  # later bounds are lower still
        if not len(alive):
            break
        fresh = [held]
        for b in np.unique(chosen):
            own = alive[chosen == b]
            block = blocks[b]
            score = _products(q[own], _matrix(block))
            at, col = np.nonzero(score >= kth[own][:, None])
            rows = np.frombuffer(block["rows"], "<i8")[col]
            other = rows != q_rows[own[at]]
            fresh.append([own[at][other], score[at, col][other], np.frombuffer(block["ids"], "<i8")[col][other], rows[other]])
        joined = [np.concatenate(c) for c in zip(*fresh)]
        best = _top(*joined, k)
        held = [c[best] for c in joined]
        counts = np.bincount(held[0], minlength=len(q))
        full = np.flatnonzero(counts >= k)
        last = np.cumsum(counts)[full] - 1
        kth[full] = np.maximum(kth[full], held[1][last])
    return held, kth


def _stack(groups) -> np.ndarray:
    dims = max(g["dims"] for g in groups)
    return np.concatenate([np.pad(_matrix(g), ((0, 0), (0, dims - g["dims"]))) for g in groups])


def top_k(vectors: DataFrame, asks: Column, k: int = 20) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score) of the k best rows for each marked row of ``vectors``."""
    blocks = stored(block_table(vectors, asks), "topk-blocks")
    shards = max(1, math.ceil(blocks.count() / SHARD_BLOCKS))
    groups = stored(query_groups(blocks), "topk-queries")
    dealt = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))

    def seed(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, own = left.to_pylist(), right.to_pylist()
        for g in asked if own else ():
            _, kth = search_cell([g], own, k)
            g["kth"] = kth.astype("<i8").tobytes()
        return pa.Table.from_pylist(asked, schema=left.schema).drop_columns(["shard"])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, own = left.to_pylist(), right.to_pylist()
        out = [np.zeros(0, np.int64)] * 5
        if asked and own:
            (query, score, ids, rows), _ = search_cell(asked, own, k)
            q_rows = np.concatenate([np.frombuffer(g["rows"], "<i8") for g in asked])
            q_ids = np.concatenate([np.frombuffer(g["ids"], "<i8") for g in asked])
            out = [q_rows[query], q_ids[query], rows, ids, score]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_row", "query_id", "row", "vec_id", "score"])

    first = groups.withColumn("shard", F.pmod(F.xxhash64("group_no"), F.lit(shards)))
    started = stored(first.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(seed, GROUPS), "topk-started")
    n_groups = max(1, math.ceil(started.count() / 2))
    numbered = started.withColumn("cell", F.pmod(F.xxhash64("group_no"), F.lit(n_groups)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sent = numbered.select("*", numbers(shards).alias("shard"))
    met = dealt.select("*", numbers(n_groups).alias("cell"))
    found = sent.groupBy("shard", "cell").cogroup(met.groupBy("shard", "cell")).applyInArrow(cell, CELL_OUT)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")))
    known = lambda c: F.nullif(F.col(c), F.lit(int(NO_ID))).alias(c)
    return ranked.filter(F.col("rank") <= k).select("query_row", known("query_id"), F.col("rank").cast("int").alias("rank"), known("vec_id"), "score")
