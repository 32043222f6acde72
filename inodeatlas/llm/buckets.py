"""Length buckets of least padding, and batches with a token budget inside each bucket.

The histogram of lengths is global: a grouped count of all lengths as they are, with at most as many
rows as the longest text has tokens, however many documents there are. Dynamic programming over it
finds the boundaries of at most ``buckets`` buckets with the least padding, exactly, by divide and
conquer over the cuts.

Within a bucket every document takes the room of the bucket's boundary; a batch holds as many as
the budget allows, one at least. Documents are numbered inside a bucket without gathering it: by
row numbers in slices of bounded size and prefix sums over the slices.

Defined results: a null or empty text has one token (its end); a document longer than the budget
is a batch of its own; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SLICE = 50_000


def word_tokens(text_col: str = "text") -> Column:
    """White-space tokens of a text and one end."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of ``lengths`` (rising) with the least total padding."""
    n = len(lengths)
    if not n:
        return []
    length = np.array(lengths, dtype=np.float64)
    many = np.concatenate([[0.0], np.cumsum(np.array(counts, dtype=np.float64))])
    total = np.concatenate([[0.0], np.cumsum(length * np.array(counts, dtype=np.float64))])
    # padding of lengths i..j-1 in one bucket: length[j-1] * documents - tokens
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    choice = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        open_ = [(1, n, 0, n - 1)]  # the best cut rises with the end: halve the ends, and the cuts with them
        while open_:
            first, last, low, high = open_.pop()
            end = (first + last) // 2
            i = np.arange(low, min(high, end - 1) + 1)
            cost = best[i] + length[end - 1] * (many[end] - many[i]) - (total[end] - total[i])
            at = int(cost.argmin())
            new[end], cut[end] = cost[at], low + at
            if first < end:
                open_.append((first, end - 1, low, low + at))
            if end < last:
                open_.append((end + 1, last, low + at, high))
        choice.append(cut)
        best = new
        if best[n] <= 0:
            break
    bounds, end = [], n
    for cut in reversed(choice):
        bounds.append(lengths[end - 1])
        end = int(cut[end])
        if end == 0:
            break
    return bounds[::-1]


def pack(df: DataFrame, n_tokens: Column | None = None, buckets: int = 24, budget: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, batch, slot, batch_size) of every row.

    ``batch`` numbers the batches of all buckets; ``slot`` is the place in the batch.
    """
    length = word_tokens(text_col) if n_tokens is None else n_tokens
    rows = stored(  # lengths are counted once
        df.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("n_tokens"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")),
        "lengths",
    )
    histogram = rows.groupBy("n_tokens").count().collect()  # bounded by the longest text
    histogram.sort()
    sizes = [(int(r[0]), int(r[1])) for r in histogram]
    bounds = best_boundaries([s for s, _ in sizes], [c for _, c in sizes], buckets)
    slices = max(1, math.ceil(sum(c for _, c in sizes) / SLICE))
    base, first = [], 0
    for i, bound in enumerate(bounds):
        low = bounds[i - 1] if i else -1
        held = sum(c for s, c in sizes if low < s <= bound)
        base.append(first)
        first += math.ceil(held / max(1, budget // bound))
    limits = F.array(*(F.lit(b).cast("long") for b in bounds or [0]))
    placed = rows.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("n_tokens"))))
    placed = placed.withColumn("slice", F.pmod("h", F.lit(slices)))
    counts = placed.groupBy("bucket", "slice").agg(F.count("*").alias("held"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("bucket").alias("b"), F.col("slice").alias("s"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "slice").orderBy("doc_id", "h", "n_tokens")
    numbered = placed.withColumn("number", F.row_number().over(within) - 1)
    joined = numbered.join(offsets, (F.col("bucket") == F.col("b")) & (F.col("slice") == F.col("s")))
    at = F.col("number") + F.col("offset")
    pick = lambda values: F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values or [1])), F.col("bucket") + 1)
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / pick(bounds)).cast("long"))
    return joined.select(
        "doc_id",
        "n_tokens",
        "bucket",
        pick(bounds).alias("bucket_tokens"),
        (F.floor(at / size) + pick(base)).cast("long").alias("batch"),
        F.pmod(at, size).cast("int").alias("slot"),
        size.alias("batch_size"),
    )
