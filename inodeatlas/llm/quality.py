"""Quality rules: hashed n-gram logistic regression, calibrated, behind plain text statistics.

Features of a text are the mean counts of its words, word pairs and character trigrams of words,
hashed to 2^18 weights. The score is linear in the counts, so the weights of a word and its
trigrams are added once for each distinct word of a batch, and a text is a sum over its tokens.

The classifier is fitted on at most ``MAX_ROWS`` labelled rows of each class, taken by the hash
of their id (a bound in expectation); all tokens of such a row count. A quarter of the rows is held
back to calibrate the score (Platt). Statistics and scores cover every row and whole texts.

Defined results: null and empty texts have no words and fail the base rules; repeated rows give
one row each; an empty table gives an empty one; without rows of both classes the score is 0.5
for every text, and the verdict is left to the base rules.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, byte_slices, fitted, lean, mix, platt, range_sums, rows_where, sigmoid, sums, words_of

BITS = 18
MAX_ROWS = 1500
SLICE = 1_000_000  # bytes of texts at a time
CHUNK = 500_000  # entries of the fit at a time
THRESHOLD = 0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\r\x0b\x0c"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BITS)).astype(np.int64)


def _trigrams(unique: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte trigrams of each word with its borders, and where each word's begin."""
    data = np.frombuffer(b"\x02" + b"\x02\x02".join(unique.to_pylist()) + b"\x02", dtype=np.uint8).astype(U64) if len(unique) else np.zeros(0, U64)
    lengths = np.asarray(pc.binary_length(unique)).astype(np.int64)
    grams = data[:-2] | (data[1:-1] << U64(8)) | (data[2:] << U64(16)) if len(data) > 2 else np.zeros(0, U64)
    # word w has its letters and two borders: as many trigrams as letters
    begins = np.concatenate([[0], np.cumsum(lengths + 2)])[:-1]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(begins - starts[:-1], lengths) + np.arange(starts[-1])
    with np.errstate(over="ignore"):
        return _slots(mix(grams[at] * U64(0x51ED27) + U64(77))), starts


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the neighbouring words of each text, and where each text's begin."""
    h = words.hashes[words.index] if len(words.index) else np.zeros(0, U64)
    rows = words.rows()
    inside = rows[1:] == rows[:-1]
    with np.errstate(over="ignore"):
        slots = _slots(mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]))[inside]
    counts = np.maximum(words.counts - 1, 0)
    return slots, np.concatenate([[0], np.cumsum(counts)])


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, slot, value) of the texts of a batch, values being mean counts."""
    tri, tri_starts = _trigrams(words.unique)
    rows = words.rows()
    lengths = np.diff(tri_starts)[words.index] if len(words.index) else np.zeros(0, np.int64)
    token_at = np.repeat(np.arange(len(words.index)), lengths)
    offset = np.arange(len(token_at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    tri_slots = tri[tri_starts[words.index][token_at] + offset] if len(token_at) else np.zeros(0, np.int64)
    pair_slots, pair_starts = _pairs(words)
    row = np.concatenate([rows, rows[token_at], np.repeat(np.arange(len(words.starts) - 1), np.diff(pair_starts))])
    slot = np.concatenate([_slots(mix(words.hashes))[words.index], tri_slots, pair_slots])
    key, n = np.unique(row.astype(np.int64) << BITS | slot, return_counts=True)
    row, slot = key >> BITS, key & ((1 << BITS) - 1)
    return row, slot, n / np.maximum(words.counts, 1)[row]


def raw_scores(words: Words, weights: np.ndarray, bias: float) -> np.ndarray:
    """The linear score of each text."""
    tri, tri_starts = _trigrams(words.unique)
    each = weights[_slots(mix(words.hashes))].astype(np.float64) + range_sums(weights[tri].astype(np.float64), tri_starts)
    pair_slots, pair_starts = _pairs(words)
    total = range_sums(each[words.index], words.starts) + range_sums(weights[pair_slots].astype(np.float64), pair_starts)
    return bias + total / np.maximum(words.counts, 1)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.5, decay: float = 1e-5) -> dict:
    """Weights, bias and calibration from (label, slots, values) rows; classes weigh the same."""
    labels = np.array([r[0] for r in rows], dtype=np.float64)
    out = {"weights": np.zeros(1 << BITS, np.float32), "bias": 0.0, "a": 0.0, "b": 0.0}
    if len(set(labels.tolist())) < 2:
        return out
    held = np.arange(len(rows)) % 4 == 3
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False

    def chunks(keep):
        """(rows, row of each entry among them, slots, values) of some thousand entries at a time."""
        own, begin = np.flatnonzero(keep), 0
        sizes = np.array([len(rows[i][1]) for i in own])
        edges = np.cumsum(sizes) // CHUNK
        for end in [*(np.flatnonzero(edges[1:] != edges[:-1]) + 1).tolist(), len(own)]:
            some = [rows[i] for i in own[begin:end]]
            yield slice(begin, end), np.repeat(np.arange(len(some)), sizes[begin:end]), np.concatenate([r[1] for r in some]), np.concatenate([r[2] for r in some])
            begin = end

    y = labels[~held]
    w, bias = np.zeros(1 << BITS), 0.0
    seen, seen_bias = np.full(len(w), 1e-8), 1e-8
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(rounds):  # AdaGrad over all rows
        gradient, error_sum = decay * w, 0.0
        for own, at, slots, values in chunks(~held):
            p = sigmoid(bias + np.bincount(at, values * w[slots], minlength=own.stop - own.start))
            error = (p - y[own]) * share[own]
            gradient += np.bincount(slots, error[at] * values, minlength=len(w))
            error_sum += error.sum()
        seen += gradient**2
        w -= rate * gradient / np.sqrt(seen)
        seen_bias += error_sum**2
        bias -= rate * error_sum / np.sqrt(seen_bias)
    out["weights"][:] = w
    out["bias"] = float(bias)
    # Platt: held-back rows give slope and shift, with smoothed targets
    held = held if held.any() else ~held
    y = labels[held]
    x = np.full(len(y), bias)
    for own, at, slots, values in chunks(held):
        x[own] += np.bincount(at, out["weights"][slots] * values, minlength=own.stop - own.start)
    out["a"], out["b"] = platt(x, y, np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()))
    return out


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """Fit on labelled rows: at most ``max_rows`` of each class in expectation, by hash of the id."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"), F.min("quality").alias("low"))
        .filter("quality = low")
    )
    sizes = dict(marked.groupBy("quality").count().collect())
    share = F.lit(0.0)
    for quality, n in sizes.items():
        share = F.when(F.col("quality") == quality, F.lit(min(1.0, max_rows / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = marked.filter(draw < share).select("doc_id", "quality")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = words_of(batch.column(1).slice(i, 1))
                _, slot, value = features(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([slot.astype("<i4").tobytes()], pa.binary()), pa.array([value.astype("<f4").tobytes()], pa.binary())],
                    ["doc_id", "quality", "slots", "vals"],
                )

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the drawn ids are bounded by max_rows of each class, so texts need not be shuffled for them
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    def learn(batches):
        # slots and values stay where Arrow has them
        rows = [(*(c[i].as_py() for c in b.columns[:2]), *(c[i].as_buffer() for c in b.columns[2:])) for b in batches for i in range(b.num_rows)]
        rows.sort(key=lambda r: (r[0], hashlib.sha256(r[2]).digest(), hashlib.sha256(r[3]).digest()))
        return fit([(q, np.frombuffer(slots, "<i4"), np.frombuffer(values, "<f4")) for _, q, slots, values in rows])

    return fitted(sample.mapInArrow(lean(run), "doc_id long, quality int, slots binary, vals binary"), learn)


def statistics(texts: pa.Array, words: Words) -> list[np.ndarray]:
    """Columns of ``STATS`` for a batch."""
    names = words.unique.cast(pa.large_string())
    chars = np.asarray(pc.utf8_length(names)).astype(np.int64)
    marks = np.asarray(pc.count_substring_regex(names, "[#*$%&|<>]")).astype(np.int64)
    dup_lines = []
    for text in texts.to_pylist():
        lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
        dup_lines.append(len(lines) - len(set(lines)))
    return [
        words.counts,
        sums(chars[words.index], words.starts),
        sums(marks[words.index], words.starts),
        np.array(dup_lines, dtype=np.int64),
        repeated_words(words),
    ]


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """Words of each text that lie in an ``n``-word window found twice or more in it."""
    rows, h = words.rows(), words.hashes[words.index] if len(words.index) else np.zeros(0, U64)
    if len(h) < n:
        return np.zeros(len(words.starts) - 1, np.int64)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        key = mix(rows[:m].astype(U64) + U64(1))
        for k in range(n):
            key = mix(key + h[k : k + m])
    inside = np.flatnonzero(rows[:m] == rows[n - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    often = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    covered = np.zeros(len(h), dtype=np.int64)
    for k in range(n):
        covered[often + k] = 1
    return sums(covered, words.starts)


def score_documents(df: DataFrame, model: dict, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Statistics, ``quality_score`` (calibrated), ``base_failed`` and ``kept`` of every row.

    ``keep`` names further columns of ``df`` to carry along.
    """
    packed = df.sparkSession.sparkContext.broadcast(model)  # 2^18 floats, whatever the input
    fields = [f for f in df.select(*keep).schema] if keep else []
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema = f"doc_id long, {STATS}, quality_score double{extra}"

    def run(batches):
        own = packed.value
        for whole in batches:
            for batch in byte_slices(whole, 1, SLICE):
                texts = batch.column(1)
                words = words_of(texts)
                score = sigmoid(own["a"] * raw_scores(words, own["weights"], own["bias"]) + own["b"])
                columns = [pa.array(c, pa.int64()) for c in statistics(texts, words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *columns, pa.array(score, pa.float64()), *batch.columns[2:]],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality_score", *(f.name for f in fields)],
                )

    source = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c) for c in keep))
    scored = source.mapInArrow(lean(run), schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_score") >= threshold))


def keep_good(df: DataFrame, model: dict, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose texts pass the base rules and the classifier."""
    packed = df.sparkSession.sparkContext.broadcast(model)

    def good(texts: pa.Array) -> np.ndarray:
        own, words = packed.value, words_of(texts)
        score = sigmoid(own["a"] * raw_scores(words, own["weights"], own["bias"]) + own["b"])
        failed = (words.counts < min_words) | (100 * repeated_words(words) > 50 * words.counts)
        return ~failed & (score >= threshold)

    return rows_where(df, text_col, good, SLICE)
