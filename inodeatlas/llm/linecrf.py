"""Quality by a linear-chain conditional random field over the lines of a text.

Every line with a word is good or bad. Its features are indicators of plain statistics (length,
letters, symbols, repetition), the same statistics of the line before and after, and its words
by hash. The field adds weights for the first line's label and for each pair of neighbouring
labels. Forward-backward gives each line the probability of being good; weighted by the
characters of the lines, their mean is the quality of the text, which a calibration fitted on
held-back rows (Platt) turns into a score.

Chains of any length and number are worked on at once: forward and backward products of 2 x 2
matrices come from a scan that doubles its step, so a text of 100,000 lines takes 17 passes over
its arrays, not 100,000 steps.

The lines of a labelled text are trained on its label, by gradient ascent on the log-likelihood of
the chains, each text with the same weight. The field is fitted on at most ``MAX_ROWS`` labelled rows of
each class, drawn by the hash of their id (a bound in expectation), a quarter of them held back for
the calibration, where classes have the weight of all labelled rows. Scores cover every row and
whole texts; only the text enters them.

Defined results: null texts, and texts without a word, count as one line without a word; rows with
different labels for one id are not learnt from; repeated rows of documents give one row each;
without rows of both classes every score is 0.5; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_slices, fitted, lean, mix, platt, range_sums, sigmoid, words_of

BITS = 14
MAX_ROWS = 1500
SLICE = 2_000_000
THRESHOLD = 0.3
SHARES = (0.0, 0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.7, 0.9)
SIZES = (1, 2, 4, 8, 16, 32, 64, 128, 256)
LETTERS = (2, 3, 4, 5, 6, 7, 8, 10, 14)
# statistics of a line and the edges of their bins
FEATURES = {
    "words": SIZES, "word_length": LETTERS, "upper": SHARES, "digits": SHARES, "symbols": SHARES, "punctuation": SHARES,
    "ends_in_mark": SHARES, "with_symbol": SHARES, "one_letter": SHARES, "echoes": SHARES, "repeated_words": SHARES, "repeated_triples": SHARES,
    "repeated_line": (0.5,), "closes": (0.5,), "opens_upper": (0.5,),
}
BINS = 10
WIDTH = BINS * len(FEATURES)
OTHER = WIDTH  # the weight of a neighbour that is not there
BLOCK = WIDTH + 1  # weights of the line itself, of the one before, of the one after
UPPER, DIGIT, SYMBOL, MARK = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[48:58] = UPPER, DIGIT
_KIND[[ord(c) for c in "#*$%&|<>~^_=+{}[]\\@"]] = SYMBOL
_KIND[[ord(c) for c in ".,;:!?()'\"-/`"]] = MARK


class Lines(NamedTuple):
    """Lines of a batch of texts: text t has the lines starts[t] .. starts[t + 1] - 1, one at least."""

    starts: np.ndarray
    chars: np.ndarray  # code points of each line, 1 at least
    bins: np.ndarray  # lines x FEATURES, places in the first block of weights
    word_starts: np.ndarray  # of each line in ``slots``
    slots: np.ndarray  # hashed word of each token


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _counts(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of large strings."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _kept_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines with a word, trimmed, and the text of each; a text without any has an empty one."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    lines = pc.ascii_trim_whitespace(split.flatten())
    row = np.asarray(pc.list_parent_indices(split)).astype(np.int64)
    full = np.asarray(pc.binary_length(lines)) > 0
    held = np.zeros(len(texts), bool)
    held[row[full]] = True
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else full
    keep = np.flatnonzero(full | (first & ~held[row]))
    return lines.take(pa.array(keep)), row[keep]


def _repeated_triples(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each token, whether it lies in a run of three words that its text has twice."""
    covered = np.zeros(len(h), bool)
    m = len(h) - 2
    if m <= 0:
        return covered
    with np.errstate(over="ignore"):
        key = mix(mix(mix(text[:m].astype(U64) + h[:m]) + h[1 : m + 1]) + h[2 : m + 2])
    inside = np.flatnonzero(text[:m] == text[2:])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    for k in range(3):
        covered[twice + k] = True
    return covered


def line_features(texts: pa.Array) -> Lines:
    lines, text = _kept_lines(texts)
    n = len(lines)
    data, edges = _raw(lines)
    kinds = _KIND[data]
    letters = _counts((data & 0xC0) != 0x80, edges)
    words = words_of(lines)
    index, starts, counts = words.index, words.starts, words.counts
    row = words.rows()
    h = words.hashes[index] if len(index) else np.zeros(0, U64)
    # of each different word: code points, last byte, whether it holds a symbol
    word_data, word_edges = _raw(words.unique.cast(pa.large_string()))
    long_ = _counts((word_data & 0xC0) != 0x80, word_edges)
    symbol = _counts(_KIND[word_data] == SYMBOL, word_edges) > 0
    mark, some = np.zeros(len(long_), bool), np.flatnonzero(np.diff(word_edges))
    mark[some] = _KIND[word_data[word_edges[1:][some] - 1]] == MARK
    ends = edges[1:] - 1
    filled = np.flatnonzero(np.diff(edges) > 0)
    closes, opens = np.zeros(n), np.zeros(n)
    closes[filled] = np.isin(data[ends[filled]], np.frombuffer(b".!?:;\"')", np.uint8))
    opens[filled] = kinds[edges[:-1][filled]] == UPPER
    # a line that an earlier line of its text equals
    with np.errstate(over="ignore"):
        line_hash = np.zeros(n, U64)
        np.add.at(line_hash, row, mix(h + (np.arange(len(row)) - starts[row]).astype(U64) * U64(0x9E3779B97F4A7C15)))
        line_hash = mix(line_hash + text.astype(U64))
    _, first, code = np.unique(line_hash, return_index=True, return_inverse=True)
    values = {
        "words": counts,
        "word_length": _share(_counts(long_[index], starts) if len(index) else counts, counts),
        "upper": _share(_counts(kinds == UPPER, edges), letters),
        "digits": _share(_counts(kinds == DIGIT, edges), letters),
        "symbols": _share(_counts(kinds == SYMBOL, edges), letters),
        "punctuation": _share(_counts(kinds == MARK, edges), letters),
        "ends_in_mark": _share(_counts(mark[index], starts) if len(index) else counts, counts),
        "with_symbol": _share(_counts(symbol[index], starts) if len(index) else counts, counts),
        "one_letter": _share(_counts(long_[index] == 1, starts) if len(index) else counts, counts),
        "echoes": _share(_counts(np.append(False, (index[1:] == index[:-1]) & (row[1:] == row[:-1]))[: len(index)], starts), counts),
        "repeated_words": _share(counts - np.bincount(np.unique(row * max(len(long_), 1) + index) // max(len(long_), 1), minlength=n), counts),
        "repeated_triples": _share(_counts(_repeated_triples(h, text[row]), starts), counts),
        "repeated_line": (first[code] != np.arange(n)) & (counts > 0),
        "closes": closes,
        "opens_upper": opens,
    }
    bins = np.empty((n, len(FEATURES)), np.int32)
    for i, (name, limits) in enumerate(FEATURES.items()):
        bins[:, i] = i * BINS + np.searchsorted(np.array(limits, np.float64), values[name].astype(np.float64), side="left")
    slots = (mix(h) >> U64(64 - BITS)).astype(np.int32)
    return Lines(np.searchsorted(text, np.arange(len(texts) + 1)), np.maximum(letters, 1), bins, starts, slots)


def joined(parts: list[Lines]) -> Lines:
    """The lines of several batches as those of one."""

    def edges(all_starts):
        return np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s) for s in all_starts]))])

    return Lines(edges([p.starts for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2)), edges([p.word_starts for p in parts]), np.concatenate([p.slots for p in parts]))


def _neighbours(lines: Lines) -> list[np.ndarray]:
    """Places of the weights of each line: own statistics, those of the line before and after."""
    n = len(lines.bins)
    opens, closes = lines.starts[:-1], lines.starts[1:] - 1
    before, after = np.roll(lines.bins, 1, axis=0) + BLOCK, np.roll(lines.bins, -1, axis=0) + 2 * BLOCK
    if n:
        before[opens], after[closes] = OTHER + BLOCK, OTHER + 2 * BLOCK
    return [lines.bins, before, after]


def line_scores(lines: Lines, model: dict) -> np.ndarray:
    """How much the features of each line speak for good."""
    out = np.full(len(lines.bins), model["bias"])
    for places in _neighbours(lines):
        out += model["weights"][places].sum(axis=1)
    return out + range_sums(model["words"][lines.slots], lines.word_starts) / np.maximum(np.diff(lines.word_starts), 1)


def _products(matrix: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Products of the 2 x 2 matrices (2, 2, n) of each chain up to each place, up to a factor."""
    out = matrix / matrix.max(axis=(0, 1))
    place = np.arange(matrix.shape[2]) - begins
    step = 1
    while True:
        at = np.flatnonzero(place >= step)
        if not len(at):
            return out
        a, b = out[:, :, at - step], out[:, :, at]
        made = np.stack([a[:, 0] * b[0, j] + a[:, 1] * b[1, j] for j in (0, 1)], axis=1)
        out = out.copy()
        out[:, :, at] = made / made.max(axis=(0, 1))
        step *= 2


def marginals(score: np.ndarray, starts: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of (bad, good) of each line (2, n), and of each pair with the line before (2, 2, n).

    ``score`` is the log-weight of good, ``start`` that of the first label, ``step`` that of a label after a label.
    """
    n = len(score)
    sizes = np.diff(starts)
    begins = np.repeat(starts[:-1], sizes)
    first = np.zeros(n, bool)
    first[starts[:-1][sizes > 0]] = True
    own = np.exp(np.stack([np.zeros(n), np.clip(score, -30, 30)]))
    matrix = np.exp(step)[:, :, None] * own[None]
    opened = matrix.copy()
    opened[:, :, first] = (np.exp(start)[:, None] * own[:, first])[None]
    forward = _products(opened, begins)[0]
    # backward: the transposed matrices of a chain from its end; the first line's matrix is not part of it
    ends = np.repeat(starts[1:], sizes) - 1
    turned = _products(matrix.transpose(1, 0, 2)[:, :, ::-1], (n - 1 - ends)[::-1])[:, :, ::-1].transpose(1, 0, 2)
    backward = np.ones((2, n))
    inner = np.flatnonzero(~first)
    backward[:, inner - 1] = turned[:, :, inner].sum(axis=1)
    line = forward * backward
    line /= line.sum(axis=0)
    pair = np.zeros((2, 2, n))
    pair[:, :, inner] = forward[:, None, inner - 1] * matrix[:, :, inner] * backward[None, :, inner]
    pair[:, :, inner] /= pair[:, :, inner].sum(axis=(0, 1))
    return line, pair


def text_quality(lines: Lines, model: dict) -> np.ndarray:
    """Mean probability of good over the characters of each text."""
    line, _ = marginals(line_scores(lines, model), lines.starts, model["start"], model["step"])
    return range_sums(line[1] * lines.chars, lines.starts) / range_sums(lines.chars.astype(np.float64), lines.starts)


def gradient(lines: Lines, label: np.ndarray, weight: np.ndarray, model: dict) -> dict:
    """Gradient of the weighted log-likelihood of the chains, all lines of a text having its label."""
    sizes = np.diff(lines.starts)
    y, share = np.repeat(label, sizes), np.repeat(weight / sizes, sizes)
    line, pair = marginals(line_scores(lines, model), lines.starts, model["start"], model["step"])
    error = share * (y - line[1])
    out = {"bias": error.sum(), "weights": np.zeros(3 * BLOCK)}
    for places in _neighbours(lines):
        out["weights"] += np.bincount(places.ravel(), np.repeat(error, places.shape[1]), minlength=3 * BLOCK)
    tokens = np.diff(lines.word_starts)
    out["words"] = np.bincount(lines.slots, np.repeat(error / np.maximum(tokens, 1), tokens), minlength=1 << BITS)
    opens = lines.starts[:-1]
    seen = np.stack([1 - label, label])
    out["start"] = ((seen - line[:, opens]) * (weight / sizes)).sum(axis=1)
    inner = np.ones(len(y), bool)
    inner[opens] = False
    out["step"] = np.diag([(share * inner)[y == k].sum() for k in (0, 1)]) - (pair * share).sum(axis=2)
    return out


def _logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def empty_model() -> dict:
    return {"bias": 0.0, "weights": np.zeros(3 * BLOCK), "words": np.zeros(1 << BITS), "start": np.zeros(2), "step": np.zeros((2, 2)), "a": 0.0, "b": 0.0}


def fit(lines: Lines, label: np.ndarray, class_sizes: tuple[int, int], rounds: int = 150, rate: float = 0.2, decay: float = 2e-4) -> dict:
    """Weights and calibration from texts with labels; ``class_sizes`` are those of all labelled rows."""
    model = empty_model()
    if len(set(label.tolist())) < 2:
        return model
    held = np.arange(len(label)) % 4 == 3
    if len(set(label[held].tolist())) < 2 or len(set(label[~held].tolist())) < 2:
        held[:] = False
    own = _some(lines, np.flatnonzero(~held))
    y = label[~held].astype(np.float64)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # classes weigh the same
    seen = {k: np.zeros_like(np.asarray(v, np.float64)) + 1e-8 for k, v in model.items() if k not in ("a", "b")}
    for _ in range(rounds):  # AdaGrad over all rows
        for k, g in gradient(own, y, weight, model).items():
            g = g - decay * model[k] * (k != "bias")
            seen[k] = seen[k] + g**2
            model[k] = model[k] + rate * g / np.sqrt(seen[k])
    rest = np.flatnonzero(held) if held.any() else np.arange(len(label))
    y = label[rest].astype(np.float64)
    weight = np.where(y == 1, class_sizes[1] / y.sum(), class_sizes[0] / (1 - y).sum())
    model["a"], model["b"] = platt(_logit(text_quality(_some(lines, rest), model)), y, weight, least=1e-3)
    return model


def _some(lines: Lines, texts: np.ndarray) -> Lines:
    """The lines of the given texts."""
    def spread(starts, of):
        sizes = np.diff(starts)[of]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return np.repeat(starts[of] - edges[:-1], sizes) + np.arange(edges[-1]), edges

    line, starts = spread(lines.starts, texts)
    token, word_starts = spread(lines.word_starts, line)
    return Lines(starts, lines.chars[line], lines.bins[line], word_starts, lines.slots[token])


def train(documents: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> dict:
    """The field fitted on labelled rows of ``documents`` where ``learn`` holds for their doc_id."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"), F.min("quality").alias("low"))
        .filter("quality = low")
    )
    sizes = dict(marked.groupBy("quality").count().collect())
    share = F.lit(0.0)
    for quality, n in sizes.items():
        share = F.when(F.col("quality") == quality, F.lit(min(1.0, max_rows / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("lines"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = marked.filter(draw < share).select("doc_id", "quality")
    # the drawn ids are bounded by max_rows of each class
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    kinds = ("<i4", "<i4", "<i2", "<i4", "<i2")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lines = line_features(batch.column(2).slice(i, 1))
                packed = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(lines, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *packed], ["doc_id", "quality", *Lines._fields])

    def learn_from(batches):
        rows = [(*(c[i].as_py() for c in b.columns[:2]), *(c[i].as_buffer() for c in b.columns[2:])) for b in batches for i in range(b.num_rows)]
        rows.sort(key=lambda r: (r[0], hashlib.sha256(r[4]).digest(), hashlib.sha256(r[6]).digest()))
        parts = [Lines(*(np.frombuffer(x, kind).reshape((-1, len(FEATURES)) if i == 2 else -1) for i, (x, kind) in enumerate(zip(r[2:], kinds)))) for r in rows]
        if not parts:
            return empty_model()
        return fit(joined(parts), np.array([r[1] for r in rows]), (sizes.get(0, 0), sizes.get(1, 0)))

    schema = "doc_id long, quality int, " + ", ".join(f"{f} binary" for f in Lines._fields)
    return fitted(sample.mapInArrow(lean(run), schema), learn_from)


def score_texts(texts: pa.Array, model: dict) -> np.ndarray:
    return sigmoid(model["a"] * _logit(text_quality(line_features(texts), model)) + model["b"])


def score_documents(df: DataFrame, model: dict, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    packed = df.sparkSession.sparkContext.broadcast(model)  # 2^14 weights and some hundred more

    def run(batches):
        own = packed.value
        for whole in batches:
            for batch in byte_slices(whole, 1, SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1), own), pa.float64())], ["doc_id", "score"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lean(run), "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def line_labels(texts: pa.Array, model: dict) -> list[list[tuple[str, float]]]:
    """The lines of each text with their probability of being good."""
    lines, text = _kept_lines(texts)
    found = line_features(texts)
    line, _ = marginals(line_scores(found, model), found.starts, model["start"], model["step"])
    names = lines.to_pylist()
    return [[(names[i], float(line[1][i])) for i in range(a, b)] for a, b in zip(found.starts[:-1], found.starts[1:])]
