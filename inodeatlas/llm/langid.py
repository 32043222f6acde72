"""Language identification by interpolated Kneser-Ney models of characters.

Each language has a model of the letters of its words: order ``ORDER``, with contexts that end at
the border of a word, absolute discounting, continuation counts below the highest order and a
uniform floor. Grams of all languages are kept as 64-bit hashes in one sorted array for each
order, with a column of probabilities for each language; where a gram is in the array, its
probability is fully interpolated already, so most letters need one search.

The words to learn from are a sample of at most ``MAX_CHARS`` characters of each language in
expectation, taken word by word by hash; the bound keeps the model small enough to broadcast.
A text gets the language of the lowest cross-entropy for each character. Rejection is calibrated
on labelled texts outside the sample (at most ``MAX_CALIBRATION`` of each language). Labels may be
wrong and texts noise, so centre and spread are medians over the texts whose best language is their
label, and the limit leaves out those beyond halfway to the entropy of the language's single
letters. A text is rejected if its cross-entropy, in standard errors for its length, lies beyond
what all but a share ``FALSE_REJECTION`` of the texts left show (and beyond ``LEAST_LIMIT``), and
above the entropy of single letters, so that the contexts explain nothing; or if it has no letter.

Defined results: null texts and texts without a letter get ``und``, score 0 and are rejected; ties
go to the smaller name; without any language to learn from, every text gets ``und``; repeated rows
give one row each.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, fitted, lean, mix, range_sums, rows_where, unit, words_of

ORDER = 5
MAX_CHARS = 1_500_000
WORDS_AT_ONCE = 20_000
CHARS_AT_ONCE = 1_000_000
MAX_CALIBRATION = 1500
FALSE_REJECTION = 0.001
LEAST_LIMIT = 8.0
UNKNOWN = "und"
EDGE = 2  # code point that stands for the border of a word


def letters_of(words: list[str]) -> list[str]:
    """Words in lower case without anything but letters."""
    out = []
    for word in words:
        if not word.isalpha():
            word = word.strip("#*$%&|<>.,;:!?\"'()[]{}-_/=+0123456789")
            if not word.isalpha():
                word = "".join(c for c in word if c.isalpha())
        out.append(word.lower())
    return out


def gram_hashes(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash of the n-gram that ends at each character, for n = 1..order, and where words begin.

    A word has its letters and its right border as characters, and borders to its left.
    """
    edge, pad = chr(EDGE), chr(EDGE) * (order - 1)
    text = "".join(pad + w + edge for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(np.arange(len(words)) * (order - 1) + (order - 1), lengths) + np.arange(starts[-1])
    grams, h = [], np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for n in range(order):
            h = h * U64(0x9E3779B97F4A7C15) + codes[at - n] + U64(1)
            grams.append(mix(h + U64(n << 40)))
    return grams, starts


def context_hashes(words: list[str], order: int) -> list[np.ndarray]:
    """Hash of the n - 1 characters before each character, for n = 1..order."""
    edge, pad = chr(EDGE), chr(EDGE) * (order - 1)
    text = "".join(pad + w + edge for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    total = int(lengths.sum())
    at = np.repeat(np.arange(len(words)) * (order - 1) + (order - 1), lengths) + np.arange(total)
    out, h = [], np.zeros(total, U64)
    with np.errstate(over="ignore"):
        for n in range(order):
            out.append(mix(h + U64((n + 100) << 40)))
            if n + 1 < order:
                h = h * U64(0x9E3779B97F4A7C15) + codes[at - n - 1] + U64(1)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _entropy(counts: np.ndarray) -> float:
    """Entropy in nats of a distribution given by counts."""
    p = counts[counts > 0] / max(counts.sum(), 1)
    return float(-np.sum(p * np.log(p)))


def _weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values)
    total = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(total, total[-1] / 2)])


def build(samples: dict[str, dict[str, int]], order: int = ORDER) -> dict:
    """Models from word counts of each language."""
    langs = sorted(samples)
    model = {"langs": langs, "order": order, "grams": [], "probs": [], "contexts": [], "back": []}
    if not langs:
        return model
    vocabulary = sorted(set().union(*samples.values()))
    grams, starts = gram_hashes(vocabulary, order)
    contexts = context_hashes(vocabulary, order)
    rep = np.diff(starts)
    weights = [np.repeat(np.array([samples[g].get(w, 0) for w in vocabulary], dtype=np.float64), rep) for g in langs]
    below = None  # of each order, for the positions of the vocabulary
    alphabet = len(np.unique(grams[0])) + 1
    for n in range(order):
        keys, first, inverse = np.unique(grams[n], return_index=True, return_inverse=True)
        ctx_keys, ctx_inverse = np.unique(contexts[n], return_inverse=True)
        ctx_of = ctx_inverse[first]
        probs = np.zeros((len(keys), len(langs)))
        back = np.ones((len(ctx_keys), len(langs)))
        lower = below[first] if below is not None else np.full((len(keys), len(langs)), 1.0 / alphabet)
        for j in range(len(langs)):
            if n == order - 1:
                count = np.bincount(inverse, weights[j], minlength=len(keys))
            else:  # how many different characters come before the gram in this language
                longer, at = np.unique(grams[n + 1][weights[j] > 0], return_index=True)
                count = np.bincount(inverse[weights[j] > 0][at], minlength=len(keys)).astype(np.float64)
            ones, twos = np.sum(count == 1), np.sum(count == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total = np.bincount(ctx_of, count, minlength=len(ctx_keys))
            kinds = np.bincount(ctx_of, count > 0, minlength=len(ctx_keys))
            back[:, j] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.maximum(count - discount, 0) / np.maximum(total[ctx_of], 1)
            probs[:, j] = own + back[ctx_of, j] * lower[:, j]
        below = probs[inverse]
        if n == 0:  # what the letters alone leave open, whatever the alphabet of the others
            model["single"] = np.array([_entropy(np.bincount(inverse, w)) for w in weights])
        model["grams"].append(keys)
        model["probs"].append(np.log(probs).astype(np.float32))
        model["contexts"].append(ctx_keys)
        model["back"].append(np.log(back).astype(np.float32))
    model["floor"] = float(np.log(1.0 / alphabet))
    model["center"] = np.zeros(len(langs))
    model["spread"] = np.ones(len(langs))
    model["limit"] = np.inf
    return model


def log_probs(words: list[str], model: dict) -> np.ndarray:
    """Natural log-probability of each word under each language."""
    grams, starts = gram_hashes(words, model["order"])
    contexts = None
    total = len(grams[0])
    out = np.zeros((total, len(model["langs"])), np.float32)
    open_, n = np.arange(total), model["order"] - 1
    while len(open_) and n >= 0:
        at, found = _find(model["grams"][n], grams[n][open_])
        out[open_[found]] += model["probs"][n][at[found]]
        open_ = open_[~found]
        if len(open_):  # back off: the weight of the context, then the shorter gram
            contexts = contexts or context_hashes(words, model["order"])
            at, found = _find(model["contexts"][n], contexts[n][open_])
            out[open_[found]] += model["back"][n][at[found]]
        n -= 1
    out[open_] += model["floor"]
    return np.stack([range_sums(out[:, j].astype(np.float64), starts) for j in range(out.shape[1])], axis=1)


class Scorer:
    """Cross-entropies of texts; keeps the scores of words of the batch only."""

    def __init__(self, model: dict):
        self.model = model

    def __call__(self, texts: pa.Array):
        """Letters with borders of each text, and its log-probability under each language."""
        words = words_of(texts)
        clean = letters_of(words.unique.cast(pa.large_string()).to_pylist())
        sizes = np.fromiter(map(len, clean), dtype=np.int64, count=len(clean))
        some = np.flatnonzero(sizes)
        each = np.zeros((len(clean), len(self.model["langs"])))
        for i in range(0, len(some) if self.model["langs"] else 0, WORDS_AT_ONCE):
            own = some[i : i + WORDS_AT_ONCE]
            each[own] = log_probs([clean[k] for k in own], self.model)
        lengths = np.where(sizes > 0, sizes + 1, 0)
        chars = range_sums(lengths[words.index], words.starts)
        totals = np.stack([range_sums(each[words.index, j], words.starts) for j in range(each.shape[1])], axis=1) if self.model["langs"] else np.zeros((len(chars), 0))
        return chars, totals


def _standard(model: dict, chars: np.ndarray, entropy: np.ndarray, best: np.ndarray) -> np.ndarray:
    return (entropy - model["center"][best]) * np.sqrt(np.maximum(chars, 1)) / model["spread"][best]


def predict(texts: pa.Array, scorer: Scorer):
    """Names, scores, cross-entropies and acceptance of a batch, by slices of bounded size."""
    edges = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)) // CHARS_AT_ONCE
    starts = np.flatnonzero(np.concatenate([[True], edges[1:] != edges[:-1]])) if len(texts) else np.zeros(1, np.int64)
    parts = [_predict(texts.slice(a, b - a), scorer) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(texts)])]
    return [n for p in parts for n in p[0]], *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))


def _predict(texts: pa.Array, scorer: Scorer):
    model = scorer.model
    chars, totals = scorer(texts)
    n = len(chars)
    if not model["langs"]:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
    best = totals.argmax(axis=1)
    top = totals[np.arange(n), best]
    score = 1.0 / np.exp(np.clip(totals - top[:, None], -700, 0)).sum(axis=1)
    entropy = -top / np.maximum(chars, 1)
    some = chars > 0
    names = [model["langs"][b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist())]
    strange = (_standard(model, chars, entropy, best) > model["limit"]) & (entropy > model["single"][best])
    accepted = some & ~strange
    return names, np.where(some, score, 0.0), np.where(some, entropy, 0.0), accepted


def train(documents: DataFrame, learn: Column, order: int = ORDER, max_chars: int = MAX_CHARS, max_calibration: int = MAX_CALIBRATION) -> dict:
    """Learn from text and lang of the rows where ``learn`` holds."""
    rows = documents.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.xxhash64("doc_id", F.lit(7)).alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("lang").agg(F.sum(F.length("text")), F.count("*")).collect()}
    share = {g: min(1.0, max_chars / max(n, 1)) for g, (n, _) in sizes.items()}
    part = {g: min(0.5, max_calibration / max(n, 1)) for g, (_, n) in sizes.items()}

    def aside(hashes, langs):
        """Rows for calibration; the others are for learning."""
        return unit(mix(hashes)) <= np.array([part.get(g, 0.0) for g in langs])

    def sample(batches):
        for batch in batches:
            langs = batch.column(2).to_pylist()
            h = np.asarray(batch.column(0)).astype(U64)
            words = words_of(batch.column(1))
            at = words.rows()
            rate = np.where(aside(h, langs), 0.0, np.array([share.get(g, 0.0) for g in langs]))[at]
            with np.errstate(over="ignore"):
                chosen = unit(mix(mix(h)[at] + np.arange(len(at)).astype(U64) - words.starts[:-1].astype(U64)[at])) <= rate
            code = {g: i for i, g in enumerate(sorted(set(langs)))}
            lang_of = np.array([code[g] for g in langs], dtype=np.int64)[at[chosen]]
            keys, n = np.unique(words.index[chosen] * len(code) + lang_of, return_counts=True)
            names, order_ = words.unique.cast(pa.large_string()), sorted(code)
            yield pa.RecordBatch.from_arrays(
                [pa.array([order_[k] for k in (keys % max(len(code), 1)).tolist()], pa.string()), names.take(pa.array(keys // max(len(code), 1), pa.int64())).cast(pa.string()), pa.array(n, pa.int64())],
                ["lang", "word", "n"],
            )

    counted = rows.mapInArrow(lean(sample), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    def learn_words(batches):
        samples: dict[str, dict[str, int]] = {}
        for batch in batches:
            langs, words, counts = (c.to_pylist() for c in batch.columns)
            for lang, word, n in zip(langs, letters_of(words), counts):
                if word:
                    own = samples.setdefault(lang, {})
                    own[word] = own.get(word, 0) + n
        return build(samples, order)

    model = fitted(counted, learn_words)
    if not model["langs"]:
        return model
    packed = documents.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches):
        scorer = Scorer(packed.value)
        code = {g: i for i, g in enumerate(scorer.model["langs"])}
        for batch in batches:
            langs = batch.column(2).to_pylist()
            keep = np.flatnonzero(aside(np.asarray(batch.column(0)).astype(U64), langs) & np.array([g in code for g in langs], dtype=bool))
            if not len(keep):
                continue
            chars, totals = scorer(batch.column(1).take(pa.array(keep)))
            own = np.array([code[langs[k]] for k in keep.tolist()])
            entropy = -totals[np.arange(len(own)), own] / np.maximum(chars, 1)
            ok = (chars > 0) & (totals.argmax(axis=1) == own)  # others are mislabelled or noise
            yield pa.RecordBatch.from_arrays([pa.array(own[ok], pa.int32()), pa.array(chars[ok], pa.int64()), pa.array(entropy[ok], pa.float64())], ["lang", "chars", "entropy"])

    seen = rows.mapInArrow(lean(calibrate), "lang int, chars long, entropy double").collect()
    lang, chars, entropy = (np.array([r[i] for r in seen], dtype=t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    worst = []
    for j in range(len(model["langs"])):
        own = lang == j
        if own.sum() < 2:
            model["center"][j], model["spread"][j] = -model["floor"], 1e9  # nothing known: no rejection
            continue
        model["center"][j] = _weighted_median(entropy[own], chars[own])
        z = (entropy[own] - model["center"][j]) * np.sqrt(chars[own])
        model["spread"][j] = max(1.4826 * np.median(np.abs(z)), 1e-6)
        halfway = (model["center"][j] + model["single"][j]) / 2
        worst.append(z[entropy[own] <= max(halfway, model["center"][j])] / model["spread"][j])
    model["limit"] = max(LEAST_LIMIT, float(np.quantile(np.concatenate(worst), 1 - FALSE_REJECTION))) if worst else np.inf
    return model


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, accepted) of every row, and the columns named in ``keep``."""
    packed = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    fields = list(df.select(*keep).schema) if keep else []
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        scorer = Scorer(packed.value)
        for batch in batches:
            names, score, entropy, accepted = predict(batch.column(1), scorer)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(accepted, pa.bool_()), *batch.columns[2:]],
                ["doc_id", "lang_pred", "score", "entropy", "accepted", *(f.name for f in fields)],
            )

    source = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c) for c in keep))
    return source.mapInArrow(lean(run), f"doc_id long, lang_pred string, score double, entropy double, accepted boolean{extra}")


def keep_known(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose texts are in one of the learnt languages."""
    packed = df.sparkSession.sparkContext.broadcast(model)
    return rows_where(df, text_col, lambda texts: predict(texts, Scorer(packed.value))[3], CHARS_AT_ONCE)
