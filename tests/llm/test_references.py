"""Learnt models and block rules against plain references, and the pipeline on odd tables."""

import collections
import itertools
import math
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from inodeatlas.llm import langid, pages, quality
from inodeatlas.llm.common import stored
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


class KneserNey:
    """Interpolated Kneser-Ney of one language by dictionaries, order by order."""

    def __init__(self, samples, lang, order):
        self.order, self.edge = order, chr(langid.EDGE)
        grams = {n: collections.Counter() for n in range(1, order + 1)}
        alphabet = set()
        for own, counts in samples.items():
            for word, times in counts.items():
                text = self.edge * (order - 1) + word + self.edge
                alphabet |= set(word) | {self.edge}
                for i in range(order - 1, len(text)) if own == lang else ():
                    grams[order][text[i - order + 1 : i + 1]] += times
        for n in range(order - 1, 0, -1):  # how many different characters come before a gram
            for gram in grams[n + 1]:
                grams[n][gram[1:]] += 1
        self.size = len(alphabet) + 1  # and one character that is none of these
        self.letters = sorted(alphabet)
        self.grams, self.context, self.kinds, self.discount = grams, {}, {}, {}
        for n, counts in grams.items():
            ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
            self.discount[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
            self.context[n], self.kinds[n] = collections.Counter(), collections.Counter()
            for gram, c in counts.items():
                self.context[n][gram[:-1]] += c
                self.kinds[n][gram[:-1]] += 1

    def p(self, char, before, n=None):
        n = self.order if n is None else n
        if n == 0:
            return 1 / self.size
        before = before[len(before) - (n - 1) :]
        lower = self.p(char, before[1:], n - 1)
        total = self.context[n][before]
        if not total:
            return lower
        own = max(self.grams[n][before + char] - self.discount[n], 0) / total if before + char in self.grams[n] else 0.0
        return own + self.discount[n] * self.kinds[n][before] / total * lower

    def log_p(self, word):
        text = self.edge * (self.order - 1) + word + self.edge
        return sum(math.log(self.p(text[i], text[i - self.order + 1 : i])) for i in range(self.order - 1, len(text)))


@pytest.mark.parametrize("order", [2, 3, 5])
def test_kneser_ney_equals_a_dictionary_model(order):
    rng = random.Random(order)
    say = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    samples = {"a": collections.Counter(say("abcd") for _ in range(60)), "b": collections.Counter(say("bcxyé") for _ in range(40)), "c": {"ab": 1}}
    model = langid.build({g: dict(c) for g, c in samples.items()}, order)
    asked = ["abc", "xyz", "b", "éééé", "nothing", "zq", "aaaaaaab", *list(samples["a"])[:10]]
    got = langid.log_probs(asked, model)
    for j, lang in enumerate(model["langs"]):
        plain = KneserNey(samples, lang, order)
        assert np.allclose(got[:, j], [plain.log_p(w) for w in asked], rtol=1e-5), lang
        for before in ("", "a", "ab", "bc", "xy", "zz", "abcdb"):  # probabilities of a context add up
            padded = plain.edge * (order - 1) + before
            assert math.isclose(sum(plain.p(c, padded) for c in plain.letters) + plain.p("?", padded), 1, rel_tol=1e-9)


def dense_fit(rows, rounds=120, rate=0.5, decay=1e-5, slots=40):
    """The same regression and calibration over a dense matrix."""
    x, y = np.zeros((len(rows), slots)), np.array([r[0] for r in rows], float)
    for i, (_, at, values) in enumerate(rows):
        np.add.at(x[i], at, values)
    held = np.arange(len(rows)) % 4 == 3
    a, b = x[~held], y[~held]
    share = np.where(b == 1, 0.5 / b.sum(), 0.5 / (1 - b).sum())
    w, bias, seen, seen_bias = np.zeros(slots), 0.0, np.full(slots, 1e-8), 1e-8
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(a @ w + bias))) - b) * share
        gradient, own = a.T @ error + decay * w, error.sum()
        seen, seen_bias = seen + gradient**2, seen_bias + own**2
        w, bias = w - rate * gradient / np.sqrt(seen), bias - rate * own / np.sqrt(seen_bias)
    return w, bias, x[held] @ w + bias, y[held]


def platt_loss(slope, shift, x, y):
    p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -60, 60)))
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    return -np.sum(weight * (target * np.log(p + 1e-300) + (1 - target) * np.log(1 - p + 1e-300)))


def test_regression_and_calibration_equal_a_dense_reference():
    rng = np.random.default_rng(7)
    rows = []
    for i in range(160):
        label = i // 4 % 2
        at = rng.choice(40, 12, replace=False)
        rows.append((label, at.astype("<i4"), (rng.random(12) + 0.4 * (at < 20) * label).astype("<f4")))
    got = quality.fit(rows)
    w, bias, x, y = dense_fit(rows)
    assert np.allclose(got["weights"][:40], w, atol=1e-4) and abs(got["bias"] - bias) < 1e-6 and not got["weights"][40:].any()
    best = platt_loss(got["a"], got["b"], x, y)  # no slope and shift nearby is better
    for da, db in itertools.product((-0.05, 0, 0.05), repeat=2):
        assert platt_loss(got["a"] + da, got["b"] + db, x, y) >= best - 1e-9


def second_pass(labels, headings, priors, links, sizes):
    """The labels after the second pass, each from its own scan to both sides."""
    n = len(labels)

    def nearest(i, step, decided):
        i += step
        while 0 <= i < n:
            if labels[i] in decided:
                return decided[labels[i]]
            i += step
        return None

    firm, near = {"good": "good", "bad": "bad"}, {"good": "good", "near": "good", "bad": "bad"}
    out = []
    for i, label in enumerate(labels):
        sides = {nearest(i, -1, near), nearest(i, 1, near)}
        if label == "short" and headings[i]:
            after = nearest(i, 1, near)
            label = "good" if after == "good" or (priors[i] and after is None and not links[i]) else "bad"
        elif label == "short":
            label = "good" if (("good" in sides or sides == {None}) if priors[i] else sides == {"good"}) else "bad"
        elif label == "near":
            around = {nearest(i, -1, firm), nearest(i, 1, firm)}
            label = "bad" if around == {"bad"} and sizes[i] < pages.LONG_CHARS else "good"
        out.append(label)
    return out


def test_second_pass_equals_a_plain_one():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(1, 9)
        labels = [rng.choice(["good", "bad", "short", "near"]) for _ in range(n)]
        headings, priors, links = ([rng.random() < 0.3 for _ in range(n)] for _ in range(3))
        sizes = [rng.choice([20, 100, 300]) for _ in range(n)]
        blocks = []
        for label, heading, prior, link, size in zip(labels, headings, priors, links, sizes):
            block = pages.Block("x" * size, 5 * link, False, True, heading)
            block.label, block.prior = label, prior
            blocks.append(block)
        pages._inherit(blocks)
        assert [b.label for b in blocks] == second_pass(labels, headings, priors, links, sizes)


def test_first_pass_by_its_thresholds():
    stop, plain = "the and of that with ", "kitten table window garden "

    def label(text, links=0, heading=False, prior=False):
        return pages._first_pass(pages.Block(text, links, False, prior, heading), prior)

    assert label((stop * 20).strip()) == "good" and label((stop * 4).strip()) == "near"
    assert label((plain * 4).strip()) == "bad" and label((plain * 4).strip(), prior=True) == "short"
    assert label((plain * 20).strip()) == "near" and label("short words") == "short" and label("short words", links=3) == "bad"
    assert label((stop * 20).strip(), links=200) == "bad" and label((stop * 20).strip(), links=200, prior=True) == "near"
    assert label("© 2024 somebody") == "out" and label("Share Tweet Email Print") == "out" and label("Share Tweet Email Print", heading=True) == "short"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and very long texts, copies and names that the stages use."""
    rng = random.Random(9)
    spoken = {"one": ["the", "ing", "an", "er", "tion", "ha"], "two": ["sch", "ein", "ung", "ver", "de", "ich"]}
    word = lambda lang: "".join(rng.choice(spoken[lang]) for _ in range(rng.randint(1, 3)))
    text = lambda lang, n: "\n".join(" ".join(word(lang) for _ in range(12)) + "." for _ in range(n // 12))
    rows = [(i, text(("one", "two")[i % 2], 120), ("one", "two")[i % 2], "s", None) for i in range(120)]
    rows += [(200 + i, "$$ ## " * 80 + text("one", 60), "one", "s", 0) for i in range(30)]
    rows += [(None, None, None, None, None), (None, "", None, None, None), (300, None, "one", "s", 0), (301, " \n", "two", None, 0), (302, "q" * 100_000, "one", "s", 1)]
    rows += [(303, rows[4][1], "one", "s", 0), (None, rows[6][1], "one", None, None), rows[8], rows[8], (304, rows[10][1] + " " + word("one"), "one", "s", 0), (305, text("two", 36_000), "two", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("k1", "mark", "node", "_row", "h", "class", "score"):
        docs = docs.withColumn(name, F.lit("own"))
    folder = str(tmp_path_factory.mktemp("odd"))
    labels = [(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(30)] + [(None, 1, 0), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs.repartition(3), folder


def test_stages_on_odd_rows(spark, odd):
    docs, folder = odd
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "stage")
        if name != "packing":
            assert docs.columns == columns and all(v == "own" for r in docs.select("k1", "mark", "node", "_row", "h", "class", "score").distinct().collect() for v in r)
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    # without a letter, or without enough words, a text goes; so do copies, the least id or the one with an id stays
    assert not {300, 301} & set(ids["language"]) and ids["language"].count(8) == 3
    assert 302 not in ids["quality"] and not set(range(200, 230)) & set(ids["quality"]) and 305 in ids["quality"]
    left = ids["near copies"]
    assert sorted(i for i in left if i is not None) == [*range(120), 305] and None not in left
    assert sorted(ids["repeats"]) == sorted(left) and sorted(ids["packing"]) == sorted(left)


def test_stages_on_empty_tables(spark, odd):
    docs, folder = odd
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, none, folder), "stage")
        assert out.count() == 0
        none = out if name != "packing" else none


def test_filters_equal_their_tables(spark, odd):
    """The stages keep what the operators' tables accept."""
    docs, folder = odd
    model = langid.train(docs, F.lit(True))
    verdicts = collections.Counter(r.doc_id for r in langid.identify(docs, model).filter("accepted").collect())
    assert collections.Counter(r.doc_id for r in langid.keep_known(docs, model).collect()) == verdicts
    learnt = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = collections.Counter(r.doc_id for r in quality.score_documents(docs, learnt).filter("kept").collect())
    assert collections.Counter(r.doc_id for r in quality.keep_good(docs, learnt).collect()) == kept


def test_long_texts_of_learnt_models():
    """A text of a million words is scored like its parts together."""
    model = langid.build({"a": {"abc": 3, "abd": 1}, "b": {"xyz": 4}}, 3)
    scorer = langid.Scorer(model)
    chars, totals = scorer(pa.array(["abc xyz " * 500_000, "abc xyz "]))
    assert chars[0] == 500_000 * chars[1] and np.allclose(totals[0], 500_000 * totals[1])
    words = quality.words_of(pa.array(["abc xyz " * 500_000]))
    assert words.counts.tolist() == [1_000_000] and quality.repeated_words(words).tolist() == [1_000_000]
