"""Many queries at once, fill-in-middle and the field over lines: brute force and odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from inodeatlas.llm import linecrf, manyqueries, middle, suffixes
from inodeatlas.llm.common import crc_mod
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(texts):
    return [(i, t, "ab", "s", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    vocabulary = [w + x for w in "alpha Beta gamma delta ÉTÉ zeta eta x1 _ 東京".split() for x in ("", "s", "É", "9")]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += [texts[3], texts[3], None, "", " \n", "...", "alpha", "<P> alpha", "a<S", "🤦‍♂️ á é", "beta " * 30_000, "É" * 70_000]
    rows = [*rows_of(texts), (3, texts[3], "ab", "s", 0), (None, "gamma alpha", None, None, None), (None, "gamma alpha", None, None, None)]
    # extra columns with names that the operators use themselves
    df = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit(1)).withColumn("_text", F.lit("t")).withColumn("n", F.lit(2)).withColumn("terms", F.lit(3))
    return df.repartition(5, "n_chars", "doc_id")


def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def brute_search(docs, items, k):
    own = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, total = len(own), sum(len(t) for _, t in own)
    df = Counter(x for _, t in own for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for doc, t in own:
            tf, m, score = Counter(t), 50 + (50 * len(t) * n_docs) // total, 0
            for x in set(terms(text)):
                if tf[x]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return out


ITEMS = [(0, "alpha betas, gamma"), (1, "Alpha gamma delta zeta"), (2, "alpha gamma delta éTÉ unknown"), (3, None), (4, ""), (5, "nothing_here"), (5, "eta ETA etas"), (None, "x1 東京9"), (6, "alpha alpha ALPHA gamma delta zeta beta")]


@pytest.mark.parametrize("block_terms", [50_000, 6])
@pytest.mark.parametrize("k", [1, 7, 400])
def test_many_queries(spark, docs, k, block_terms):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item_row", F.lit("x")).withColumn("doc_id", F.lit(1))
    found = manyqueries.search(docs, items, k=k, block_terms=block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_search([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], ITEMS, k)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_many_queries_without_rows(spark, docs):
    none, items = docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert manyqueries.search(none, items).count() == 0
    assert manyqueries.search(docs, items.limit(0)).count() == 0
    assert manyqueries.search(docs, items.filter("item_id in (3, 4, 5)").filter("text is null or text = ''")).count() == 0


@pytest.mark.parametrize("reach", [1, 3, 16])
def test_shared_sets_are_sums_of_their_terms(reach):
    rng = np.random.default_rng(reach)
    lists = [np.unique(rng.zipf(1.4, 30) % 80) for _ in range(40)] + [np.zeros(0, np.int64), np.array([5]), np.arange(80)]
    starts = np.cumsum([0, *map(len, lists)])
    graph = manyqueries.share(np.concatenate(lists), starts, 90, reach)
    value = rng.integers(0, 1 << 40, (90, 6))
    term, doc = np.nonzero(value >= 0)
    got = manyqueries.accumulate(graph, term, doc, value[term, doc], 6)
    assert (got == np.array([value[x].sum(axis=0) for x in lists])).all()
    # sets are shared: fewer additions than term by term, and each node stands in two lists at least
    assert len(graph.left) + len(graph.lists) < 0.8 * starts[-1]
    held_by = [set() for _ in range(90 + len(graph.left))]
    for item, (begin, end) in enumerate(itertools.pairwise(graph.starts)):
        for node in graph.lists[begin:end]:
            held_by[node].add(item)
    for i in reversed(range(len(graph.left))):
        for part in (graph.left[i], graph.right[i]):
            held_by[part] |= held_by[90 + i]
    assert all(len(x) >= 2 for x in held_by[90:])


def draw(doc, seed=1):
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def test_fill_in_middle(spark, docs):
    made = middle.fill_in_middle(docs).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    got = made.collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        text, (h1, h2, h3, h4) = r.text or "", draw(r.doc_id)
        n = len(text)
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want.append((r.doc_id, n, "plain", None, None, text, text))
            continue
        p, m, s = text[:low], text[low:high], text[high:]
        form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
        want.append((r.doc_id, n, form, low, high - low, output, text))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_pieces_that_look_like_marks(spark):
    texts = ["<", "<S", "S>", "<<P", "P><", "a<M" * 5, "<P<S<M", ">>", "<S <P <M"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = middle.fill_in_middle(df, cut_percent=100, spm_percent=50)
    assert made.filter(middle.restored(F.col("output"), F.col("form")) != F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") + 1).cast("int"))).count() == 0
    assert made.filter("form = 'plain'").count() == 0


def test_slices_of_texts(spark, docs, monkeypatch):
    whole = sorted(map(tuple, middle.fill_in_middle(docs).collect()), key=repr)
    batch = pa.RecordBatch.from_pydict({"t": ["é" * 5, None, "", "abc", "x" * 9]})
    assert [b.num_rows for b in middle.byte_slices(batch, 0, 10)] == [3, 1, 1]
    monkeypatch.setattr(middle, "SLICE", 50)
    assert sorted(map(tuple, middle.fill_in_middle(docs).collect()), key=repr) == whole


def chain_sums(score, start, step):
    """Marginals of one chain from all its labellings."""
    n, line, pair = len(score), np.zeros((2, len(score))), np.zeros((2, 2, len(score)))
    for ys in itertools.product((0, 1), repeat=n):
        w = math.exp(start[ys[0]] + sum(score[i] * ys[i] for i in range(n)) + sum(step[ys[i - 1], ys[i]] for i in range(1, n)))
        for i in range(n):
            line[ys[i], i] += w
            if i:
                pair[ys[i - 1], ys[i], i] += w
    z = line[:, 0].sum()
    return line / z, pair / z, math.log(z)


def test_marginals_equal_sums_over_labellings():
    rng = np.random.default_rng(0)
    starts = np.array([0, 1, 4, 9, 19])
    score, start, step = rng.normal(0, 2, 19), rng.normal(size=2), rng.normal(size=(2, 2))
    line, pair = linecrf.marginals(score, starts, start, step)
    for a, b in itertools.pairwise(starts):
        want = chain_sums(score[a:b], start, step)
        assert np.allclose(line[:, a:b], want[0]) and np.allclose(pair[:, :, a:b], want[1])


def test_long_chains_stay_finite():
    score = np.random.default_rng(1).normal(0, 20, 100_000)
    line, pair = linecrf.marginals(score, np.array([0, 99_999, 100_000]), np.zeros(2), np.array([[3.0, -3.0], [-3.0, 3.0]]))
    assert np.isfinite(line).all() and np.isfinite(pair).all() and np.allclose(line.sum(axis=0), 1)


def test_gradient_equals_differences_of_the_likelihood():
    texts = ["Good line here.\nAnd more.\nEnd of it", "### $$$\nBAD!! BAD!!", "a b a b a b"]
    lines = linecrf.line_features(pa.array(texts))
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([0.2, 0.5, 0.3])
    rng = np.random.default_rng(2)
    model = linecrf.empty_model()
    for k in ("weights", "words", "start", "step"):
        model[k] = rng.normal(0, 0.3, np.shape(model[k]))

    def likelihood(m):
        score, total = linecrf.line_scores(lines, m), 0.0
        for t, (a, b) in enumerate(itertools.pairwise(lines.starts)):
            y = int(label[t])
            own = m["start"][y] + score[a:b].sum() * y + (b - a - 1) * m["step"][y, y]
            total += weight[t] / (b - a) * (own - chain_sums(score[a:b], m["start"], m["step"])[2])
        return total

    got = linecrf.gradient(lines, label, weight, model)
    places = [("bias", ()), ("start", 0), ("start", 1), *(("step", x) for x in itertools.product((0, 1), repeat=2))]
    places += [("weights", int(i)) for i in np.flatnonzero(got["weights"])[::7]] + [("words", int(i)) for i in np.flatnonzero(got["words"])[:5]]
    for name, at in places:
        up, down = ({k: np.array(v, np.float64) for k, v in model.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert abs((likelihood(up) - likelihood(down)) / 2e-5 - np.asarray(got[name])[at]) < 1e-6, (name, at)


def test_lines_and_their_statistics():
    texts = pa.array(["One two.\n\n  \nTHREE three three\nOne two.", None, " ", "a b c a b c\r\n", "$$$ x1"])
    lines = linecrf.line_features(texts)
    assert lines.starts.tolist() == [0, 3, 4, 5, 6, 7]
    assert lines.chars.tolist() == [8, 17, 8, 1, 1, 11, 6]
    at = {f: i for i, f in enumerate(linecrf.FEATURES)}
    bin_of = lambda line, f: lines.bins[line, at[f]] - linecrf.BINS * at[f]
    assert [bin_of(i, "repeated_line") for i in range(3)] == [0, 0, 1]
    assert bin_of(1, "echoes") == np.searchsorted(linecrf.SHARES, 1 / 3) and bin_of(5, "repeated_triples") == 9
    assert bin_of(6, "symbols") == np.searchsorted(linecrf.SHARES, 0.5) and bin_of(6, "digits") == np.searchsorted(linecrf.SHARES, 1 / 6)
    own, before, after = linecrf._neighbours(lines)
    assert (before[1] - linecrf.BLOCK == own[0]).all() and (after[1] - 2 * linecrf.BLOCK == own[2]).all()
    assert (before[[0, 3, 4, 5, 6]] == linecrf.OTHER + linecrf.BLOCK).all()


def test_slices_of_lines():
    texts = pa.array(["x y\nz", "  lead", None, "One two.\n\nONE TWO!!\n$$", "é è\n", "tail \t\n last"])
    whole = linecrf.line_features(texts)
    for a, b in itertools.combinations(range(7), 2):
        part, lines = linecrf.line_features(texts.slice(a, b - a)), slice(whole.starts[a], whole.starts[b])
        assert (part.bins == whole.bins[lines]).all() and (part.chars == whole.chars[lines]).all()
        assert (part.slots == whole.slots[whole.word_starts[lines.start] : whole.word_starts[lines.stop]]).all()


def noisy(rng, bad):
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    lines = [say(rng.randint(3, 15)).capitalize() + "." for _ in range(rng.randint(2, 7))]
    return "\n".join(x.upper().replace(" ", "!! ") if bad and i else x for i, x in enumerate(lines))


def test_held_out_quality(spark):
    rng = random.Random(11)
    rows = [(i, noisy(rng, i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "ab", "s", 0) for i, t in rows] + [(None, None, None, None, None), (9000, "x y\n" * 60_000, "", "", 1)], SCHEMA).withColumn("quality", F.lit("clash")).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows if i % 3] + [(1, 1, 0), (2, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    learn = crc_mod("doc_id", 5) != 0
    model = linecrf.train(docs, labels, learn)
    got = {r.doc_id: r for r in linecrf.score_documents(docs, model).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == int(i % 4 != 0) for i in held) >= 0.95 * len(held)
    # held-out labels are not learnt from
    turned = labels.withColumn("quality", F.when(learn, F.col("quality")).otherwise(1 - F.col("quality")))
    again = {r.doc_id: r.score for r in linecrf.score_documents(docs, linecrf.train(docs, turned, learn)).collect()}
    assert again == {d: r.score for d, r in got.items()}
    # lines of a bad text: the first one is as in good texts
    shown = linecrf.line_labels(pa.array(["Abc def gh.\nABC!! DEF!! GH!!\nXYZ!! ABC!!"]), model)[0]
    assert [x for x, _ in shown] == ["Abc def gh.", "ABC!! DEF!! GH!!", "XYZ!! ABC!!"] and shown[0][1] > shown[1][1]


def test_quality_without_two_classes(spark):
    docs = spark.createDataFrame(rows_of(["a b", "c"]), SCHEMA)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = linecrf.train(docs, some, F.lit(True))
        assert [r.score for r in linecrf.score_documents(docs, model).collect()] == [0.5, 0.5]
    assert linecrf.score_documents(docs.limit(0), model).count() == 0


def test_sample_of_the_field_is_bounded(spark):
    docs = spark.createDataFrame([(i, "good text." if i % 2 else "### $$$", "", "", 0) for i in range(600)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    model = linecrf.train(docs, labels, F.lit(True), max_rows=40)
    got = linecrf.score_documents(docs, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_texts_are_cut_once(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"first {passage} end"), (2, f"other {passage} tail"), (3, "nothing that repeats"), (4, None), (5, passage)]
    out = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), size_col=None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # a second cuts every text again, for the filter
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "other  tail", 3: rows[2][1], 4: None}
