"""The training-data operators on small fixtures: brute force, and odd rows."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from inodeatlas.llm import bpe, buckets, katz, langid, nearcopies, pages, quality, suffixes, tokenfiles, topk
from inodeatlas.llm.common import crc_mod, words_of
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5):
    """Texts with copies, near copies, shared passages, odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = say(60), []
    for i in range(40):
        words = say(rng.randint(1, 140))
        if i % 7 == 0:
            words[3:3] = passage
        texts.append(" ".join(words))
    base = say(120)
    for i in range(8):
        copy = list(base)
        copy[10 * i] = "changed"
        texts.append("\n".join([" ".join(copy[:60]), " ".join(copy[60:])]))
    texts += [texts[3], texts[3], None, "", " \t\n", "one", "one", "x " * 400, "Ünïcode word \x85 tail", " lead  and trail "]
    rows = [(i, t, "ab", "s", 0) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id here", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    # extra columns with names that the operators use themselves
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k1", F.lit(1)).withColumn("mark", F.lit("m")).withColumn("node", F.lit(2)).withColumn("_text", F.lit("t"))
    return df.repartition(3, "n_chars", "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_words_of_slices():
    texts = pa.array(["Aa b", None, " c\x0bD ", "", "e f"])
    got = words_of(texts.slice(2), lower=True)
    assert got.counts.tolist() == [2, 0, 2]
    assert [got.unique[i].as_py() for i in got.index.tolist()] == [b"c", b"d", b"e", b"f"]


def test_byte_bpe(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(docs, RANKS, PATTERN).collect()
    assert len(got) == docs.count()
    texts = {r[0]: r[1] or "" for r in corpus()}
    for r in got:
        ids = np.array(coder.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(empty, RANKS, PATTERN).count() == 0


def test_long_texts_are_cut_at_safe_places():
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "é", "it's", " 12", "<|endoftext|>", " "]) for _ in range(4000))
    assert "".join(bpe.safe_pieces(text, 50)) == text
    assert bpe.encode(text, RANKS, PATTERN, 50).tolist() == bpe.encode(text, RANKS, PATTERN, 10**9).tolist()
    whole = tokenfiles.Encoder(JSON)
    ids, sizes = whole.encode(pa.array([text, "", None]))
    assert ids.tolist() == whole.raw([text])[0] and sizes.tolist() == [len(ids), 0, 0]
    assert bpe.decode(bpe.encode(text, RANKS, PATTERN), RANKS, PATTERN) == text.encode()


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(JSON)
    manifest = tokenfiles.write_token_files(docs, tokenfiles.output_folder(spark), JSON)
    got = {(r.doc_id, r.start): r for r in tokenfiles.read_digests(spark, manifest).collect()}
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for doc_id, text, *_ in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got.pop((doc_id, start))
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got
    ids = tokenfiles.read_token_files(spark, manifest).agg(F.sum("n_tokens"), F.sum(F.length("ids"))).first()
    assert tuple(ids) == (start, 4 * start)
    marked = [(1, "a <|endoftext|> b<|endoftext|>"), (None, "x"), (None, ""), (None, "x"), (2, "é\u00a0 \u3000東 12 <|endoftext|>")]
    few = spark.createDataFrame(marked, "doc_id long, text string")
    got = tokenfiles.read_token_files(spark, tokenfiles.write_token_files(few, tokenfiles.output_folder(spark), JSON)).collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in sorted(got, key=lambda r: r.start)]
    assert ids == [[*coder.encode(t, add_special_tokens=False).ids, 0] for t in ("", "x", "x", marked[0][1], marked[4][1])]
    assert 50256 in ids[3]
    none = tokenfiles.write_token_files(empty, tokenfiles.output_folder(spark), JSON)
    assert tokenfiles.read_digests(spark, none).count() == 0


def test_katz(docs, empty):
    held_out = crc_mod("doc_id", 5) == 1
    scores, model = katz.katz_scores(docs, held_out)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sequences = [(i, [*WORD.findall((t or "").translate(lower)), None]) for i, t, *_ in corpus()]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    for i, s in sequences:
        if not out(i):
            one.update(s)
            two.update(zip(["<s>", *s], s))
            context.update(["<s>", *s[:-1]])
    n, v = sum(one.values()), len(one)
    d1, d2 = (lambda r, d=katz.good_turing(collections.Counter(c.values())): float(d(np.array([r]))[0]) for c in (one, two))
    left = n - sum(d1(r) for r in one.values())
    mass, unknown = (n, left / n) if left > 0 else (n + 1, 1 / (n + 1))
    word = lambda w: d1(one[w]) / mass if w in one else unknown
    given, seen = collections.Counter(), collections.Counter()
    for (c, w), r in two.items():
        given[c] += d2(r)
        seen[c] += word(w)

    def pair(w, c):
        if c not in context:
            return word(w)
        total = context[c] + (context[c] - given[c] < 1e-9 * context[c])
        return d2(two[c, w]) / total if (c, w) in two else (1 - given[c] / total) / (1 - seen[c]) * word(w)

    for c in ("<s>", "one", "x"):
        assert math.isclose(sum(pair(w, c) for w in one) + pair("never seen", c), 1, rel_tol=1e-9)
    want = sorted(
        (-1 if i is None else i, len(s), sum(w in one for w in s), round(sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s), 6), round(sum(math.log10(pair(w, c)) for c, w in zip(["<s>", *s], s)), 6))
        for i, s in sequences
    )
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in scores.collect())
    assert got == want
    assert {r.train_tokens for r in scores.collect()} == {n}
    assert model["pairs"].agg(F.sum("n")).first()[0] == n == model["contexts"].agg(F.sum("n")).first()[0]
    assert katz.katz_scores(empty, held_out)[0].count() == 0
    alone = katz.katz_scores(docs.limit(3), F.lit(True))[0].collect()  # nothing to learn from
    assert {(r.n_known, r.train_tokens, r.score) for r in alone} == {(0, 0, 0.0)}


@pytest.mark.parametrize("order", [3, 4])
def test_katz_recursion(docs, order):
    """Longer contexts are evaluated recursively; probabilities of a context add up to one."""
    scores, model = katz.katz_scores(docs, crc_mod("doc_id", 5) == 1, order=order)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sequences = [(i, [*["<s>"] * (order - 1), *WORD.findall((t or "").translate(lower)), None]) for i, t, *_ in corpus()]
    count = {k: collections.Counter() for k in range(1, order + 1)}
    for i, s in sequences:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            for k in count:
                count[k].update(tuple(s[j - k + 1 : j + 1]) for j in range(order - 1, len(s)))
    found = {k: katz.good_turing(collections.Counter(c.values())) for k, c in count.items()}
    d = lambda k, r: float(found[k](np.array([r]))[0])
    n = sum(count[1].values())
    left = n - sum(d(1, r) for r in count[1].values())
    mass, unknown = (n, left / n) if left > 0 else (n + 1, 1 / (n + 1))
    after = {k: collections.defaultdict(list) for k in count}
    for k, c in count.items():
        for gram, r in c.items():
            after[k][gram[:-1]].append((gram, r))
    back = {}

    def p(gram):
        k = len(gram)
        if k == 1:
            return d(1, count[1][gram]) / mass if gram in count[1] else unknown
        own = after[k].get(gram[:-1])
        if not own:
            return p(gram[1:])
        if gram[:-1] not in back:
            c, given = sum(r for _, r in own), sum(d(k, r) for _, r in own)
            total = c + (c - given < 1e-9 * c)
            back[gram[:-1]] = total, (1 - given / total) / (1 - sum(p(g[1:]) for g, _ in own))
        total, alpha = back[gram[:-1]]
        return d(k, count[k][gram]) / total if gram in count[k] else alpha * p(gram[1:])

    for c in [("<s>",) * (order - 1), ("x",) * (order - 1), ("never",) * (order - 1)]:
        assert math.isclose(sum(p((*c, *w)) for w in count[1]) + p((*c, "never seen")), 1, rel_tol=1e-9)
    want = sorted((-1 if i is None else i, len(s) - order + 1, round(sum(math.log10(p(tuple(s[j - order + 1 : j + 1]))) for j in range(order - 1, len(s))), 6)) for i, s in sequences)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.score, 6)) for r in scores.collect()) == want
    for k in range(1, order + 1):
        assert model["grams"][k].agg(F.count("*"), F.sum("n")).first()[:] == (len(count[k]), n)


def test_katz_of_one_repeated_word(spark):
    """A word pair that is most of the corpus is counted before the shuffle and spread over tasks."""
    rows = [(i, "a " * 200, None, None, 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    scores, _ = katz.katz_scores(docs, F.lit(False))
    got = scores.collect()
    assert sorted(r.doc_id for r in got) == list(range(60)) and {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(201, 201, 201 * 60)}
    pairs = {("<s>", "a"): 60, ("a", "a"): 199 * 60, ("a", None): 60}
    total = lambda c: sum(n for (b, _), n in pairs.items() if b == c) + (1)  # noqa: E731 (nothing is discounted: one token is given away)
    want = sum(math.log10(n / total(c)) * {("a", "a"): 199}.get((c, w), 1) for (c, w), n in pairs.items())
    assert all(math.isclose(r.score, want, rel_tol=1e-9) for r in got)
    plan = scores._jdf.queryExecution().toString()
    assert "salt" in plan and "blob" not in plan
    spread = katz.count_texts(docs.withColumn("held_out", F.lit(False)), 2).groupBy("id").agg(F.count("*").alias("n"), F.sum("times").alias("times"))
    assert {(r.n, r.times) for r in spread.collect()} == {(60, 60), (60, 199 * 60)}


def test_main_text(spark):
    x = "The cat that was in the house and the dog with it are of the same age as you would think, and they have been there for all of their lives. "
    html = [
        (1, "u", f"<html><body><nav><a href=a>Home</a></nav><article><h1>A &amp; B</h1><p>{x}<p>Two<br>lines\n here</article><footer>{x}</footer>"),
        (2, "u", f"<body><div class='menu'>{x}</div><h2>Title</h2><p>{x * 2}</p><p>Short.</p><p>{x * 2}</p><div id=comments><p>{x}</p></div><script>if (a<b) x('</p>')</script></body>"),
        (3, "u", None),
        (4, None, ""),
        (5, "u", f"<main><form>{x}</form><aside>{x}</aside><div class='cookie-notice'>{x}</div><p>1 &lt; 2 &#8212; {x}</p><!-- {x} --></main>"),
        (5, "u", "<p>"),
    ]
    df = spark.createDataFrame(html, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect())
    t = x.strip()
    want = [(1, f"A & B\n{t}\nTwo lines here"), (2, f"Title\n{t} {t}\nShort.\n{t} {t}"), (3, ""), (4, ""), (5, ""), (5, f"1 < 2 — {t}")]
    assert got == [(i, w, len(w)) for i, w in want]
    assert pages.extract(df.limit(0)).count() == 0


def test_both_passes_inside_the_mark():
    x = "The cat that was in the house and the dog with it are of the same age as you would think, and they have been there for all of their lives."
    bars = "<p>By Jane Doe | 3 May 2024</p>", "<div>Share Tweet Email Print</div>", "<p>Sign up for our newsletter. By going on you agree to our terms of use.</p>"
    page = f"<article><h1>Title</h1>{bars[0]}<p>{x} {x}</p><p>A short one.</p>{bars[1]}<p>{x}</p>{bars[2]}<p>So it ends</p><article class='comment'><p>{x} {x}</p></article></article>"
    assert pages.main_text(page) == f"Title\n{x} {x}\nA short one.\n{x}\nSo it ends"
    after = f"<article class='post tag-reviews'><p>{x}</p></article><section><article id='comment-7'><p>{x} {x}</p></article></section>"
    assert pages.main_text(after) == x
    # link lists and unknown languages
    assert pages.main_text(f"<main><p>{x} {x}</p><h2>More</h2><ul><li><a href=a>One thing</a></li><li><a href=b>Another</a></li></ul></main>") == f"{x} {x}"
    assert pages.main_text("<article><h1>Kot</h1><p>Kot stoi.</p></article>") == "Kot\nKot stoi."


def test_broken_markup_takes_linear_time():
    n = 20_000
    broken = [
        "<" + "a" * n, "<a " * n, '<a"' * n, '<a ="' * n, '<a"' * n + ">", '<a =">"' * n, "<a =\">' x" * n, "<a =' =\" " * n + ">", "<a<" * n + ">",
        "<head>" * n, "<div>" * n + "<x>" * n + "</y>" * n, "<span class=nav>" * n + "<p>" * n, "<!--" * n, "<![CDATA[" * n, "<script>" * n, "<svg/>" * n,
        "<a class " + " " * n + "class" * n + ">", "<a " + 'class="' * n + ">", "<ul>" * n + "<li>" * n, "&#" * n, "<p>by " + "a" * 60 + "!</p>" * n,
    ]
    start = time.monotonic()
    for page in broken:
        pages.main_text(page)
        pages.main_text(page[: len(page) // 2])
    assert time.monotonic() - start < 30
    # a tag ends outside quoted values; quotes elsewhere, and those never closed, are letters
    x = "The cat that was in the house and the dog with it are of the same age as you would think, and they have been there for all of their lives."
    for tag in ('<p title="a > b">', "<p title='a > b' >", "<p it's>", '<p title="open>', '<p a"b="c">', "<p a = 'x>y'b>"):
        assert pages.main_text(f"<article>{tag}{x} {x}</p></article>") == f"{x} {x}", tag
    assert pages.main_text(f"<article><p>{x} 1 < 2 <3 {x}</p></article>") == f"{x} 1 < 2 <3 {x}"


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(c) for c in rng.normal(0, 0.2, 8)]) for i in range(300)]
    vectors[40:60] = [(i, vectors[7][1]) for i in range(40, 60)]  # ties
    vectors += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (420, [0.5]), (440, []), (20, vectors[20][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).repartition(3)
    got = topk.top_k(topk.scaled(df), F.col("vec_id") % 20 == 0, 20).collect()
    usable = [(i, [math.floor(64 * c) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for a, (i, q) in enumerate(usable):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(usable) if b != a)[:20]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(topk.scaled(df.limit(0)), F.lit(True)).count() == 0


def test_top_k_of_rows_without_id(spark):
    vectors = [(None, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [0.5, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.top_k(topk.scaled(df), F.col("vec_id") % 20 == 0, 4).collect()
    # the query's own row is left out; rows without an id stay without one, behind the ids of their score
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2, 8192), (0, 2, None, 8192), (0, 3, None, 8192), (0, 4, 1, 6144)]


def repeated(rows, length=50):
    places = collections.defaultdict(list)
    for doc, text in sorted({(r[0] if r[0] is not None else -1, r[1] or "") for r in rows}):
        w = words(text)
        for s in range(len(w) - length + 1):
            places[tuple(w[s : s + length])].append((doc, s))
    covered, later = collections.defaultdict(set), collections.defaultdict(set)
    for found in places.values():
        for k, (doc, s) in enumerate(sorted(found) if len(found) > 1 else ()):
            covered[doc] |= set(range(s, s + length))
            if k:
                later[doc] |= set(range(s, s + length))
    return covered, later


def test_passages(docs, empty):
    covered, later = repeated(corpus())
    got, n_later = collections.defaultdict(set), collections.Counter()
    for r in suffixes.span_rows(suffixes.passages(docs)).collect():
        got[r.doc_id] |= set(range(r.begin_word, r.end_word))
        n_later[r.doc_id] += r.n_later_words
    assert got == covered
    assert {k: v for k, v in n_later.items() if v} == {k: len(v) for k, v in later.items()}
    kept = suffixes.remove_repeats(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        text = next(t for i, t, *_ in corpus() if i == r.doc_id)
        assert words(r.text) == [w for k, w in enumerate(words(text)) if k not in later.get(r.doc_id, ())]
    gone = {r[0] for r in corpus()} - {r.doc_id for r in kept.collect()}
    assert gone == {i for i, t, *_ in corpus() if words(t) and len(later.get(i, ())) == len(words(t))}
    assert suffixes.passages(empty).count() == 0


def test_texts_without_id_are_told_apart(spark):
    """Texts that agree in 32 bits of hash, without ids: only what is repeated goes."""
    said = F.concat_ws(" ", *(F.substring(F.sha2(F.concat("id", F.lit(f"/{k}")), 256), 1, 7) for k in range(60)))
    texts = spark.range(200_000).select(F.col("id").cast("string").alias("id")).select("id", F.hash(said).alias("h"))
    pair = texts.groupBy("h").agg(F.collect_list("id").alias("ids"), F.count("*").alias("n")).filter("n > 1").orderBy("h").first().ids[:2]
    a, b = (" ".join(hashlib.sha256(f"{i}/{k}".encode()).hexdigest()[:7] for k in range(60)) for i in pair)
    rows = [(None, a, None, None, 0), (None, b, None, None, 0), (None, "before " + a + " behind", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert df.select(F.hash("text")).distinct().count() == 2
    kept = sorted(r.text for r in suffixes.remove_repeats(df).collect())
    assert b in kept and sum(len(words(t)) for t in kept) == 60 + 60 + 2


def test_repeated_rows_come_to_the_sort_once_for_each_task(spark):
    rows = spark.createDataFrame([(None, " ".join(map(str, range(80))), None, None, 0)] * 90, SCHEMA).repartition(3)
    keyed = suffixes._keyed(rows, "doc_id", "text")
    each = suffixes.suffix_table(keyed, 50, 21).groupBy("fp", "pos").count().collect()
    assert each and all(r["count"] <= 3 for r in each)
    assert suffixes.span_rows(suffixes.passages(rows)).count() == 0


def test_borders_of_tasks():
    rows = [(1, 1), (1, 1), (1, 2), (1, 2), (1, 2), (2, 1), (3, 1), (3, 1), (4, 1), (4, 2)]
    for cuts in ((3,), (1, 4), (2, 3, 5), (1, 2, 3, 4, 5, 6, 7, 8, 9), (7,), (9,)):
        ends = []
        for part, (a, b) in enumerate(zip((0, *cuts), (*cuts, len(rows)))):
            own = rows[a:b]
            first, last = own[0], own[-1]
            kinds = lambda fp, own=own: len({r for r in own if r[0] == fp})
            ends.append({"part": part, "fp1": first[0], "ctx1": first[1], "fp2": last[0], "ctx2": last[1], "kinds1": kinds(first[0]), "kinds2": kinds(last[0])})
        for (part, before, after, mixed1, mixed2), e, a, b in zip(suffixes.settle_borders(ends), ends, (0, *cuts), (*cuts, len(rows))):
            assert before == (a > 0 and rows[a - 1] == rows[a])
            assert after == (b < len(rows) and rows[b] == rows[b - 1])
            assert mixed1 == (len({r for r in rows if r[0] == e["fp1"]}) > 1)
            assert mixed2 == (len({r for r in rows if r[0] == e["fp2"]}) > 1)


def test_length_buckets(docs, empty):
    rng = random.Random(2)
    lengths = sorted(rng.sample(range(1, 60), 9))
    counts = [rng.randint(1, 9) for _ in lengths]

    def least(i, k):
        if i == len(lengths):
            return 0
        if not k:
            return math.inf
        return min(sum((lengths[j] - lengths[t]) * counts[t] for t in range(i, j + 1)) + least(j + 1, k - 1) for j in range(i, len(lengths)))

    for k in (1, 2, 3, 9):
        bounds = buckets.best_boundaries(lengths, counts, k)
        padding = sum((min(b for b in bounds if b >= n) - n) * c for n, c in zip(lengths, counts))
        assert len(bounds) <= k and padding == least(0, k)
    rows = buckets.pack(docs, buckets=4, budget=300).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(words(t)) + 1 for _, t, *_ in corpus())
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.bucket_tokens >= r.n_tokens
        batches[r.batch].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for own in batches.values():
        assert len({r.bucket for r in own}) == 1 and sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].bucket_tokens <= 300
    assert buckets.pack(empty).count() == 0


def test_bounds_of_long_texts_are_lengths(spark):
    rng = random.Random(4)
    lengths = [rng.randint(1030, 9000) for _ in range(90)]
    df = spark.createDataFrame([(i, "", None, None, n) for i, n in enumerate(lengths)], SCHEMA)
    rows = buckets.pack(df, F.col("n_chars"), buckets=5, budget=20_000).collect()
    most = collections.defaultdict(int)
    for r in rows:
        most[r.bucket] = max(most[r.bucket], r.n_tokens)
    assert len(most) == 5 and all(r.bucket_tokens == most[r.bucket] for r in rows)
    some = sorted(set(lengths))
    least = {(0, 0): 0}
    for k in range(1, 6):  # brute force over all cuts
        for j in range(k, len(some) + 1):
            cost = lambda i: sum(some[j - 1] - n for n in lengths if some[i] <= n <= some[j - 1])  # noqa: E731, B023
            least[k, j] = min(least[k - 1, i] + cost(i) for i in range(k - 1, j) if (k - 1, i) in least)
    assert sum(r.bucket_tokens - r.n_tokens for r in rows) == least[5, len(some)]


def jaccard_classes(rows):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if (rows[a][1] or "") == (rows[b][1] or "") or (union and len(sets[a] & sets[b]) / union >= 0.8):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return [least[g] for g in group]


def test_near_copies(docs, empty):
    rows = corpus()
    want = collections.Counter((r[0], c) for r, c in zip(rows, jaccard_classes(rows)))
    got = nearcopies.class_rows(nearcopies.near_classes(docs)).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == want
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in jaccard_classes(rows) if c is not None})
    assert nearcopies.class_rows(nearcopies.near_classes(empty)).count() == 0


def test_open_buckets_are_compared_in_full(spark, monkeypatch):
    """A chain of texts, each near the next one only, in one bucket: small and block forms."""
    sets = [np.arange(10 * i, 10 * i + 100, dtype="<u8").tobytes() for i in range(60)]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "node long, shingles binary")
    members = spark.createDataFrame([(1, i, i, 60) for i in range(60)], "bucket long, node long, class long, size long")
    monkeypatch.setattr(nearcopies, "BLOCK", 7)
    links = {tuple(r) for r in nearcopies.block_links(members, table).collect()}
    classes = {r["class"] for r in nearcopies.components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert classes == {0}
    few = members.filter("node < 30").withColumn("size", F.lit(30).cast("long"))
    pairs = nearcopies.small_pairs(few)
    assert pairs.count() == 30 * 29 // 2
    assert {tuple(r) for r in nearcopies.verify(pairs, table).collect()} == {(i, i + 1) for i in range(29)}


def test_repetition_does_not_hide_near_copies(spark):
    """The same shingles, half of them a hundred times in one text: every pair shares a band."""
    rng = random.Random(3)
    row, value, count = [], [], []
    for pair in range(200):
        shingle = sorted(rng.getrandbits(64) for _ in range(100))
        for text in (0, 1):
            row += [2 * pair + text] * 100
            value += shingle
            count += [100 if text and k % 2 else 1 for k in range(100)]
    text, band = nearcopies.text_bands(np.array(row), np.array(value, np.uint64), np.array(count), 400)
    bands = collections.defaultdict(set)
    for t, b in zip(text.tolist(), band.tolist()):
        bands[t].add(b)
    assert all(bands[2 * p] & bands[2 * p + 1] for p in range(200))
    weighted = nearcopies.band_hashes(nearcopies.signatures(np.array(row), np.array(value, np.uint64), np.array(count), 400))
    assert any(not set(weighted[2 * p].tolist()) & set(weighted[2 * p + 1].tolist()) for p in range(200))  # lost without the second one


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    value = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = np.arange(0, 200), np.arange(50, 250)
    row = np.concatenate([np.zeros(200, np.int64), np.ones(200, np.int64)])
    got = nearcopies.signatures(row, value[np.concatenate([a, b])], np.ones(400, np.int64), 2, 2000)
    assert abs((got[0] == got[1]).mean() - 150 / 250) < 0.05


def test_quality(spark, docs, empty):
    model = quality.fit([])
    got = quality.score_documents(docs, model).collect()
    want = []
    for i, t, *_ in corpus():
        w, found = words(t), collections.defaultdict(list)
        for k in range(len(w) - 2):
            found[tuple(w[k : k + 3])].append(k)
        cover = {k + j for v in found.values() if len(v) > 1 for k in v for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got], key=key) == sorted(want, key=key)
    rng = random.Random(4)
    rows = [(i, " ".join((rng.choice("abc") * 3 if i % 2 else rng.choice(["x$$", "y##"])) for _ in range(80)), "l", "s", 0) for i in range(80)]
    texts = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    learnt = quality.train(texts, labels)
    score = {r.doc_id: r.quality_score for r in quality.score_documents(texts, learnt).collect()}
    assert all((score[i] > 0.5) == bool(i % 2) for i in range(80))
    assert quality.score_documents(empty, learnt).count() == 0
    assert quality.train(texts, labels.limit(0))["bias"] == 0.0


def test_bounds_and_chunks_of_the_fit(monkeypatch):
    assert quality.MAX_ROWS == 1500 and langid.MAX_CHARS == 1_500_000
    rng = np.random.default_rng(3)
    rows = [(i % 2, rng.choice(900, 30, replace=False).astype("<i4") + 300 * (i % 2), rng.random(30, np.float32)) for i in range(80)]
    whole = quality.fit(rows)
    monkeypatch.setattr(quality, "CHUNK", 70)
    parts = quality.fit(rows)
    assert np.allclose(whole["weights"], parts["weights"], atol=1e-5) and np.allclose([whole["bias"], whole["a"], whole["b"]], [parts["bias"], parts["a"], parts["b"]], rtol=1e-4)


def test_language(spark, docs, empty):
    rng = random.Random(6)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40))
    rows = [(i, say("abcde" if i % 2 else "vwxyzé"), "one" if i % 2 else "two", "s", 0) for i in range(60)]
    texts = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(texts, F.col("doc_id") < 40)
    got = {r.doc_id: r for r in langid.identify(texts, model).collect()}
    assert all(got[i].lang_pred == ("one" if i % 2 else "two") and got[i].accepted for i in range(60))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 $$"), (4, "жщцы юэъ " * 60), (4, "жщцы юэъ " * 60)], "doc_id long, text string")
    odd = [(r.doc_id, r.lang_pred == "und", r.accepted) for r in langid.identify(odd, model).collect()]
    assert sorted(odd) == [(1, True, False), (2, True, False), (3, True, False), (4, False, False), (4, False, False)]
    assert langid.identify(empty, model).count() == 0
    nothing = langid.train(empty, F.lit(True))
    assert {r.lang_pred for r in langid.identify(texts, nothing).collect()} == {"und"}


@pytest.mark.parametrize("share", [0.01, 0.03])
def test_labelled_noise_does_not_set_the_limit(spark, share):
    """Random letters labelled as a language, in the rows to learn from and to calibrate on, are rejected."""
    rng = random.Random(8)
    spoken = {"one": ["the", "ing", "an", "er", "tion", "ha"], "two": ["sch", "ein", "ung", "ver", "de", "ich"]}
    word = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(1000):
        lang, bad = ("one", "two")[i % 2], i < 1000 * share
        rows.append((i, " ".join(noise() if bad else word(spoken[lang]) for _ in range(rng.choice([50, 150, 500]))), lang, "s", 0))
    texts = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.accepted for r in langid.identify(texts, langid.train(texts, F.lit(True))).collect()}
    assert [i for i in range(1000) if got[i] != (i >= 1000 * share)] == []


def test_kneser_ney_adds_up():
    model = langid.build({"a": {"abc": 3, "abd": 1, "ba": 2}, "b": {"ccc": 4, "ab": 1}}, 3)
    for context in ("", "a", "ab", "zz"):
        words_ = [context + c for c in "abcd"]
        ends = langid.log_probs([context], model)
        prefix = {w: langid.gram_hashes([w], 3) for w in words_}
        assert len(prefix) == 4 and np.all(ends < 0)
    probs = [np.exp(p) for p in model["probs"]]
    for n in range(3):  # seen grams of a context, with the discounted mass, stay below one
        assert np.all(probs[n] > 0) and np.all(probs[n] < 1)
