"""Near copies by ProbMinHash: signatures of weighted shingles, bands, exact verification, classes.

Shingles are five words in a row (all words of shorter texts), weighted 1 + ln(count). A signature
has ``COMPONENTS`` components. Each shingle sends exponential arrivals at the rate of its weight, in
the order of time, each to a random component; a component keeps its earliest arrival, and a
shingle stops as soon as its next arrival comes later than what all components have (early
termination). The chance that two texts share a component is their probability Jaccard similarity.
Repetition can make that less than the Jaccard similarity of the sets, so texts that repeat shingles
have a second signature with all weights 1 and the bands of both; others have the same one twice.
Two texts with a set similarity of 0.8 share a band of it with a chance of 99.995%.

``BANDS`` bands of components are buckets. Texts of a bucket are candidates; pairs are verified by
the exact Jaccard similarity of their shingle sets (``SIMILARITY`` or more), and verified pairs
make classes (connected components). Not all pairs of a bucket are emitted: a class needs no
second link between texts that it holds already.

1. Every text is compared with the leader of its bucket, then classes are formed. In buckets that
   still hold several classes, other leaders are taken, ``ROUNDS`` times in all.
2. What is left open is compared in full: in small buckets by the pairs that no round has met, in
   large ones block by block, a task holding two blocks of bounded size.

So every pair of a bucket is in one class, or has been compared. Identical texts are one node from
the start, by a 128-bit hash, and are never compared.

Defined results: null and empty texts have no shingles and are classes by identity: texts without a
word are near copies only of the same text. The class id is the least id in the class; null ids are
ignored there. Repeated rows give one row each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_slices, lean, mix, release, stored, table_of, unit, words_of

WORDS = 5
COMPONENTS = 125
BANDS = 25
SIMILARITY = 0.8
ROUNDS = 3
SMALL_BUCKET = 32
BLOCK = 256
SLICE = 1_000_000  # bytes of texts at a time


def shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the different shingles of each text, sorted by text and hash."""
    words = words_of(texts)
    h = mix(words.hashes)[words.index] if len(words.index) else np.zeros(0, U64)
    rows, counts = words.rows(), words.counts
    with np.errstate(over="ignore"):
        n = len(h) - size + 1
        parts = []
        if n > 0:
            window = np.zeros(n, U64)
            for k in range(size):
                window = mix(window + h[k : k + n])
            inside = rows[:n] == rows[size - 1 :]
            parts.append((rows[:n][inside], window[inside]))
        short = np.flatnonzero((counts > 0) & (counts < size))
        value = np.zeros(len(short), U64)
        for k in range(size - 1):
            more = counts[short] > k
            value[more] = mix(value[more] + h[words.starts[short[more]] + k])
        parts.append((short, mix(value + U64(1))))
    row = np.concatenate([p[0] for p in parts]).astype(np.int64)
    value = np.concatenate([p[1] for p in parts])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])]) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def signatures(row: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int, components: int = COMPONENTS) -> np.ndarray:
    """ProbMinHash signatures (texts x components) of weighted elements."""
    earliest = np.full(texts * components, np.inf)
    winner = np.zeros(texts * components, U64)
    rate = 1.0 + np.log(count.astype(np.float64))
    time = np.zeros(len(row))
    latest = np.full(texts, np.inf)  # of the components of each text
    open_ = np.arange(len(row))
    step = 0
    while len(open_):
        with np.errstate(over="ignore"):
            draw = mix(value[open_] + U64(2 * step + 1) * U64(0xA0761D6478BD642F))
            time[open_] += -np.log(unit(draw)) / rate[open_]
            slot = row[open_] * components + (mix(draw) % U64(components)).astype(np.int64)
        live = time[open_] < latest[row[open_]]
        open_, slot = open_[live], slot[live]
        np.minimum.at(earliest, slot, time[open_])
        won = earliest[slot] == time[open_]
        winner[slot[won]] = value[open_[won]]
        step += 1
        if len(open_):
            there = np.unique(row[open_])
            latest[there] = earliest.reshape(texts, components)[there].max(axis=1)
    return winner.reshape(texts, components)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of each signature."""
    texts, components = signature.shape
    size = components // bands
    out = np.empty((texts, bands), U64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(texts, b + 1, U64)
            for k in range(size):
                h = mix(h + signature[:, b * size + k])
            out[:, b] = h
    return out


def text_bands(row: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, band hash) of the texts with words, by text: of the weighted signature and of that with all weights 1."""
    some, again = np.unique(row), np.unique(row[count > 1])
    both = [(some, band_hashes(signatures(row, value, count, texts))[some])]
    if len(again):
        own = np.isin(row, again)
        both.append((again, band_hashes(signatures(np.searchsorted(again, row[own]), value[own], np.ones(own.sum(), np.int64), len(again)))))
    text = np.concatenate([np.repeat(t, BANDS) for t, _ in both])
    band = np.concatenate([b.ravel() for _, b in both])
    order = np.lexsort((band, text))
    text, band = text[order], band[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (band[1:] != band[:-1])]) if len(text) else np.zeros(0, bool)
    return text[new], band[new]


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, k1, k2, text): the id and a 128-bit hash of the text; null is the empty text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("near"), text).alias("k2"), text.alias("text"))


def banded(keyed: DataFrame) -> DataFrame:
    """(doc, k1, k2, bands) of every row; texts without a word have no bands."""

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, 3, SLICE):
                row, value, count = shingles(batch.column(3))
                text, band = text_bands(row, value, count, batch.num_rows)
                offsets = np.searchsorted(text, np.arange(batch.num_rows + 1))
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(band.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], column], ["doc", "k1", "k2", "bands"])

    return keyed.mapInArrow(lean(run), "doc long, k1 long, k2 long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) of rows (node, text): sorted 64-bit hashes of the different shingles."""

    def run(batches):
        seen = None
        for whole in batches:
            for batch in byte_slices(whole, 1, SLICE):
                row, value, _ = shingles(batch.column(1))
                starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
                keep, sets = [], []
                for i, node in enumerate(batch.column(0).to_pylist()):
                    if node == seen:  # rows of one node follow each other
                        continue
                    seen = node
                    keep.append(node)
                    sets.append(value[starts[i] : starts[i + 1]].astype("<u8").tobytes())  # sorted by ``shingles``
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(lean(run), "node long, shingles binary")


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    same = int(np.count_nonzero(large[at] == small))
    return same / (len(a) + len(b) - same)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sufficient similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))

    def run(batches):
        for batch in batches:
            keep = [
                _jaccard(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) >= SIMILARITY
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, class) of the nodes of links (a, b): the least node that each can reach.

    Every round takes the least class among neighbours and then the class of that class, so that
    long chains shrink by jumps; rounds are written and only a count comes to the driver.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("class")).withColumnRenamed("a", "node"), "classes")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "class"), "b").groupBy("a").agg(F.min("class").alias("near"))
        step = now.join(near, F.col("node") == F.col("a")).select("node", "class", F.least("class", "near").alias("new"))
        jump = now.select(F.col("node").alias("n"), F.col("class").alias("far"))
        after = stored(
            step.join(jump, F.col("new") == F.col("n"), "left").select("node", F.least("new", F.coalesce("far", "new")).alias("new"), "class"), "classes"
        )
        changed = after.filter("new <> class").limit(1).count()
        release(now)
        now = after.select("node", F.col("new").alias("class"))
        if not changed:
            release(both)
            return now


def _classed(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    return buckets.join(classes, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class"))


def _draw(node: Column, step: int) -> Column:
    return F.xxhash64(node, F.lit(step)) if step else node


def _open(members: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several classes, with the size of the bucket."""
    several = members.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("size"))
    return members.join(several.filter("low <> high").select("bucket", "size"), "bucket")


def star_pairs(members: DataFrame, step: int) -> DataFrame:
    """(a, b), a < b: each member of another class than the leader of its bucket, with the leader."""
    rank = F.struct(_draw(F.col("node"), step).alias("draw"), F.col("node").alias("node"), F.col("class").alias("class"))
    leaders = members.groupBy("bucket").agg(F.min(rank).alias("leader"))
    met = members.join(leaders, "bucket").filter(F.col("class") != F.col("leader.class"))
    return met.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()


def small_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different classes in buckets of at most ``SMALL_BUCKET`` members."""
    few = members.filter(F.col("size") <= SMALL_BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "class"))).alias("m"))
    one = few.select("m", F.explode("m").alias("x"))
    two = one.select("x", F.explode(F.filter("m", lambda y: (y["node"] > F.col("x.node")) & (y["class"] != F.col("x.class")))).alias("y"))
    return two.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links between classes in large buckets, by pairs of blocks of bounded size."""
    many = members.filter(F.col("size") > SMALL_BUCKET)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = many.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = placed.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "class")

    def run(group: pa.Table) -> pa.Table:
        nodes, classes, own = (np.asarray(group.column(c)) for c in ("node", "class", "own"))
        sets_ = [np.frombuffer(s.as_buffer(), "<u8") for s in group.column("shingles")]
        order = np.argsort([len(s) for s in sets_], kind="stable")  # sizes that are too unlike follow each other
        apart = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        joined: dict[int, int] = {}

        def root(c):
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        out = []
        for i, x in enumerate(order.tolist()):
            for y in order[i + 1 :].tolist():
                if len(sets_[x]) < SIMILARITY * len(sets_[y]):
                    break  # and so are all that are larger
                if apart and own[x] == own[y]:
                    continue
                cx, cy = root(int(classes[x])), root(int(classes[y]))
                if cx != cy and _jaccard(sets_[x], sets_[y]) >= SIMILARITY:
                    joined[max(cx, cy)] = min(cx, cy)
                    out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        a, b = zip(*out) if out else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    full = cells.join(sets, "node").select("bucket", "i", "j", "own", "node", "class", "shingles")
    return full.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, k1, k2, node, class) of every row; node: identical texts, class: near copies."""
    keyed = _keyed(df, id_col, text_col)
    rows = stored(banded(keyed), "near-bands")
    spark = df.sparkSession
    # identical texts: the least id stands for all
    nodes = stored(rows.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    each = nodes.filter(F.size("bands") > 0).select("node", F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    buckets = stored(each.join(shared, "bucket"), "near-buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node").select("k1", "k2", F.col("doc").alias("d"), "node")
    texts = keyed.join(wanted, ["k1", "k2"]).filter(F.col("doc").eqNullSafe(F.col("d")))
    sets = stored(shingle_sets(texts).dropDuplicates(["node"]), "near-sets")
    none = spark.createDataFrame([], "node long, class long")
    classes, links, tried = none, [], []

    def regrouped(classes, links):
        if classes is not none:
            release(classes)
        return components(table_of(links))

    for step in range(ROUNDS):
        members = _open(_classed(buckets, classes)).drop("size")
        pairs = star_pairs(members, step)
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = stored(pairs, "near-pairs")
        tried.append(pairs)
        if not pairs.limit(1).count():
            break
        links.append(stored(verify(pairs, sets), "near-links"))
        classes = regrouped(classes, links)
    members = stored(_open(_classed(buckets, classes)), "near-open")
    pairs = small_pairs(members)
    for before in tried:
        pairs = pairs.join(before, ["a", "b"], "left_anti")
    links.append(stored(verify(pairs, sets).union(block_links(members, sets)), "near-links"))
    if links[-1].limit(1).count():
        classes = regrouped(classes, links)
    labelled = nodes.join(classes, "node", "left").select("k1", "k2", "node", F.coalesce("class", "node").alias("class"))
    out = stored(rows.select("doc", "k1", "k2").join(labelled, ["k1", "k2"]), "near-classes")
    for one in (rows, nodes, buckets, sets, members, *tried, *links, *([classes] if classes is not none else [])):
        release(one)
    return out


def class_rows(classed: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, n_texts) of every row: ids are the least id in the class."""
    sizes = classed.groupBy("class").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size"), F.countDistinct("node").alias("n_texts"))
    return classed.select("class", F.col("doc").alias("doc_id")).join(sizes, "class").select("doc_id", "class_id", "class_size", "n_texts")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each class: the least id, then the least text hash."""
    classed = near_classes(df, id_col, text_col)
    pick = F.struct(F.col("doc").isNull().alias("none"), "doc", "k1", "k2")
    best = classed.groupBy("class").agg(F.min(pick).alias("p")).select(F.col("p.doc").alias("_d"), F.col("p.k1").alias("_k1"), F.col("p.k2").alias("_k2"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit("near"), text).alias("_b"))
    kept = rows.join(best, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")) & F.col("_doc").eqNullSafe(F.col("_d")))
    one = kept.dropDuplicates(["_a", "_b"])
    return one.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns))
