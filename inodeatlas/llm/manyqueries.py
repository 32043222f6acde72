"""Ranked lexical search for many queries at once, by common subexpressions.

A score is a sum over the terms of an item, so sums over terms that several items share need to be
made only once for a document. Per block of items, of which there are as many as the items' terms
ask for (``BLOCK_TERMS`` each, one item at least):

1. **Postings.** One pass over the texts keeps, for every document, its length and the counts of
   those terms that any item of the block holds. N, L and the document frequencies are sums over
   this table.
2. **Mining.** Each item lists its terms by falling number of items that hold them. Pairs of near
   terms are counted over all lists, and pairs that most lists share become nodes of their own, in
   rounds, until no pair stands in two lists (``share``). Nodes are shared term sets, of any size,
   that form a graph without cycles: a node has two parts, and stands in several nodes or items.
3. **Evaluation.** Documents are taken in groups. A matrix of accumulators has a row for every term
   and node; term rows are filled from the postings, node rows are added level by level, once for
   each document, and an item is the sum of the few rows left in its list.
4. **Best rows.** A task keeps the best documents of each item. A slice of the documents, drawn by
   hash, is ranked first; its k-th score is a score that k documents reach, so all others start from
   it, and equal scores stay in.

All arithmetic but the weights is on 64-bit integers. Defined results: a null text has no terms and
is not counted; rows with the same id are documents of their own, ordered by id only; null ids
come after others; every row of the items is an item, also with a null or repeated id; items
without a term, or without a scoring document, have no rows; empty tables give none.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, lean, mix, release, stored, words_of

BLOCK_TERMS = 50_000
CELLS = 4_000_000  # of the matrix of accumulators
SLICE = 2_000_000
REACH = 16  # places between the symbols of a pair that is counted
FIRST_SHARE = 16  # one in so many documents is ranked first
LAST_ID = np.iinfo(np.int64).max
# bytes of terms keep their value, A-Z become a-z, all other ASCII becomes a space
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = ord(" ")
for _first, _last, _to in ((48, 57, 48), (97, 122, 97), (65, 90, 97)):
    _FOLD[_first : _last + 1] = np.arange(_to, _to + _last - _first + 1)


def terms_of(texts: pa.Array):
    """The terms of every text, as ``Words``; null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))
    return words_of(folded)


class Graph(NamedTuple):
    """Nodes 0..terms-1 are terms; node ``terms + i`` is left[i] plus right[i]; nodes come by level."""

    terms: int
    left: np.ndarray
    right: np.ndarray
    levels: np.ndarray  # first made node of each level, and one past the last
    lists: np.ndarray  # nodes of all items
    starts: np.ndarray  # first of each item, and one past the last


def share(lists: np.ndarray, starts: np.ndarray, terms: int, reach: int = REACH) -> Graph:
    """The graph of items given by their different terms (``lists``, cut at ``starts``).

    In a round, every list is ordered by the number of lists that hold a symbol. Pairs of symbols at
    most ``reach`` places apart are counted over all lists; a pair becomes a node where it is, of all
    pairs with either of its symbols, the one in most lists, if that holds for two lists at least.
    """
    item, symbol = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), lists.astype(np.int64)
    made, left, right, levels = terms, [], [], [0]
    # a hash of the lists that hold a symbol: symbols of the same lists come together
    with np.errstate(over="ignore"):
        kind = np.zeros(terms, np.uint64)
        np.add.at(kind, symbol, mix(item.astype(np.uint64)))
    while len(symbol):
        held_by = np.bincount(symbol, minlength=made)
        order = np.lexsort((symbol, kind[symbol], -held_by[symbol], item))
        item, symbol = item[order], symbol[order]
        first = np.concatenate([np.flatnonzero(item[d:] == item[:-d]) for d in range(1, min(reach, len(symbol) - 1) + 1)] or [lists[:0]])
        second = np.concatenate([np.flatnonzero(item[d:] == item[:-d]) + d for d in range(1, min(reach, len(symbol) - 1) + 1)] or [lists[:0]])
        pair, code, n = np.unique(symbol[first] << 32 | symbol[second], return_inverse=True, return_counts=True)
        rank = n[code] * (len(pair) + 1) + code + 1
        best = np.zeros(len(symbol), np.int64)
        np.maximum.at(best, first, rank)
        np.maximum.at(best, second, rank)
        chosen = (n[code] > 1) & (rank == best[first]) & (rank == best[second])
        _, again, n = np.unique(code[chosen], return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(chosen)[n[again] > 1]
        if not len(chosen):
            break
        new, at, again = np.unique(code[chosen], return_index=True, return_inverse=True)
        a, b = first[chosen], second[chosen]
        left.append(symbol[a[at]])
        right.append(symbol[b[at]])
        symbol[a] = made + again
        with np.errstate(over="ignore"):
            kind = np.append(kind, np.zeros(len(new), np.uint64))
            np.add.at(kind, symbol[a], mix(item[a].astype(np.uint64)))
        made += len(new)
        levels.append(made - terms)
        keep = np.ones(len(symbol), bool)
        keep[b] = False
        symbol, item = symbol[keep], item[keep]
    none = [np.zeros(0, np.int64)]
    return Graph(terms, np.concatenate(left or none), np.concatenate(right or none), np.array(levels), symbol, np.searchsorted(item, np.arange(len(starts))))


def accumulate(graph: Graph, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """Scores (items x docs) from the values of (term, doc)."""
    table = np.zeros((graph.terms + len(graph.left), docs), np.int64)
    table[term, doc] = value
    for a, b in zip(graph.levels[:-1].tolist(), graph.levels[1:].tolist()):
        np.add(table[graph.left[a:b]], table[graph.right[a:b]], out=table[graph.terms + a : graph.terms + b])
    out = np.zeros((len(graph.starts) - 1, docs), np.int64)
    full = np.flatnonzero(np.diff(graph.starts))
    if len(full):
        out[full] = np.add.reduceat(table[graph.lists], graph.starts[:-1][full], axis=0)
    return out


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_row, item_id, terms) of every item that has a term; ``terms`` are different."""
    source = items.select(F.monotonically_increasing_id().alias("item_row"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, 2, SLICE):
                words = terms_of(batch.column(2))
                names = words.unique.cast(pa.string())
                pair = np.unique(words.rows() * len(names) + words.index)
                row, word = pair // max(len(names), 1), pair % max(len(names), 1)
                starts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), names.take(pa.array(word)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["item_row", "item_id", "terms"])

    return source.mapInArrow(lean(run), "item_row long, item_id long, terms array<string>").filter(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; ``terms`` are places in ``vocabulary``."""
    packed = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        wanted = pa.array(packed.value, pa.large_binary())
        for whole in batches:
            for batch in byte_slices(whole, 1, SLICE):
                words = terms_of(batch.column(1))
                counts = words.counts
                code = np.asarray(pc.fill_null(pc.index_in(words.unique, wanted), -1)).astype(np.int64)
                term = code[words.index] if len(words.index) else np.zeros(0, np.int64)
                known = term >= 0
                pair, tf = np.unique(words.rows()[known] * (len(wanted) + 1) + term[known], return_counts=True)
                row = pair // (len(wanted) + 1)
                full = np.flatnonzero(counts)
                starts = pa.array(np.append(np.searchsorted(row, full), len(row)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (pair % (len(wanted) + 1), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array(counts[full].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return source.mapInArrow(lean(run), "doc_id long, n long, terms array<int>, tfs array<int>")


def corpus_sums(posted: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each of the ``terms`` terms."""

    def run(batches):
        docs, length, df = 0, 0, np.zeros(terms, np.int64)
        for batch in batches:
            docs += batch.num_rows
            length += int(pc.sum(batch.column(0)).as_py() or 0)
            df += np.bincount(np.asarray(batch.column(1).flatten()), minlength=terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-2, -1])), pa.array(np.append(df[seen], [docs, length]))], ["term", "n"])

    sums = posted.select("n", "terms").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(sums.collect())  # a row for each term of the block
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(terms)], np.int64)


def weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    """Weight of each term; fractions are divided in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)


def _best(item, score, doc, k):
    """Places of the first k of each item by falling score, then by id."""
    order = np.lexsort((doc, -score, item))
    sorted_item = item[order]
    begin = np.searchsorted(sorted_item, sorted_item)
    return order[np.arange(len(order)) - begin < k]


def _ranked(posted: DataFrame, plan: dict, kth: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): the best rows of each task with a score of ``kth`` at least."""
    packed = posted.sparkSession.sparkContext.broadcast((plan, kth))

    def run(batches):
        own, low = packed.value
        graph, weight, n_docs, length = own["graph"], own["weight"], own["docs"], own["length"]
        low = np.maximum(low, 1)  # scores of 0 do not count
        held = [np.zeros(0, np.int64)] * 3
        wide = max(1, CELLS // max(graph.terms + len(graph.left) + len(low), 1))
        for batch in batches:
            for i in range(0, batch.num_rows, wide):
                part = batch.slice(i, wide)
                ids = np.asarray(pc.fill_null(part.column(0), LAST_ID))
                lists, m = part.column(2), 50 + (50 * n_docs * np.asarray(part.column(1))) // max(length, 1)
                doc = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                term, tf = np.asarray(lists.flatten()).astype(np.int64), np.asarray(part.column(3).flatten()).astype(np.int64)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                score = accumulate(graph, term, doc, value, part.num_rows)
                item, at = np.nonzero(score >= low[:, None])
                joined = [np.concatenate(x) for x in zip(held, (item, score[item, at], ids[at]))]
                best = _best(*joined, k)
                held = [c[best] for c in joined]
                full = np.flatnonzero(np.bincount(held[0], minlength=len(low)) >= k)
                last = np.searchsorted(held[0], full, side="right") - 1
                low[full] = np.maximum(low[full], held[1][last])
        item, score, doc = held
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == LAST_ID), pa.array(score)], ["item", "doc_id", "score"])

    return posted.select("doc_id", "n", "terms", "tfs").mapInArrow(lean(run), "item long, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def _block(docs: DataFrame, own: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, rank, doc_id, score) of the items of one block."""
    spark = docs.sparkSession
    vocabulary = sorted({t for row in own for t in row["terms"]})
    place = {t: i for i, t in enumerate(vocabulary)}
    lists = [np.array([place[t] for t in row["terms"]], np.int64) for row in own]
    graph = share(np.concatenate(lists), np.cumsum([0, *map(len, lists)]), len(vocabulary))
    posted = stored(postings(docs, vocabulary, id_col, text_col), "term-postings")
    n_docs, length, frequency = corpus_sums(posted, len(vocabulary))
    plan = {"graph": graph, "weight": weights(n_docs, frequency), "docs": n_docs, "length": length}
    kth = np.zeros(len(own), np.int64)
    first = posted.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_SHARE)) == 0)
    for item, score in _top(_ranked(first, plan, kth, k), k).filter(F.col("rank") == k).select("item", "score").collect():  # a row for each item
        kth[item] = score
    best = stored(_top(_ranked(posted, plan, kth, k), k), "best-documents")
    release(posted)
    names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(own)], "item long, item_id long")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents with a score above 0 of each item."""
    spark = docs.sparkSession
    asked = stored(_items(items, item_col, item_text_col), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_terms))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(blocks)))
    for block in range(blocks):
        # block_terms terms in expectation: items come to the driver a block at a time, as the queries
        own = dealt.filter(F.col("block") == block).orderBy("item_row").collect()
        if own:
            out = out.unionByName(_block(docs, own, k, id_col, text_col))
    release(asked)
    return out
