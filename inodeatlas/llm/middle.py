"""Fill-in-middle: a text is cut at two places and its pieces are put in another order.

Spark draws the two places and the form of every row from the hash of its id. A task then handles
a slice of texts as columns: every text becomes a list of units (code points), the lists are
flattened beside the index of their text, a unit's ordinal in its text says which of the three
pieces it belongs to, the units of a piece are filtered out and listed again, and each list is
joined to a string. No text is handled by itself.

Forms: ``plain`` leaves the text as it is; ``psm`` writes ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
``spm`` writes ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. A text that holds one of the three marks stays
plain, so the pieces of the others can be told apart and ``restored`` gives the text back: a mark
cannot come about where a piece meets a mark, since no mark begins with an end of another.

Defined results: null and empty texts are plain with n = 0; a null id draws like an empty one; rows
with the same id and text give equal rows, one for each; an empty table gives none. Texts of any
length are cut whole; a slice holds ``SLICE`` bytes, or one text that is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, lean

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
SLICE = 1_000_000


def draws(id_col: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 for each id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def units(texts: pa.Array) -> pa.ListArray:
    """Every text as the list of its code points; a code point begins at each byte but 10xxxxxx."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    edges = np.append(begins, len(data)).astype(np.int32)
    points = pa.StringArray.from_buffers(len(begins), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, offsets - offsets[0]).astype(np.int32)), points)


def pieces(texts: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix (units before ``low``), middle (before ``high``) and suffix of every text."""
    lists = units(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(lists.offsets.cast(pa.int64()), parent))
    before_low, before_high = (pc.less(ordinal, pc.take(cut, parent)) for cut in (low, high))
    out = []
    for role in (before_low, pc.and_not(before_high, before_low), pc.invert(before_high)):
        own = pc.filter(parent, role)
        ends = np.searchsorted(np.asarray(own), np.arange(len(texts) + 1)).astype(np.int32)
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pc.filter(flat, role)), ""))
    return out


def arranged(texts: pa.Array, form: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """The output of every text in its form."""
    cut = np.flatnonzero(np.asarray(pc.not_equal(form, "plain")))
    own = pa.array(cut)
    prefix, middle, suffix = pieces(texts.take(own), low.take(own), high.take(own))
    p, s, m = (pa.scalar(MARKS[k]) for k in ("prefix", "suffix", "middle"))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    made = pc.if_else(pc.equal(form.take(own), "psm"), psm, spm)
    place = np.full(len(texts), -1, np.int64)
    place[cut] = np.arange(len(cut))
    return pc.coalesce(made.take(pa.array(place, mask=place < 0)), texts.cast(pa.string()))


def fill_in_middle(df: DataFrame, seed: int = 1, cut_percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``df``."""
    h1, h2, h3, h4 = draws(F.col("_id"), seed)
    text = F.col("_text")
    source = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    marked = F.lit(False)
    for mark in MARKS.values():
        marked = marked | F.contains(text, F.lit(mark))
    form = F.when((text == "") | marked | (h3 % 100 >= cut_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    n = F.length("_text").cast("long")
    drawn = source.select("_id", "_text", n.alias("n"), (h1 % (n + 1)).alias("x"), (h2 % (n + 1)).alias("y"), form.alias("form"))
    sent = drawn.select("_id", "_text", "n", "form", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, 1, SLICE):
                ids, texts, n, form, low, high = batch.columns
                plain = pc.equal(form, "plain")
                prefix, middle = (pc.if_else(plain, pa.scalar(None, pa.int64()), c) for c in (low, pc.subtract(high, low)))
                columns = [ids, n, form, prefix, middle, arranged(texts, form, low, high)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return sent.mapInArrow(lean(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "<[PSM]>", -1)  # the piece before the first mark is empty
    first, second, middle = (F.element_at(parts, i) for i in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
