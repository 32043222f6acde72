"""Repeated passages by a sparse suffix array.

A passage is a run of ``length`` words (50) found at two places or more. Of all suffixes only those
at minimiser positions are kept: in every ``length``-word window the position whose next ``REACH``
words have the least hash among the first ``SPAN`` positions. Equal windows have their minimiser
at the same place, so nothing is lost, and only about 2 / (SPAN + 1) of the suffixes stay.

The kept suffixes are sorted by the hash of their next words, then by the hash of everything that
any of their windows can reach to the left and right, over all tasks (a range sort, so that a
suffix found in very many documents is dealt to many tasks). Neighbours are compared:

* same words and same surroundings: every window of the suffix is repeated;
* same words, other surroundings: the match is extended left and right, which is the same as
  comparing the windows of the two suffixes one by one; one suffix of each kind of surroundings is
  enough for that.

What neighbours there are across the borders of tasks is settled from the first and last suffix
of every task.

Rows with the same id and text are one document, by 128 bits of the text; a task drops its repeats
before the sort, so a suffix comes there once for each task that has read it. Defined results: null and empty texts and texts
of fewer than ``length`` words have no passages; a passage repeated within one text counts; equal
ids with other texts are other documents; of equal places the smaller (id, text hash, position)
is the first; null ids come before others; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, lean, mix, partitions, release, stored, words_of

LENGTH = 50
SPAN = 21
NO_ID = np.iinfo(np.int64).min
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SUFFIX = "fp long, ctx long, doc long, mark long, mark2 long, pos int, back int, ahead int"
ROWS_IN_TASK = 2_000_000
# of a suffix, as far as its task can tell: whole (repeated with its surroundings), later (not the
# first such), opens (the first such), mixed (other surroundings exist); ``place`` says which of these
# depend on other tasks. The summary row of a task holds its first and last suffix.
FIRST_KIND, LAST_KIND, FIRST_GROUP, LAST_GROUP, FIRST_ROW = 1, 2, 4, 8, 16
FOUND = (
    "part int, summary boolean, doc long, mark long, mark2 long, pos int, back int, ahead int, whole boolean, opens boolean, mixed boolean, place int, "
    "fp1 long, ctx1 long, fp2 long, ctx2 long, kinds1 int, kinds2 int"
)


def marks_of(text: Column) -> list[Column]:
    """Two hashes that stand for a text: texts of one id, or without, are told apart by 128 bits."""
    return [F.xxhash64(text).alias("mark"), F.xxhash64(F.lit("second"), text).alias("mark2")]


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, mark2, text): the id with null as the least number, and 128 bits of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("doc"), *marks_of(text), text.alias("text"))


def minimisers(h: np.ndarray, starts: np.ndarray, length: int = LENGTH, span: int = SPAN):
    """Of the windows of each text: places of their minimisers, how far windows reach, and hashes.

    Returns (text, place, back, ahead, fp, ctx): windows begin ``back`` .. ``ahead`` words
    before and after the place.
    """
    reach = length - span + 1
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ends = starts[1:][rows]
    rolling = Rolling(h)
    grams = rolling.fixed(reach)
    m = len(grams) - span + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none, none, none, none, none.astype(U64), none.astype(U64), rolling
    least, at = grams[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, span):
        better = grams[j : j + m] < least
        least[better] = grams[j : j + m][better]
        at[better] = j
    begin = np.flatnonzero(np.arange(m) + length <= ends[:m])
    place = at[begin] + begin
    # windows with one minimiser follow each other
    first = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]]) if len(place) else first
    place, low, high = place[first], begin[first], begin[last]
    left = np.maximum(place - (span - 1), starts[:-1][rows[place]])
    right = np.minimum(place + length, ends[place])
    ctx = mix(rolling.of(left, right) + (place - left).astype(U64))
    return rows[place], place, place - low, high - place, grams[place], ctx, rolling


def _chunks(batch, most=400_000):
    """Slices of a batch with a bounded number of characters, one text at least."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(3))).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > 8 * most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _unseen(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows of a batch whose key is not in ``seen``, which gets them."""
    keep = []
    for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
        if key not in seen:
            seen.add(key)
            keep.append(i)
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def suffix_table(keyed: DataFrame, length: int, span: int) -> DataFrame:
    def run(batches):
        seen = set()  # a row that its task has had already adds no place
        for whole in batches:
            for batch in map(lambda b: _unseen(b, seen), _chunks(whole)):
                words = words_of(batch.column(3))
                h = mix(words.hashes)[words.index] if len(words.index) else np.zeros(0, U64)
                text, place, back, ahead, fp, ctx, _ = minimisers(h, words.starts, length, span)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fp.view(np.int64)), pa.array(ctx.view(np.int64)), *(batch.column(i).take(take) for i in range(3)),
                        pa.array((place - words.starts[text]).astype(np.int32)), pa.array(back.astype(np.int32)), pa.array(ahead.astype(np.int32)),
                    ],
                    ["fp", "ctx", "doc", "mark", "mark2", "pos", "back", "ahead"],
                )

    return keyed.mapInArrow(lean(run), SUFFIX)


def compare_neighbours(sorted_suffixes: DataFrame) -> DataFrame:
    """What each suffix shares with its neighbours, within each task of a range-sorted table."""

    def run(batches):
        part = TaskContext.get().partitionId()
        columns = [[] for _ in range(8)]
        for batch in batches:
            for c, column in zip(columns, batch.columns):
                c.append(np.asarray(column))
        if not columns[0] or not sum(map(len, columns[0])):
            return
        fp, ctx, doc, mark, mark2, pos, back, ahead = (np.concatenate(c) for c in columns)
        same = np.concatenate([[False], np.logical_and.reduce([c[1:] == c[:-1] for c in (fp, ctx, doc, mark, mark2, pos)])])
        fp, ctx, doc, mark, mark2, pos, back, ahead = (c[~same] for c in (fp, ctx, doc, mark, mark2, pos, back, ahead))
        n = len(fp)
        new_group = np.concatenate([[True], fp[1:] != fp[:-1]])
        new_kind = new_group | np.concatenate([[True], ctx[1:] != ctx[:-1]])
        group, kind = np.cumsum(new_group) - 1, np.cumsum(new_kind) - 1
        kinds = np.bincount(group[new_kind])
        whole = np.bincount(kind)[kind] > 1
        mixed = kinds[group] > 1
        place = (kind == 0) * FIRST_KIND + (kind == kind[-1]) * LAST_KIND + (group == 0) * FIRST_GROUP + (group == group[-1]) * LAST_GROUP
        place[0] += FIRST_ROW
        keep = np.flatnonzero(whole | mixed | (place > 0))
        for i in range(0, len(keep), 100_000):
            k = keep[i : i + 100_000]
            m = len(k)
            yield _batch(part, False, [doc[k], mark[k], mark2[k], pos[k], back[k], ahead[k], whole[k], new_kind[k], mixed[k], place[k]], [np.zeros(m, np.int64)] * 6)
        ends = [fp[:1], ctx[:1], fp[-1:], ctx[-1:], kinds[:1], kinds[-1:]]
        yield _batch(part, True, [np.array([n])] + [np.zeros(1, np.int64)] * 9, ends)

    return sorted_suffixes.mapInArrow(lean(run), FOUND)


def _batch(part, summary, values, ends):
    n = len(values[0])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32()]
    end_types = [pa.int64()] * 4 + [pa.int32()] * 2
    arrays = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, summary))]
    for value, kind in zip([*values, *ends], [*types, *end_types]):
        value = np.asarray(value)
        arrays.append(pa.array(value.astype(bool)) if kind == pa.bool_() else pa.array(value.astype(np.int64)).cast(kind))
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in FOUND.split(", ")])


def settle_borders(ends: list) -> list[tuple[int, bool, bool, bool, bool]]:
    """From the first and last suffix of each task, in order: (part, first kind goes on from before,
    last kind goes on after, first group has several kinds, last group has several kinds)."""
    groups: dict[int, list] = {}
    for e in ends:
        runs = [(e["fp1"], e["ctx1"], e["ctx2"] if e["fp1"] == e["fp2"] else None, e["kinds1"])]
        if e["fp1"] != e["fp2"]:
            runs.append((e["fp2"], None, e["ctx2"], e["kinds2"]))
        for fp, first, last, kinds in runs:
            held = groups.setdefault(fp, [False, None])
            held[0] |= kinds > 1 or (held[1] is not None and first != held[1])
            held[1] = last
    out = []
    for i, e in enumerate(ends):
        before, after = ends[i - 1] if i else None, ends[i + 1] if i + 1 < len(ends) else None
        from_before = before is not None and (before["fp2"], before["ctx2"]) == (e["fp1"], e["ctx1"])
        goes_on = after is not None and (after["fp1"], after["ctx1"]) == (e["fp2"], e["ctx2"])
        out.append((e["part"], from_before, goes_on, groups[e["fp1"]][0], groups[e["fp2"]][0]))
    return out


def repeated_suffixes(keyed: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """(doc, mark, mark2, pos, back, ahead, whole, later, detail) of the suffixes that any other one meets."""
    spark = keyed.sparkSession
    suffixes = stored(suffix_table(keyed, length, span), "suffixes")
    tasks = max(partitions(spark), -(-suffixes.count() // ROWS_IN_TASK))
    order = ["fp", "ctx", "doc", "mark", "mark2", "pos"]
    ranged = suffixes.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    found = stored(compare_neighbours(ranged), "suffix-neighbours")
    release(suffixes)
    ends = sorted((r.asDict() for r in found.filter("summary").collect()), key=lambda r: r["part"])  # one for each task
    settled = spark.createDataFrame(settle_borders(ends), "border int, before boolean, after boolean, mixed1 boolean, mixed2 boolean")
    at = lambda bit: F.col("place").bitwiseAND(bit) > 0
    joined = found.filter("not summary").join(settled, F.col("part") == F.col("border"))
    first_goes_on = at(FIRST_KIND) & F.col("before")
    opens = F.col("opens") & ~(at(FIRST_ROW) & F.col("before"))
    mixed = F.col("mixed") | (at(FIRST_GROUP) & F.col("mixed1")) | (at(LAST_GROUP) & F.col("mixed2"))
    whole = F.col("whole") | first_goes_on | (at(LAST_KIND) & F.col("after"))
    return joined.select(
        "doc", "mark", "mark2", "pos", "back", "ahead", whole.alias("whole"), (whole & ~opens).alias("later"), (opens & mixed).alias("detail")
    ).filter("whole or detail")


def windows_to_compare(keyed: DataFrame, suffixes: DataFrame, length: int) -> DataFrame:
    """(hash, doc, mark, mark2, begin, whole) of the windows of the suffixes that need to be extended."""
    wanted = suffixes.filter("detail").select(
        F.col("doc").alias("d"), F.col("mark").alias("m"), F.col("mark2").alias("m2"), F.struct("pos", "back", "ahead", "whole").alias("at")
    )
    lists = wanted.groupBy("d", "m", "m2").agg(F.collect_list("at").alias("at"))  # bounded by the length of the text

    def run(batches):
        seen = None
        for batch in batches:
            out = []
            for doc, mark, mark2, text, at in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (doc, mark, mark2) == seen:  # a repeated row
                    continue
                seen = (doc, mark, mark2)
                words = words_of(pa.array([text]))
                rolling = Rolling(mix(words.hashes)[words.index])
                begin = np.concatenate([np.arange(a["pos"] - a["back"], a["pos"] + a["ahead"] + 1) for a in at])
                whole = np.concatenate([np.full(a["back"] + a["ahead"] + 1, a["whole"]) for a in at])
                n = len(begin)
                out.append(
                    pa.RecordBatch.from_arrays(
                        [pa.array(rolling.of(begin, begin + length).view(np.int64)), *(pa.array(np.full(n, k, np.int64)) for k in (doc, mark, mark2)), pa.array(begin.astype(np.int32)), pa.array(whole)],
                        ["hash", "doc", "mark", "mark2", "begin", "whole"],
                    )
                )
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    same = (F.col("doc") == F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("mark2") == F.col("m2"))
    met = keyed.join(lists, same).select("doc", "mark", "mark2", "text", "at")
    return met.mapInArrow(lean(run), "hash long, doc long, mark long, mark2 long, begin int, whole boolean")


def _merge(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of ranges."""
    out: list[list[int]] = []
    for i in np.lexsort((end, begin)):
        if out and begin[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(end[i]))
        else:
            out.append([int(begin[i]), int(end[i])])
    return [tuple(x) for x in out]


def passages(df: DataFrame, length: int = LENGTH, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, mark2, spans, cuts) of every text with repeated passages.

    ``spans`` are the word ranges [begin, end) covered by repeated windows, ``cuts`` those covered
    by windows that an earlier place has as well; both as 32-bit pairs in a binary.
    """
    keyed = _keyed(df, id_col, text_col)
    found = repeated_suffixes(keyed, length, span)
    suffixes = stored(found, "repeated-suffixes")
    release(found)
    windows = stored(windows_to_compare(keyed, suffixes, length), "windows")
    here = F.struct("doc", "mark", "mark2", "begin")
    met = windows.groupBy("hash").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter("first <> last").drop("last")
    extended = windows.join(met, "hash").select(
        "doc", "mark", "mark2", "begin", (F.col("begin") + length).alias("end"), (F.col("first") < here).alias("later")
    )
    whole = suffixes.filter("whole").select(
        "doc", "mark", "mark2", (F.col("pos") - F.col("back")).alias("begin"), (F.col("pos") + F.col("ahead") + length).alias("end"), "later"
    )
    ranges = extended.unionByName(whole).groupBy("doc", "mark", "mark2").agg(F.collect_list(F.struct("begin", "end", "later")).alias("ranges"))

    def run(batches):
        for batch in batches:
            spans, cuts = [], []
            flat = batch.column(3).flatten()
            begin, end, later = (np.asarray(flat.field(i)) for i in range(3))
            offsets = np.asarray(batch.column(3).offsets)
            offsets = offsets - offsets[0]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                late = later[a:b].astype(bool)
                spans.append(np.array(_merge(begin[a:b], end[a:b]), dtype="<i4").tobytes())
                cuts.append(np.array(_merge(begin[a:b][late], end[a:b][late]), dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, pa.binary()), pa.array(cuts, pa.binary())], ["doc", "mark", "mark2", "spans", "cuts"])

    return ranges.mapInArrow(lean(run), "doc long, mark long, mark2 long, spans binary, cuts binary")


def span_rows(found: DataFrame) -> DataFrame:
    """(doc_id, begin_word, end_word, n_words, n_later_words), one row for each repeated passage."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, spans, cuts in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                later = np.frombuffer(cuts, "<i4").reshape(-1, 2)
                for begin, end in np.frombuffer(spans, "<i4").reshape(-1, 2).tolist():
                    inside = np.minimum(later[:, 1], end) - np.maximum(later[:, 0], begin)
                    out.append((None if doc == NO_ID else doc, begin, end, end - begin, int(inside[inside > 0].sum())))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "begin_word", "end_word", "n_words", "n_later_words"]
                )

    return found.mapInArrow(run, "doc_id long, begin_word long, end_word long, n_words long, n_later_words long")


def cut_text(text: str, cuts: np.ndarray) -> str:
    """A text without the words of the given ranges, with the white space at their ends left once."""
    out, at = [], 0
    begins = {int(b): int(e) for b, e in cuts}
    stop = None
    for i, found in enumerate(WORD.finditer(text)):
        if i in begins:
            out.append(text[at : found.start()])
            stop = begins[i]
        if stop is not None and i == stop - 1:
            at, stop = found.end(), None
    if stop is None:
        out.append(text[at:])
    return "".join(out).strip(" \t\n\r\x0b\x0c")


def remove_repeats(df: DataFrame, length: int = LENGTH, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``df`` without passages that an earlier place has; texts left without a word go."""
    found = stored(passages(df, length, span, id_col, text_col), "passages").filter(F.length("cuts") > 0)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("_doc"),
        *(c.alias(f"_m{i}") for i, c in enumerate(marks_of(text))),
    )
    joined = rows.join(found, (F.col("_doc") == F.col("doc")) & (F.col("_m0") == F.col("mark")) & (F.col("_m1") == F.col("mark2")), "left")

    # pandas stays out of the workers, and texts that keep all their words stay out of Python
    @F.arrow_udf("string")
    def cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), cuts.to_pylist())
        return pa.array([None if t is None or c is None else cut_text(t, np.frombuffer(c, "<i4").reshape(-1, 2)) for t, c in pairs], pa.string())

    whole, changed = F.col(f"_row.`{text_col}`").cast("string"), F.col("cuts").isNotNull()
    # as if it were not deterministic: the filter below it would else cut every text a second time
    new = joined.select("_row", changed.alias("_changed"), cut.asNondeterministic()(F.when(changed, whole), "cuts").alias("_cut"))
    new = new.filter(~F.col("_changed") | (F.length("_cut") > 0)).withColumn("_new", F.when(F.col("_changed"), F.col("_cut")).otherwise(whole))
    columns = []
    for c, kind in df.dtypes:
        value = F.col(f"_row.`{c}`")
        if c == text_col:
            value = F.col("_new")
        elif c == size_col:
            value = F.when(F.col("_changed"), F.length("_new").cast(kind)).otherwise(value)
        columns.append(value.alias(c))
    return new.select(*columns)
