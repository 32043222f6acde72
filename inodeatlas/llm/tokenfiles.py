"""Token ids as flat binary files with 64-bit document offsets.

Documents are dealt by ranges of their id, so file k holds smaller ids than file k + 1. Each
task encodes its range and writes three flat files: ``.bin`` (ids, 16 bits where the vocabulary
allows, else 32), ``.off`` (64-bit offsets of the documents within the file, one more than there
are documents) and ``.doc`` (64-bit document ids). The manifest holds a row for each file; the
base of a file, the number of ids in all files before it, is a prefix sum over the manifest,
which has as many rows as there are files. Readers map the files into memory.

A file is written under the name of its task attempt and the manifest names the attempt that
succeeded, so a repeated or lost task leaves a valid set.

Encoding: pieces between safe boundaries (a blank between characters that are no white space) recur,
so a worker keeps the ids of short pieces it has met, in a table of bounded size; the library
encodes the others. The text of a special token is that token, as in a plain call of the library.

Defined results: a null text is the empty text and holds the end id alone; equal ids are ordered
by the beginning of their text, then as they are read; null ids come first; an empty table gives no
files and no rows.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, folder_of, is_local, lean, local_path, partitions, shared_folder

CACHE_PIECES = 1_500_000
CACHE_CHARS = 40
SLICE = 8_000_000
FILE_BYTES = 256_000_000  # of text, in a file
MANIFEST = "part int, path string, n_docs long, n_tokens long, width int"
NO_ID = np.iinfo(np.int64).min


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: whether a character that begins with it is surely no white space, and whether it ends ASCII one."""
    begins, ends = np.zeros(256, bool), np.zeros(256, bool)
    begins[0x21:0x7F] = ends[0x21:0x7F] = True
    begins[0xC3:0xE1] = begins[0xE4:0xF8] = True  # white space beyond ASCII begins with C2, E1, E2 or E3
    return begins, ends


BEGINS, ENDS = _kinds()


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places of the blanks in UTF-8 bytes that have a character other than white space on both sides."""
    blank = np.flatnonzero(data[1:-1] == 0x20) + 1
    blank = blank[BEGINS[data[blank + 1]]]
    last = data[blank - 1]
    ok = ENDS[last]
    other = np.flatnonzero(last >= 0x80)
    if len(other):  # the character before has two, three or four bytes
        at = blank[other]
        two, three, four = (np.where(at >= k, data[at - k], 0) for k in (2, 3, 4))
        inner = (two & 0xC0) == 0x80
        ok[other] = np.where(~inner, BEGINS[two], np.where((three & 0xC0) != 0x80, BEGINS[three], BEGINS[four]))
    return blank[ok]


class Encoder:
    """The tokenizers library with a bounded table of pieces already encoded.

    A batch of texts is cut at all safe blanks, its different pieces come from a dictionary, those
    not met before go to the library, and the ids of the texts are gathered from the table at once.
    """

    def __init__(self, path: str):
        self.coder = _tokenizer(path)
        self.dtype = np.dtype("<u2") if self.coder.get_vocab_size() <= 65536 else np.dtype("<u4")
        # in a byte-level vocabulary each byte is a letter
        self.letters = np.array([len(self.coder.id_to_token(i) or "") for i in range(self.coder.get_vocab_size())], np.int64)
        self._clear()

    def _clear(self):
        self.place: dict[str, int] = {}  # of a piece in ``at`` and ``size``, which point into ``flat``
        code = "H" if self.dtype.itemsize == 2 else "I"
        self.flat, self.at, self.size = array.array(code), array.array("q"), array.array("q")

    def raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def _put(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add pieces whose ids follow each other in ``ids``."""
        ends = np.cumsum(sizes)
        self.place.update(zip(pieces, range(len(self.at), len(self.at) + len(pieces))))
        self.at.frombytes((len(self.flat) + ends - sizes).astype(np.int64).tobytes())
        self.size.frombytes(sizes.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(self.dtype).tobytes())

    def _learn(self, pieces: list[str], lengths: np.ndarray) -> None:
        """Encode new pieces; ``lengths`` are their bytes.

        Pieces that begin with a blank, with other characters than white space on both sides of it, are encoded as
        one text: no id reaches over their borders, and ids stand for as many bytes as they have letters in
        the vocabulary, so the borders are found again.
        """
        joins = np.fromiter((len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace() for p in pieces), bool, len(pieces))
        for together in (True, False):
            own = np.flatnonzero(joins == together)
            for i in range(0, len(own), 20_000):
                some, size = [pieces[k] for k in own[i : i + 20_000].tolist()], lengths[own[i : i + 20_000]]
                if together:
                    ids = np.array(self.raw(["".join(some)])[0], np.int64)
                    held, ends = np.cumsum(self.letters[ids]), np.cumsum(size)
                    last = np.searchsorted(held, ends)
                    if last[-1] < len(held) and (held[last] == ends).all():
                        self._put(some, ids, np.diff(last + 1, prepend=0))
                        continue
                each = self.raw(some)
                self._put(some, np.array([x for ids in each for x in ids], np.int64), np.array([len(ids) for ids in each], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each; null is empty."""
        if len(self.place) > CACHE_PIECES or len(self.flat) > 16 * CACHE_PIECES:
            self._clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        full = edges[:-1][np.diff(edges) > 0]
        # a blank at the end of a text has the next text behind it, one at the beginning has the last before it: no cuts
        inside = np.ones(len(data) + 1, bool)
        inside[full], inside[edges[1:] - 1] = False, False
        cuts = cut_places(data) if len(data) > 2 else np.zeros(0, np.int64)
        begins = np.sort(np.concatenate([full, cuts[inside[cuts]]]))
        offsets = np.append(begins, len(data))
        pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [i for i, p in enumerate(names) if p not in self.place]
        if new:
            self._learn([names[i] for i in new], np.asarray(pc.binary_length(coded.dictionary)).astype(np.int64)[new])
        slot = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        index = slot[np.asarray(coded.indices)] if len(names) else slot
        size, at = (np.frombuffer(x, np.int64)[index] if len(index) else index for x in (self.size, self.at))
        ends = np.cumsum(size)
        ids = np.frombuffer(self.flat, self.dtype)[np.repeat(at - ends + size, size) + np.arange(ends[-1])] if len(ends) else np.zeros(0, self.dtype)
        total = np.concatenate([[0], ends])
        bounds = np.searchsorted(begins, edges)
        for piece in names:  # long pieces hardly come again
            if len(piece) > CACHE_CHARS:
                del self.place[piece]
        return ids, np.diff(total[bounds])


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker, which keeps its table from task to task."""
    return Encoder(path)


def _with_ends(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    """Ids of texts with the end id behind each."""
    out = np.full(len(ids) + len(sizes), end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below ``folder``; returns the manifest with ``base`` of each file."""
    spark = df.sparkSession

    def run(batches):
        task = TaskContext.get()
        part = task.partitionId()
        encoder = encoder_of(tokenizer_path)
        system, root = folder_of(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{task.taskAttemptId()}"
        n_docs = total = 0
        with (
            system.open_output_stream(f"{root}/{name}.bin") as ids_file,
            system.open_output_stream(f"{root}/{name}.off") as offsets_file,
            system.open_output_stream(f"{root}/{name}.doc") as docs_file,
        ):
            offsets_file.write(np.zeros(1, "<u8").tobytes())
            for whole in batches:
                for batch in byte_slices(whole, 1, SLICE):
                    ids, sizes = encoder.encode(batch.column(1))
                    ids_file.write(_with_ends(ids, sizes, end_id).tobytes())
                    offsets_file.write((total + np.cumsum(sizes + 1)).astype("<u8").tobytes())
                    docs_file.write(np.asarray(batch.column(0).fill_null(int(NO_ID))).astype("<i8").tobytes())
                    total += int(sizes.sum()) + len(sizes)
                    n_docs += len(sizes)
        yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "n_docs": n_docs, "n_tokens": total, "width": encoder.dtype.itemsize}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # rows of one id, or without, are dealt by the beginning of their text, and equal ones as they are read
    order = ["doc_id", F.substring("text", 1, 32), F.monotonically_increasing_id()]
    dealt = source.select("*", *(c.alias(f"_{i}") for i, c in enumerate(order[1:])))
    dealt = dealt.repartitionByRange(max(partitions(spark), -(-held // FILE_BYTES)), "doc_id", "_0", "_1").sortWithinPartitions("doc_id", "_0", "_1")
    files = sorted(tuple(r) for r in dealt.select("doc_id", "text").mapInArrow(lean(run), MANIFEST).collect())
    rows, base = [], 0
    for part, path, n_docs, n_tokens, width in files:
        if n_docs:
            rows.append((part, path, n_docs, n_tokens, width, base))
            base += n_tokens
    manifest = spark.createDataFrame(rows, f"{MANIFEST}, base long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


class Flat:
    """A flat file: mapped where it is local, else read range by range."""

    def __init__(self, path: str, dtype: str):
        self.dtype, self.mapped, self.file = np.dtype(dtype), None, None
        if is_local(path):
            size = os.path.getsize(local_path(path))
            self.mapped = np.memmap(local_path(path), dtype=dtype, mode="r") if size else np.zeros(0, dtype)
            self.length = len(self.mapped)
        else:
            system, inner = folder_of(path)
            self.file = system.open_input_file(inner)
            self.length = self.file.size() // self.dtype.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        begin, end, _ = part.indices(self.length)
        if self.mapped is not None:
            return self.mapped[begin:end]
        step = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - begin) * step, begin * step), self.dtype)


def _documents(path: str, width: int, at_once: int):
    """(ids of documents, first and last token of each, tokens from the first one's on) in runs of ``at_once``."""
    ids, offsets, docs = Flat(f"{path}.bin", f"<u{width}"), Flat(f"{path}.off", "<u8"), Flat(f"{path}.doc", "<i8")
    for i in range(0, docs.length, at_once):
        own = np.array(docs[i : i + at_once])
        edges = np.array(offsets[i : i + len(own) + 1]).astype(np.int64)
        yield own, edges, ids[int(edges[0]) : int(edges[-1])]


def read_token_files(spark: SparkSession, manifest: DataFrame, at_once: int = 2000) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ``ids`` is 32-bit binary."""
    n = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for path, width, base in zip(*(batch.column(c).to_pylist() for c in ("path", "width", "base"))):
                for own, edges, ids in _documents(path, width, at_once):
                    near = (edges - edges[0]).tolist()
                    raw = [ids[x:y].astype("<u4").tobytes() for x, y in itertools.pairwise(near)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(edges[:-1] + base, pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(raw, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return manifest.repartition(n, "part").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    n = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for path, width, base in zip(*(batch.column(c).to_pylist() for c in ("path", "width", "base"))):
                for own, edges, ids in _documents(path, width, 2000):
                    raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                    near = (4 * (edges - edges[0])).tolist()
                    crc = np.fromiter((zlib.crc32(raw[x:y]) for x, y in itertools.pairwise(near)), dtype=np.int64, count=len(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(edges[:-1] + base, pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.repartition(n, "part").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def manifest_json(manifest: DataFrame) -> str:
    return json.dumps([r.asDict() for r in manifest.orderBy("part").collect()])


def output_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "token-files")
