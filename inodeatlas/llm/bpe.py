"""Byte-level BPE by the tiktoken library: encoding, and decoding from raw bytes.

The rank file is a parameter and is read where the work runs. Long texts are cut at safe
boundaries, so that no call holds more than a piece of a text: a cut before a blank with a
character other than white space on both sides never lies inside a match of the usual
splitting patterns, and no merge reaches over two matches.

Defined results: a null text is the empty text (no ids, the digest of nothing); repeated
rows give one row each; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 100_000
SAFE = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    """The library's encoder for a local rank file (base64 token and rank on each line)."""
    import tiktoken

    ranks = {}
    with open(rank_path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS):
    """``text`` in pieces of about ``size`` characters, each begun at a safe boundary."""
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(text: str | None, rank_path: str, pattern: str, size: int = PIECE_CHARS) -> np.ndarray:
    """Ids of a text, without special tokens."""
    coder = encoding(rank_path, pattern)
    parts = [np.array(coder.encode_ordinary(p), dtype="<u4") for p in safe_pieces(text or "", size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, rank_path: str, pattern: str) -> bytes:
    """Raw bytes of ids; they need not be whole characters."""
    return encoding(rank_path, pattern).decode_bytes(ids.tolist())


def encode_documents(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids as little-endian 32-bit binary, n_tokens) of every row."""

    def run(batches):
        for batch in batches:
            ids = [encode(t, rank_path, pattern) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64())],
                ["doc_id", "ids", "n_tokens"],
            )

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(id, bytes) of rows made by ``encode_documents``."""

    def run(batches):
        for batch in batches:
            texts = [decode(np.frombuffer(b, "<u4"), rank_path, pattern) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded bytes as digests, piece by piece: (doc_id, n_tokens, ids_sha256, decoded_sha256, same)."""

    def one(text):
        coder = encoding(rank_path, pattern)
        ids_sum, bytes_sum, text_sum, n = hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), 0
        for piece in safe_pieces(text or ""):
            ids = coder.encode_ordinary(piece)
            ids_sum.update(np.array(ids, dtype="<u4").tobytes())
            bytes_sum.update(coder.decode_bytes(ids))
            text_sum.update(piece.encode())
            n += len(ids)
        return n, ids_sum.hexdigest(), bytes_sum.hexdigest(), bytes_sum.digest() == text_sum.digest()

    def run(batches):
        for batch in batches:
            rows = [one(t) for t in batch.column(1).to_pylist()]
            n, ids, raw, same = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"],
            )

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
