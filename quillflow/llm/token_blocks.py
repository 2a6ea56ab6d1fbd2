"""Operator 6: token ids of documents in patched frame-of-reference blocks.

Each text is tokenized whole by a public byte-pair vocabulary and its ids are cut into blocks of BLOCK. A block stores
its least id, packs the rest after subtracting it at the width that holds PERCENTILE of them, and lists those that need
more bits as exceptions (position, value). block_starts gives the byte at which each block starts, so any block is read
without those before it. It all happens within the task that reads the text: no shuffle.

Layout of a block, little-endian: least id (4 bytes), count (2), width (1), number of exceptions (2), the packed ids
((count * width + 7) // 8), exception positions (2 each), exception values less the least id (4 each).

Defined results: a null or empty text has 0 tokens, no block and empty data. Rows with a null doc_id and repeated rows
have their own rows. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import spread
from .textcore import binaries, chunks, lists, longs, map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, PERCENTILE, HEAD = 256, 0.9, 9


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of each value; exact below 2**53."""
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0)


def encode(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all blocks of some rows, bytes in each row, block starts within their rows, and blocks in each row."""
    blocks = -(-counts // BLOCK)
    n = int(blocks.sum())
    row = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(n) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(BLOCK, counts[row] - nth * BLOCK)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(len(counts), np.int64), np.zeros(0, np.int32), blocks
    begin = np.cumsum(size) - size
    least = np.minimum.reduceat(ids, begin)
    delta = np.zeros((n, BLOCK), np.uint32)
    inside = np.arange(BLOCK) < size[:, None]
    delta[inside] = ids - np.repeat(least, size)
    rank = BLOCK - size + np.ceil(PERCENTILE * size).astype(np.int64) - 1  # zeros that fill a block sort first
    width = bit_length(np.sort(delta, axis=1)[np.arange(n), rank])
    over_block, over_at = np.nonzero(delta >> np.minimum(width, 31).astype(np.uint32)[:, None] if width.max() < 32 else bit_length(delta) > width[:, None])
    overs = np.bincount(over_block, minlength=n)
    packed = (size * width + 7) // 8
    length = HEAD + packed + 6 * overs
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)

    def put(at: np.ndarray, values: np.ndarray, kind: str) -> None:
        raw = values.astype(kind).view(np.uint8).reshape(len(values), -1)
        for i in range(raw.shape[1]):
            out[at + i] = raw[:, i]

    put(start, least, "<u4")
    put(start + 4, size, "<u2")
    put(start + 6, width, "<u1")
    put(start + 7, overs, "<u2")
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        low = (delta[which].T & np.uint32((1 << int(w)) - 1)).astype(np.uint64)
        words = np.zeros((BLOCK * int(w) // 64 + 1, len(which)), np.uint64)
        for i in range(BLOCK):
            at, shift = divmod(i * int(w), 64)
            words[at] |= low[i] << np.uint64(shift)
            if shift + w > 64:
                words[at + 1] |= low[i] >> np.uint64(64 - shift)
        raw = np.ascontiguousarray(words.T).view(np.uint8)
        valid = np.arange(raw.shape[1]) < packed[which][:, None]
        target = (start[which] + HEAD)[:, None] + np.arange(raw.shape[1])
        out[target[valid]] = raw[valid]
    if len(over_block):
        nth_over = np.arange(len(over_block)) - np.repeat(np.cumsum(overs) - overs, overs)
        base = (start + HEAD + packed)[over_block]
        put(base + 2 * nth_over, over_at, "<u2")
        put(base + 2 * overs[over_block] + 4 * nth_over, delta[over_block, over_at], "<u4")
    row_bytes = np.bincount(row, length, len(counts)).astype(np.int64)
    return out, row_bytes, (start - (np.cumsum(row_bytes) - row_bytes)[row]).astype(np.int32), blocks


def decode_block(data: bytes, start: int) -> np.ndarray:
    """The ids of the block that starts at a byte."""
    least = int.from_bytes(data[start : start + 4], "little")
    size, width = int.from_bytes(data[start + 4 : start + 6], "little"), data[start + 6]
    overs, at = int.from_bytes(data[start + 7 : start + 9], "little"), start + HEAD
    packed = (size * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, packed, at), bitorder="little")[: size * width]
    delta = (bits.reshape(size, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    at += packed
    where = np.frombuffer(data, "<u2", overs, at)
    delta[where] = np.frombuffer(data, "<u4", overs, at + 2 * overs)
    return delta.astype(np.int64) + least


def decode(data: bytes, block_starts: list[int]) -> list[int]:
    """All ids of a row."""
    return [int(x) for start in block_starts for x in decode_block(data, start)]


def _rows(batch: pa.RecordBatch, vocabulary: str) -> Iterator[pa.RecordBatch]:
    tokens = tokenizer(vocabulary).encode_ordinary
    for chunk in chunks(batch.column(1), lower=False):
        found = [np.array(tokens(text), np.uint32) for text in chunk.texts.to_pylist()]
        counts = np.array([len(x) for x in found], np.int64)
        data, size, starts, blocks = encode(np.concatenate(found), counts)
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.rows.start, chunk.n), longs(counts), lists(starts, blocks), binaries(data, size)], ["doc_id", "n_tokens", "block_starts", "data"])


def token_blocks(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, block_starts, data) of every row."""
    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, partial(_rows, vocabulary=vocabulary), "doc_id long, n_tokens long, block_starts array<int>, data binary")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
