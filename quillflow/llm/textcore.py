"""Vectorised text primitives shared by the training-data operators.

Everything here works on Arrow string arrays a chunk at a time: bytes are classified and hashed with numpy, so no
Python code runs per word. A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text; all other ASCII characters separate words. Null text counts as empty text and has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once, so that a worker's temporary arrays stay small. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes hashed at once within a chunk.
SEGMENT_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_STEPS = np.random.default_rng(7).integers(1, 1 << 64, 64, dtype=np.uint64, endpoint=False) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the published splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as floats in (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    return of(_BASE), of(_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of them at least."""
    size = 1 << max(16, (n - 1).bit_length())
    return _powers(size)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of data[start:end] for each span; starts must ascend."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + SEGMENT_BYTES)))
        low, high = int(starts[at]), int(ends[at:stop].max())
        power, inverse = powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _STEPS[63])
        at = stop
    return out


def _lower(texts: pa.Array) -> pa.Array:
    """Lower case; bytes that aren't UTF-8 become replacement characters."""
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        raw = texts.cast(pa.large_binary()).to_pylist()
        return pc.utf8_lower(pa.array([x.decode("utf-8", "replace") for x in raw], pa.large_string()))


class Chunk:
    """Lower-cased bytes of some rows of a text column. rows: their slice of the batch."""

    def __init__(self, texts: pa.Array, rows: slice, lower: bool = True):
        self.rows, self.n = rows, len(texts)
        if pa.types.is_string(texts.type):
            texts = texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        if lower:
            texts = _lower(texts)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.n + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.texts = texts

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the maximal runs of marked bytes; a run ends with its text."""
        if not len(inside):
            return (np.zeros(0, np.int64),) * 3
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s, e, np.searchsorted(self.offsets, s, "right") - 1

    def words(self) -> Words:
        s, e, row = self.spans(_WORD_BYTE[self.data])
        return Words(span_hashes(self.data, s, e), row, s, e, self.n)


class Words:
    """Hashes of the words of a chunk in order, with row and byte span of each."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, n: int):
        self.hashes, self.row, self.start, self.end, self.n = hashes, row, start, end, n
        self.counts = np.bincount(row, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and index of the first word of every run of k words; a text of fewer words, but one at least, has one."""
        h, n = self.hashes, len(self.hashes)
        if not n:
            return h, np.zeros(0, np.int64)
        left = self.first[self.row + 1] - np.arange(n)
        out = h * _STEPS[0]
        for j in range(1, k):
            here = left > j
            out[: n - j] += np.where(here[: n - j], h[j:] * _STEPS[j], _U(0)) if n > j else _U(0)
        keep = (left >= k) | ((self.counts[self.row] < k) & (left == self.counts[self.row]))
        at = np.flatnonzero(keep)
        return mix(out[at]), at

    def text_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each row's word sequence; 0 and 0 for a row without words."""
        out = []
        for seed in (11, 13):
            place = (np.arange(len(self.row)) - self.first[self.row]).astype(np.uint64)
            terms = mix(self.hashes + mix(place * _STEPS[seed] + _U(seed)))
            sums = np.concatenate([[_U(0)], np.cumsum(terms, dtype=np.uint64)])
            total = sums[self.first[1:]] - sums[self.first[:-1]]
            out.append(np.where(self.counts > 0, mix(total + self.counts.astype(np.uint64)), _U(0)))
        return out[0], out[1]


def chunks(texts: pa.Array, lower: bool = True, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a text column in order, in chunks of about limit bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    sizes = np.cumsum(np.nan_to_num(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield Chunk(texts.slice(at, stop - at), slice(at, stop), lower)
        at = stop


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of a sorted array."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Gives freed memory back to the system, where the C library has a call for it."""
    _trim()(0)


#: Text and other columns of a batch that goes to a worker, in bytes; the JVM holds a copy outside its heap meanwhile.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_partitions(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with f over the batches of each partition, which are bounded in bytes unless the session has a bound
    of its own. The bound stays set: the plan that is made here runs when its caller wants the rows."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(f, schema)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """map_partitions with f over each batch that has rows; what a worker needed for one is given back, so that it
    holds little between stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
            del batch
            release()

    return map_partitions(df, run, schema)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of a list column, given all their values in order and the length of each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of a binary column, given all their bytes in order and the length of each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, np.uint8))])
