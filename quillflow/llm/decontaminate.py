"""Operator 9: documents that contain benchmark items, by SimHash over item-sized windows.

Items and documents are words; shingles are words and pairs of neighbours, a word weighing its bytes, a pair half of its
words' bytes. Around every position a window of as many words as an item is considered, for every length that items
have. A window and an item match where the weighted Jaccard similarity of their shingle multisets reaches THRESHOLD.

Search: a window can only match if THRESHOLD of its own weight lies in shingles that items have (Jaccard s implies a
shared weight of s times either side), which running sums tell for all windows at once, and a look at the shingles of
just the items of that length tells again; the others can't match and need no fingerprint. The remaining windows get
SimHash fingerprints of BITS bits. These are looked up in a table for each block of 16 bits, under all values that
differ from the block's in RADIUS // blocks bits at most: by the pigeonhole principle, two fingerprints within RADIUS
bits are as near as that in one block at least, so every item within the radius is found, while of unlike items one in
six is looked at. Candidates are then verified by their exact similarity.

The benchmark is broadcast in slices of about SLICE_BYTES of text, one pass over the documents each. Documents are never
shuffled.

Defined results: items and texts that are null or have no word match nothing; repeated items each give their rows, and
so do repeated documents. A document with fewer words than an item, however few, is one window. Of a document's
windows for one item the most similar is given, the first of equals. Other columns aren't read. Empty tables give none.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import spread, unused, written
from .textcore import Words, chunks, mix, map_batches

#: A repeated shingle votes as a feature of its own for each copy, by the root of its weight; so Jaccard similarity s means
#: a cosine of 2s / (1 + s) at least, and fingerprints of a pair at the threshold differ in 49 bits on average at most
#: (deviation 6.3): the radius takes in 98 of 100 such pairs, and more of all nearer ones.
THRESHOLD, RADIUS, BITS, BLOCK = 0.7, 63, 256, 16
LANES, BLOCKS = BITS // 64, BITS // BLOCK
SLICE_BYTES = 8 << 20
_U = np.uint64
_COPY = _U(0x2545F4914F6CDD1D)
_LANES = mix(np.arange(1, LANES + 1, dtype=np.uint64))


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """At each word: hash and weight of the word, and of its pair with the next one (weight 0 at a text's end)."""
    size = (words.end - words.start).astype(np.float64)
    single = mix(words.hashes ^ _U(0x5851F42D4C957F2D))
    pair, weight = np.zeros_like(single), np.zeros(len(single))
    if len(single) > 1:
        same = words.row[1:] == words.row[:-1]
        pair[:-1] = np.where(same, mix(words.hashes[:-1] * _U(0x9E3779B97F4A7C15) + words.hashes[1:]), _U(0))
        weight[:-1] = np.where(same, (size[:-1] + size[1:]) / 2, 0.0)
    return single, size, pair, weight


def simhash(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fingerprints (m x LANES) of rows of (m x f) features: bit by bit, the sign of the weighted vote."""
    out = np.zeros((len(keys), LANES), _U)
    step = max(1, (1 << 16) // max(1, keys.shape[1]))
    for low in range(0, len(keys), step):
        k, w = keys[low : low + step], weights[low : low + step]
        half = w.sum(axis=1)[:, None] / 2
        for lane, seed in enumerate(_LANES):
            bits = np.unpackbits(mix(k ^ seed).view(np.uint8).reshape(*k.shape, 8), axis=2, bitorder="little")
            votes = np.einsum("mf,mfb->mb", w, bits, dtype=np.float64) > half
            out[low : low + step, lane] = np.packbits(votes, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


@lru_cache(maxsize=2)
def ball(radius: int) -> np.ndarray:
    """All values of a block with so many bits set at most."""
    values = np.arange(1 << BLOCK)
    return values[np.bitwise_count(values) <= radius]


def blocks(prints: np.ndarray) -> np.ndarray:
    """m x BLOCKS values."""
    return np.ascontiguousarray(prints).view("<u2").reshape(len(prints), BLOCKS).astype(np.int64)


class HammingIndex:
    """Fingerprints in a table for each block of bits; finds all within the radius. seen counts what it looked at."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.seen, self.tables = prints, radius, 0, []
        for block in blocks(prints).T:
            order = np.argsort(block, kind="stable")
            self.tables.append((order, *np.unique(block[order], return_index=True)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) positions of all pairs within the radius, each once."""
        found = [np.zeros(0, np.int64)]
        reach, n = self.radius // BLOCKS, len(self.prints)
        step = max(1, (1 << 20) // max(1, min(n, len(ball(reach)))))
        for low in range(0, len(prints), step):
            q = prints[low : low + step]
            own = blocks(q)
            for b, (order, values, begin) in enumerate(self.tables):
                if len(values) < len(ball(reach)):  # fewer values in the table than in the ball
                    query, place = np.nonzero(np.bitwise_count(own[:, b, None] ^ values) <= reach)
                else:
                    wanted = own[:, b, None] ^ ball(reach)
                    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                    query, nth = np.nonzero(values[at] == wanted)
                    place = at[query, nth]
                size = np.append(begin[1:], n)[place] - begin[place]
                item = order[np.repeat(begin[place] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                query = np.repeat(query, size)
                self.seen += len(item)
                ok = np.bitwise_count(q[query] ^ self.prints[item]).sum(axis=1) <= self.radius
                found.append((query[ok] + low) * n + item[ok])
        return np.divmod(np.unique(np.concatenate(found)), max(1, n))


def multiset(single: np.ndarray, size: np.ndarray, pair: np.ndarray, weight: np.ndarray, a: int, b: int) -> dict[tuple[int, float], int]:
    """Shingles of words a..b-1 with their weights, counted."""
    keys = [*single[a:b].tolist(), *pair[a : b - 1].tolist()]
    return Counter(zip(keys, [*size[a:b].tolist(), *weight[a : b - 1].tolist()], strict=True))


def similarity(x: dict, y: dict) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    shared = sum(min(n, y[k]) * k[1] for k, n in x.items() if k in y)
    total = sum(n * k[1] for k, n in x.items()) + sum(n * k[1] for k, n in y.items()) - shared
    return shared / total if total else 0.0


class Benchmark:
    """Items by length in words, with shingle multisets and an index each, and a filter of their shingles.

    filter holds, by a shingle's leading bits, a bit for each length (modulo 64) whose items have such a shingle.
    """

    def __init__(self, ids: tuple[int, ...], texts: tuple[str, ...]):
        words = next(chunks(pa.array(texts, pa.large_string()), limit=1 << 62)).words()
        parts = features(words)
        self.lengths: dict[int, tuple[list[int], list[dict], HammingIndex, np.uint64, float]] = {}
        self.bits = int(np.clip(np.ceil(np.log2(len(words.hashes) * 128 + 1)), 16, 26))
        self.filter = np.zeros(1 << self.bits, _U)
        for nth, n in enumerate(np.unique(words.counts[words.counts > 0]).tolist()):
            rows = np.flatnonzero(words.counts == n)
            begin = words.first[rows]
            slot = _U(nth % 64)
            items = [multiset(*parts, a, a + n) for a in begin.tolist()]
            lightest = min(sum(k[1] * m for k, m in x.items()) for x in items)
            self.lengths[n] = ([ids[i] for i in rows], items, HammingIndex(window_prints(*parts, begin, n)), slot, lightest)
            at = begin[:, None] + np.arange(n)
            for keys in (parts[0][at], parts[2][at[:, :-1]]):
                self.filter[self._place(keys).reshape(-1)] |= _U(1) << slot

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> _U(64 - self.bits)).astype(np.int64)

    def lengths_with(self, keys: np.ndarray) -> np.ndarray:
        """For each shingle, the bits of the lengths whose items may have it."""
        return self.filter[self._place(keys)]


@dataclass(frozen=True)
class _Part:
    """A slice of the benchmark, broadcast, with a name that workers know it by."""

    id: int
    items: Broadcast

    @property
    def value(self) -> tuple[tuple[int, ...], tuple[str, ...]]:
        return self.items.value


_built: dict[int, Benchmark] = {}


def benchmark_of(part) -> Benchmark:
    """Of a broadcast slice; built once in each worker, which keeps the last two."""
    if part.id not in _built:
        while len(_built) > 1:
            del _built[next(iter(_built))]
        _built[part.id] = Benchmark(*part.value)
    return _built[part.id]


def window_prints(single: np.ndarray, size: np.ndarray, pair: np.ndarray, weight: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(begin), LANES), _U)
    step = max(1, (1 << 16) // n)
    for low in range(0, len(begin), step):
        at = begin[low : low + step, None] + np.arange(n)
        keys, weights = np.hstack([single[at], pair[at[:, :-1]]]), np.hstack([size[at], weight[at[:, :-1]]])
        order = np.argsort(keys, axis=1)
        keys = np.take_along_axis(keys, order, axis=1)
        place = np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
        new = np.ones(keys.shape, bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        copy = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
        out[low : low + step] = simhash(mix(keys + copy.astype(_U) * _COPY), np.sqrt(np.take_along_axis(weights, order, axis=1)))
    return out


def matches(words: Words, bench: Benchmark, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float]]:
    """(row, item id, first word, last word, similarity) of the best window for each row and item."""
    total = len(words.hashes)
    best: dict[tuple[int, int, int], tuple[float, int, int]] = {}
    if not total or not bench.lengths:
        return []
    single, size, pair, weight = features(words)
    has_single, has_pair = bench.lengths_with(single), bench.lengths_with(pair)
    gain_single, gain_pair = size * ((has_single > 0) - threshold), weight * ((has_pair > 0) - threshold)
    sums, pair_sums = np.concatenate([[0.0], np.cumsum(gain_single)]), np.concatenate([[0.0], np.cumsum(gain_pair)])
    opening = sums + pair_sums
    closing = sums.copy()
    closing[1:] += pair_sums[:-1]
    heavy = np.concatenate([[0.0], np.cumsum(size + weight)])  # a text's last pair weighs nothing
    left = words.first[words.row + 1] - np.arange(total)
    whole = words.counts[words.row] == left  # first words of their texts

    def promising(begin: np.ndarray, n: int, slot: np.uint64) -> np.ndarray:
        kept = [begin[:0]]
        step = max(1, (1 << 18) // n)
        for low in range(0, len(begin), step):
            b = begin[low : low + step]
            at = b[:, None] + np.arange(n)
            gain = (size[at] * (((has_single[at] >> slot) & _U(1)) - threshold)).sum(axis=1)
            at = at[:, :-1]
            gain += (weight[at] * (((has_pair[at] >> slot) & _U(1)) - threshold)).sum(axis=1)
            kept.append(b[gain >= -1e-6])
        return np.concatenate(kept)

    for n, (_, items, index, slot, lightest) in bench.lengths.items():
        begin = np.flatnonzero(closing[n:] >= opening[: total + 1 - n] - 1e-6) if total >= n else np.zeros(0, np.int64)
        begin = begin[left[begin] >= n]
        groups = [(begin, n)]
        # a shorter text is one window; it can only match if it weighs THRESHOLD of the lightest item
        short = np.flatnonzero(whole & (left < n))
        short = short[(closing[short + left[short]] >= opening[short] - 1e-6) & (heavy[short + left[short]] - heavy[short] >= threshold * lightest - 1e-6)]
        groups += [(short[left[short] == m], m) for m in np.unique(left[short]).tolist()]
        for start, m in groups:
            start = promising(start, m, slot)
            if not len(start):
                continue
            query, item = index.near(window_prints(single, size, pair, weight, start, m))
            known: dict[int, dict] = {}
            for a, i in zip(start[query].tolist(), item.tolist(), strict=True):
                if a not in known:
                    known = {a: multiset(single, size, pair, weight, a, a + m)}
                s = similarity(known[a], items[i])
                key = (int(words.row[a]), n, i)
                if s >= threshold and (key not in best or (s, -a) > (best[key][0], -best[key][1])):
                    best[key] = (s, a, a + m - 1)
    return [(row, bench.lengths[n][0][i], a, b, s) for (row, n, i), (s, a, b) in best.items()]


def _rows(batch: pa.RecordBatch, part, threshold: float) -> Iterator[pa.RecordBatch]:
    bench = benchmark_of(part)
    for chunk in chunks(batch.column(1)):
        words = chunk.words()
        found = matches(words, bench, threshold)
        ids = batch.column(0).slice(chunk.rows.start, chunk.n).take(pa.array([x[0] for x in found], pa.int64()))
        first = [int(x[2] - words.first[x[0]]) for x in found]
        last = [int(x[3] - words.first[x[0]]) for x in found]
        columns = [ids, pa.array([x[1] for x in found], pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array([round(x[4], 6) for x in found], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "first_word", "last_word", "similarity"])


RESULT = "doc_id long, item_id long, first_word int, last_word int, similarity double"


def slices(benchmark: DataFrame, most: int = SLICE_BYTES) -> Iterator[tuple[tuple[int, ...], tuple[str, ...]]]:
    """The benchmark's items in parts of about so many bytes of text, each small enough for driver and tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // most)
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()
        if rows:
            yield tuple(r[0] for r in rows), tuple(r[1] for r in rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, similarity) of each item found in a document; words count from 0."""
    sc = docs.sparkSession.sparkContext
    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    found = None
    for part in slices(benchmark):
        here = map_batches(rows, partial(_rows, part=_Part(uuid.uuid4().int, sc.broadcast(part)), threshold=threshold), RESULT)
        found = here if found is None else found.union(here)
    return docs.sparkSession.createDataFrame([], RESULT) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows of any doc_id that contains an item. Rows without doc_id are judged by nothing and stay."""
    name = unused(docs, "_gone")
    gone = written(contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
