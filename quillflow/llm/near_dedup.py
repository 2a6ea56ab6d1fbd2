"""Operator 1: near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its word trigrams (a shorter text has one shingle, all its words); a trigram that
occurs n times weighs 1 + log2(n). Hashed darts fall on the plane of weight and rank of each shingle as a unit Poisson
process; the darts inside a document's weights and below a rank that gives about k (ln k + 3) of them are found, each
belongs to one of k coordinates, and each coordinate keeps its earliest dart (T. Christiani, DartMinHash, 2020). Two
documents agree in a coordinate with a probability of their weighted Jaccard similarity.

Equal word sequences are one text, known by a 128-bit hash. Texts that share a band's bucket are linked as in
meeting.py: to heads of two levels, without a cap. The share of coordinates in which two texts agree decides where it is
more than MARGIN (three standard errors) from the threshold; between, the texts themselves are fetched and their exact
weighted Jaccard similarity decides. Union-find then makes groups of the accepted pairs.

Defined results: rows with null doc_id, and texts that are null or have no word, are in no group. Rows of a doc_id with
the same word sequence are one document, those with others are documents of their own. Of a group the least (doc_id,
text's hash) is kept. Other columns, whatever their names, aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .meeting import JUDGED, MEETING, linked, meet_here, shards
from .shared import discard, spread, unused, written
from .textcore import CHUNK_BYTES, Words, chunks, longs, map_batches, mix, runs, unit

#: k coordinates; BANDS bands of ROWS of them, in which every coordinate takes part twice, with other partners: at
#: similarity s a pair shares a bucket with a probability of about 0.96 at 0.5, 0.99 at 0.55, 0.999 at 0.6.
K, BANDS, ROWS, THRESHOLD, MARGIN, SHINGLE = 128, 64, 4, 0.5, 0.133, 3
_U = np.uint64
_TURNS = np.concatenate([np.arange(K), np.random.default_rng(29).permutation(K)])


def weighted_shingles(words: Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 48-bit id and weight of each distinct shingle."""
    h, at = words.shingles(shingle)
    row = words.row[at].astype(np.uint64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, words.n, 65536):  # rows are 16 bits of a key
        here = slice(*np.searchsorted(row, [low, low + 65536]))
        keys, counts = runs(np.sort(((row[here] - _U(low)) << _U(48)) | (h[here] >> _U(16))))
        out.append((keys, counts))
        rows = (keys >> _U(48)).astype(np.int64) + low
        out[-1] = (rows, keys & _U((1 << 48) - 1), 1 + np.log2(counts))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))


def dart_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """Signatures (n x k, 32 bits) of the weighted sets of rows 0..n-1; those of rows without elements stay 0."""
    total = np.bincount(row, weight, n)
    theta = np.divide(k * (np.log(k) + 3), total, out=np.zeros(n), where=total > 0)
    best = np.full(n * k, np.inf)
    sign = np.zeros(n * k, np.uint32)
    todo = total > 0
    while todo.any():
        use = todo[row]
        r, e, x = row[use], element[use], weight[use]
        # the weight axis in cells of doubling width: [0, 1), [1, 3), [3, 7) ...
        base, width = 0.0, 1.0
        while len(r):
            seed = mix(e * _U(0x9E3779B97F4A7C15) + _U(int(width)))
            _throw(r, seed, x, base, width, theta, k, best, sign)
            base, width = base + width, width * 2
            left = x > base
            r, e, x = r[left], e[left], x[left]
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        theta[todo] *= 2  # darts of lower rank come again and stay
    return sign.reshape(n, k)


def _throw(r: np.ndarray, seed: np.ndarray, x: np.ndarray, base: float, width: float, theta: np.ndarray, k: int, best: np.ndarray, sign: np.ndarray) -> None:
    """Darts of one weight cell in the order of their ranks, whose gaps are exponential, up to each row's limit."""
    rank, limit = np.zeros(len(r)), theta[r]
    j = 0
    slots, ranks, ids = [], [], []
    while len(r):
        j += 1
        h = mix(seed + _U(j * 0xD1B54A32D192ED03 % (1 << 64)))
        rank = rank - np.log(unit(h)) / width
        live = rank < limit
        r, seed, x, rank, limit, h = r[live], seed[live], x[live], rank[live], limit[live], h[live]
        h2 = mix(h ^ _U(0xA24BAED4963EE407))
        hit = base + width * unit(mix(h2 + _U(j))) < x
        slots.append(r[hit] * k + (h2[hit] % _U(k)).astype(np.int64))
        ranks.append(rank[hit])
        ids.append((h2[hit] >> _U(32)).astype(np.uint32))
    slot, rank, ident = np.concatenate(slots or [r]), np.concatenate(ranks or [rank]), np.concatenate(ids or [sign[:0]])
    first = best.copy()
    np.minimum.at(best, slot, rank)
    won = (rank == best[slot]) & (rank < first[slot])
    sign[slot[won]] = ident[won]


def band_keys(sign: np.ndarray) -> np.ndarray:
    """n x BANDS bucket keys."""
    n = len(sign)
    parts = sign[:, _TURNS].reshape(n, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (n, BANDS)).copy()
    for j in range(ROWS):
        keys = mix(keys + parts[:, :, j] * _U(0x9FB21C651E98DF25))
    return keys


def _ids(words: Words) -> list[bytes]:
    """128-bit hashes of the rows' word sequences."""
    raw = np.stack(words.text_hashes(), axis=1).tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


#: A batch's distinct texts, each with its signature and the documents that have it, and what meeting.py has of it.
PASS = f"h long, id binary, docs array<long>, sign binary, {MEETING}"


def _read(batch: pa.RecordBatch, parts: int) -> Iterator[pa.RecordBatch]:
    doc_ids = batch.column(0).to_pylist()
    docs: dict[bytes, set[int]] = {}
    signs = [np.zeros((0, K), np.uint32)]
    for chunk in chunks(batch.column(1)):
        words = chunk.words()
        new = np.zeros(words.n, bool)
        for i, (text, n) in enumerate(zip(_ids(words), words.counts.tolist(), strict=True)):
            if n:
                new[i] = text not in docs
                docs.setdefault(text, set()).add(doc_ids[chunk.rows.start + i])
        row, element, weight = weighted_shingles(words)
        use = new[row]
        signs.append(dart_minhash(row[use], element[use], weight[use], words.n)[new])
    if not docs:
        return
    sign, ids = np.concatenate(signs), list(docs)
    h = np.frombuffer(b"".join(ids), _U)[::2]
    own = [longs(h), pa.array(ids, pa.binary()), pa.array([sorted(x) for x in docs.values()], pa.list_(pa.int64())), pa.array([x.tobytes() for x in sign], pa.binary())]
    names = [x.split()[0] for x in PASS.split(", ")]
    meeting = list(meet_here(band_keys(sign), ids, h, lambda a, b: (sign[a] == sign[b]).mean(axis=1), parts))
    yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(ids), x.type) for x in meeting[0].columns)], names)
    for some in meeting:
        yield pa.RecordBatch.from_arrays([*(pa.nulls(some.num_rows, x.type) for x in own), *some.columns], names)


def _agree(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    def of(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)

    share = (of(batch.column(2)) == of(batch.column(4))).mean(axis=1)
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(share)], ["bucket", "a", "b", "share"])


def _named(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(id, *columns of the batch), the text being the last of these."""
    ids = [x for chunk in chunks(batch.columns[-1]) for x in _ids(chunk.words())]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *batch.columns], ["id", *batch.schema.names])


def weighted_jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of two columns of texts, row by row."""
    out = [np.zeros(0)]
    size = np.cumsum(pc.binary_length(left).to_numpy() + pc.binary_length(right).to_numpy())
    low = 0
    while low < len(left):
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + CHUNK_BYTES, "right")))
        n = high - low
        words = next(chunks(pa.concat_arrays([left.slice(low, n), right.slice(low, n)]), limit=1 << 62)).words()
        row, element, weight = weighted_shingles(words)
        order = np.lexsort((row // n, element, row % n))
        pair, e, w = row[order] % n, element[order], weight[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (e[1:] == e[:-1]))
        shared = np.bincount(pair[same], np.minimum(w[same], w[same + 1]), n)
        out.append(shared / np.maximum(np.bincount(pair, w, n) - shared, 1e-300))
        low = high
    return np.concatenate(out)


def _exact(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    share = weighted_jaccard(batch.column(2), batch.column(4))
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(share)], ["bucket", "a", "b", "share"])


def _refined(pairs: DataFrame, rows: DataFrame, read: DataFrame, threshold: float) -> DataFrame:
    """The pairs, those near the threshold with their exact similarity."""
    near = F.abs(F.col("share") - threshold) < MARGIN
    open_ = pairs.filter(near).select("bucket", "a", "b")
    some = written(open_.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-open")
    if some.isEmpty():
        return pairs
    # any document that has the text will do
    docs = read.filter("id is not null").select("id", F.get("docs", F.lit(0)).alias("doc_id")).join(some, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    texts = map_batches(rows.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("text"), _named, "id binary, text string")
    texts = written(texts.join(some, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")), "near-texts")
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"l{x}"))
    joined = open_.join(side("a"), "a").join(side("b"), "b").select("bucket", "a", "la", "b", "lb")
    return pairs.filter(~near).select("bucket", "a", "b", "share").union(written(map_batches(joined, _exact, JUDGED), "near-exact"))


def _rows(docs: DataFrame) -> DataFrame:
    return spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and length(text) > 0")


def duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, id, duplicate_of): each document to drop, as doc_id and its text's id, and the doc_id that is kept."""
    rows = _rows(docs)
    read = written(map_batches(rows, partial(_read, parts=shards(rows)), PASS), "near-pass")
    items = read.filter("id is not null").select("h", "id", F.col("sign").alias("item"))
    meeting = read.filter("part is not null").select(*(x.split()[0] for x in MEETING.split(", ")))
    near = linked(meeting, items, _agree, threshold, "near", lambda pairs: _refined(pairs, rows, read, threshold))
    groups = components(near, name="near-edges")
    # a root is the least node of its component, so it has no root of its own
    texts = read.filter("id is not null").select("id", "docs").join(groups, F.col("id") == groups["node"], "left")
    each = texts.select(F.coalesce("root", "id").alias("group"), F.explode("docs").alias("doc_id"), "id")
    kept = each.groupBy("group").agg(F.min(F.struct("doc_id", "id")).alias("kept"), F.count("*").alias("n")).filter("n > 1").select("group", "kept")
    gone = each.join(kept, "group").filter("struct(doc_id, id) <> kept")
    return gone.select("doc_id", "id", F.col("kept.doc_id").alias("duplicate_of")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of): each document to drop and the one of its group that is kept."""
    return duplicates(docs, threshold).select("doc_id", "duplicate_of")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the duplicates; exactly repeated rows of a document that stays are one. Rows without doc_id stay."""
    name, mark = unused(docs, "_other"), unused(docs, "_mark")
    gone = written(duplicates(docs), "near-gone")
    match = F.col("doc_id").cast("long") == F.col(name)
    again = docs.select(F.col("doc_id").cast("long").alias(name)).groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").dropna().select(name)
    again = written(again, "near-again")
    if again.isEmpty():
        discard(again)
        return docs.join(gone.select(F.col("doc_id").alias(name)), match, "left_anti")
    kept = docs.join(again, match, "left_anti").join(gone.select(F.col("doc_id").alias(name)), match, "left_anti")
    # of a doc_id with several rows each text is judged by itself
    several = docs.join(again, match, "left_semi").withColumn(mark, F.sha2(F.col("text").cast("string"), 256))
    texts = several.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("mark"), F.col("text").cast("string").alias("text")).filter("length(text) > 0").dropDuplicates(["doc_id", "mark"])
    lost = map_batches(texts, _named, "id binary, doc_id long, mark string, text string").join(gone, ["doc_id", "id"], "left_semi")
    lost = written(lost.select(F.col("doc_id").alias(name), F.col("mark").alias(mark)), "near-lost")
    several = several.join(lost.withColumnRenamed(mark, f"{mark}2"), match & (F.col(mark) == F.col(f"{mark}2")), "left_anti")
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))), 256)  # a map column can't be compared itself
    return kept.union(several.withColumn(mark, row).dropDuplicates([mark]).drop(mark))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
