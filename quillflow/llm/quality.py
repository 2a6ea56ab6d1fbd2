"""Operator 7: a document classifier with supervised subword embeddings.

Tokens are runs of bytes above the space character in the lower-cased text. A document's features are its tokens, their
3-, 4- and 5-byte n-grams with a mark at either end of the token (but none with both), and a mark for a token that repeats the one before
it; each is hashed to one of BUCKETS learned vectors. The document is the average of its vectors, and a softmax layer
gives the probabilities of three classes: good, low quality, toxic. Vectors and layer are trained by numpy stochastic
gradient descent, document by document, with each vector's steps scaled by its past gradients.

Training takes TRAIN labelled documents at most (the least hashes of doc_id), whole: their features are counted in
tasks, and those that at least MIN_DOCS of them have (of fewer than 100 * MIN_DOCS documents, one in a hundred) go to the
driver, which trains; what few documents have teaches nothing that holds for others. That bound doesn't grow with the
data. Since the softmax layer is linear in the average, scoring needs only one row of class weights for each bucket: it
sums those over the whole text, in one pass without a shuffle.

Defined results: a document without tokens, also null text, has the class shares of the training labels. Labels that
are null, repeated for a doc_id (the greatest values count) or of documents that are absent or have no text are handled
before the sample, so they don't use up its bound. With no labelled document every document is good with probability 1.
Rows with null or repeated doc_id are scored like others; of a labelled doc_id with several texts the least is trained
on. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import spread, written
from .textcore import Chunk, chunks, map_batches, map_partitions, release, runs, span_hashes

CLASSES = ("good", "low", "toxic")
#: KEEP is chosen by held-out labels (trained on 5000 of a larger table, 4000 others; accuracy, then the share kept of
#: good, low and toxic documents): at 0.5 0.988; 0.994, 0.007, 0.065; at 0.85 0.988; 0.989, 0.006, 0.022. With 3000 to
#: train on, at 0.8 0.963; 0.974, 0.028, 0.118, at 0.9 0.968; 0.963, 0.009, 0.025.
BUCKETS, WIDTH, TRAIN, EPOCHS, RATE, MIN_DOCS, KEEP = 1 << 18, 8, 5000, 10, 2.0, 8, 0.85
GRAMS = (3, 4, 5)
_U = np.uint64
_SHIFT = _U(64 - 18)


def features(texts: pa.Array) -> Iterator[tuple[Chunk, list[tuple[np.ndarray, np.ndarray]]]]:
    """Of each chunk: (bucket, row) arrays, one pair for each kind of feature; rows ascend."""
    for chunk in chunks(texts, limit=1 << 19):
        # one separator after every text, so that n-grams see both ends of a token
        joined = Chunk(pc.binary_join_element_wise(chunk.texts, *(pa.scalar(x, pa.large_string()) for x in ("", " "))), chunk.rows, lower=False)
        data = np.concatenate([np.array([32], np.uint8), joined.data])
        space = data <= 32
        data = np.where(space, np.uint8(32), data)
        bounds = joined.offsets + 1
        n = len(data)
        row_of = np.repeat(np.arange(chunk.n), np.diff(joined.offsets)) if n > 1 else np.zeros(0, np.int64)
        row_of = np.concatenate([[0], row_of]).astype(np.int32)
        found = []
        wide = np.concatenate([data, np.full(8, 32, np.uint8)])
        before = np.concatenate([[0], np.cumsum(space)])
        code = np.zeros(n, _U)
        for at in range(GRAMS[-1]):
            code = (code << _U(8)) | wide[at : at + n]
            size = at + 1
            if size in GRAMS and n >= size:
                last = n - size + 1
                whole = before[size - 1 : size - 1 + last] == before[1 : 1 + last]  # no separator inside
                i = np.flatnonzero(whole & ~(space[:last] & space[size - 1 :]))
                bucket = ((code[i] + _U(size << 56)) * _U(0x9E3779B97F4A7C15)) >> _SHIFT
                found.append((bucket.astype(np.int64), row_of[i + 1]))
        start = np.flatnonzero(~space[1:] & space[:-1]) + 1
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        word = span_hashes(data, start, end)
        row = (np.searchsorted(bounds, start, "right") - 1).astype(np.int32)
        found.append(((word >> _SHIFT).astype(np.int64), row))
        again = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
        found.append((np.zeros(len(again), np.int64), row[again]))
        yield chunk, found


def counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its distinct buckets and their shares."""
    for chunk, found in features(texts):
        keys, counts = runs(np.sort(np.concatenate([row.astype(np.int64) * BUCKETS + bucket for bucket, row in found])))
        edges = np.searchsorted(keys, np.arange(chunk.n + 1) * BUCKETS)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield (keys[a:b] % BUCKETS).astype(np.int32), (counts[a:b] / max(1, counts[a:b].sum())).astype(np.float32)


class Model:
    """Class weights of every bucket (BUCKETS x 3), bias, and the class shares of the training labels."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, shares: np.ndarray):
        self.table, self.bias, self.shares = table.astype(np.float32), bias, shares

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros((0, 3))]
        for chunk, found in features(texts):
            sums, total = np.zeros((chunk.n, 3)), np.zeros(chunk.n)
            for bucket, row in found:
                total += np.bincount(row, minlength=chunk.n)
                for c in range(3):
                    sums[:, c] += np.bincount(row, self.table[c][bucket], chunk.n)
            logits = sums / np.maximum(total, 1)[:, None] + self.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[total == 0] = self.shares
            out.append(p)
        return np.concatenate(out)


Features = list[tuple[np.ndarray, np.ndarray]]


def least_documents(n: int) -> int:
    """How many of n training documents must have a feature."""
    return min(MIN_DOCS, 1 + n // 100)


def train(texts: list[str], classes: list[int], seed: int = 1) -> Model:
    """A model of texts that are here; fit() on their frequent features."""
    docs = list(counted(pa.array(texts, pa.large_string())))
    seen = np.zeros(BUCKETS, np.int64)
    for bucket, _ in docs:
        seen[bucket] += 1
    often = seen >= least_documents(len(docs))
    return fit([(bucket[often[bucket]], share[often[bucket]]) for bucket, share in docs], classes, seed)


def fit(docs: Features, classes: list[int], seed: int = 1) -> Model:
    """Stochastic gradient descent over documents, each given by its distinct buckets and their shares."""
    shares = np.bincount(classes, minlength=3) / max(1, len(classes)) if classes else np.array([1.0, 0, 0])
    if not classes:
        return Model(np.zeros((3, BUCKETS)), np.array([50.0, 0, 0]), shares)
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH
    used = np.zeros(BUCKETS, bool)
    for bucket, _ in docs:
        used[bucket] = True
    vectors[~used] = 0
    layer = np.zeros((WIDTH, 3), np.float32)
    bias = np.log(np.maximum(shares, 1e-3)).astype(np.float32)
    past = np.full(BUCKETS, 1e-8, np.float32)
    past_layer = np.full((WIDTH, 3), 1e-8, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(docs)):
            bucket, share = docs[i]
            if not len(bucket):
                continue
            own = vectors[bucket]
            mean = share @ own
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[classes[i]] -= 1
            back = layer @ p
            step = np.outer(mean, p)
            past_layer += step * step
            layer -= rate * step / np.sqrt(past_layer)
            past[bucket] += (share * share) * (back @ back)
            vectors[bucket] = own - (rate * share / np.sqrt(past[bucket]))[:, None] * back
            bias -= 0.1 * rate * p
    return Model((vectors @ layer).T.copy(), bias.astype(np.float64), shares)


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> DataFrame:
    """(doc_id, class, text) of the labelled documents to train on."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    kind = F.when(F.max("toxic") == 1, 2).when(F.max("quality") == 1, 0).otherwise(1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    # only labels with a text count towards `most`
    present = known.agg(kind.alias("class")).join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` ids: a broadcast of bounded size
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("class").alias("class"), F.min("text").alias("text"))


def _features_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    found = [(b.tobytes(), s.tobytes()) for b, s in counted(batch.column(2))]
    columns = [pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "class", "buckets", "shares"])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a partition's documents have each bucket."""
    seen = np.zeros(BUCKETS, np.int32)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            seen[np.frombuffer(raw, np.int32)] += 1
    yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], ["seen"])


def _often(batch: pa.RecordBatch, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.unpackbits(often).astype(bool)
    found = []
    for b, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        bucket = np.frombuffer(b, np.int32)
        keep = some[bucket]
        found.append((bucket[keep].tobytes(), np.frombuffer(s, np.float32)[keep].tobytes()))
    columns = [pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], batch.schema.names)


FEATURES = "doc_id long, class int, buckets binary, shares binary"
#: Partitions that a training sample has at most, each of which counts the buckets of its own.
PARTS = 8


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of labelled documents; only its frequent features come to the driver."""
    found = written(map_batches(sample(docs, labels), _features_of, FEATURES), "quality-sample").coalesce(PARTS)
    seen = np.zeros(BUCKETS, np.int64)
    for row in map_partitions(found.select("buckets"), _seen, "seen binary").collect():
        seen += np.frombuffer(row["seen"], np.int32)
    often = np.packbits(seen >= least_documents(found.count()))
    rows = [(r[0], r[1], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in map_batches(found, partial(_often, often=often), FEATURES).toLocalIterator()]
    rows.sort(key=lambda r: r[0])
    model = fit([r[2:] for r in rows], [r[1] for r in rows])
    del rows
    release()  # the driver goes on for hours after this
    return model


def _rows(batch: pa.RecordBatch, model) -> Iterator[pa.RecordBatch]:
    p = model.value.probabilities(batch.column(batch.num_columns - 1))
    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(p[:, c]) for c in range(3))], [*batch.schema.names[:-1], "good", "low", "toxic"])


def scores(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), training: DataFrame | None = None) -> DataFrame:
    """(*carry, good, low, toxic): class probabilities of every document; the columns of carry are passed on."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trained(docs if training is None else training, labels))
    rows = spread(docs).select(*carry, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_batches(rows, partial(_rows, model=model), f"{schema}, good double, low double, toxic double")


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of docs, all columns as they are, whose probability of being good is keep at least."""
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    plain = docs.toDF(*names)
    at = names[columns.index("text")]
    rows = plain.withColumn("text", F.col(at))
    scored = scores(rows, labels, tuple(names), docs)
    return scored.filter(F.col("good") >= keep).select(*names).toDF(*columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their probabilities; scores() has those of all."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scores(docs, labels).filter(F.col("good") >= KEEP)
