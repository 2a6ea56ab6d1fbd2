"""Items that share a bucket, linked to heads of two levels; what the two deduplications have in common.

Where items are read, those of one Arrow batch that share a bucket are compared with the least of them at once; only
that one goes on, in a packed block of (bucket, item) for each range of buckets, to be compared with the least of all
batches. So a bucket that holds a third of all items sends one entry for each batch, and most of its comparisons move
nothing. Items that fail against their head, and those below a head that fails, are compared with all others of their
bucket that aren't linked to them yet: every pair that shares a bucket is either judged or linked, and nothing is capped.

An item is known by a 128-bit id; h, its first half, only serves to look items up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import discard, written
from .textcore import BATCH_BYTES, map_batches, map_partitions

_U = np.uint64
#: What a batch gives: blocks, each of a range of buckets, and pairs judged at once, which go with their bucket's range.
MEETING = "part int, block binary, bucket long, a binary, b binary, share double"
_NAMES = [x.split()[0] for x in MEETING.split(", ")]
_KINDS = [pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.float64()]
_MET = "bucket long, ha long, hb long, a binary, b binary, share double"
JUDGED = "bucket array<long>, a binary, b binary, share double"


def shards(df: DataFrame) -> int:
    """Ranges of buckets: as many as the session's shuffles have partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _first(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: which is the first of its equals, and the place of each one's first."""
    first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return first, np.repeat(at, np.diff(np.append(at, len(k))))


def meet_here(keys: np.ndarray, ids: list[bytes], h: np.ndarray, judge: Callable[[np.ndarray, np.ndarray], np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """MEETING of one batch's items, given their bucket keys (items x bands) and a judge of pairs of places."""
    bands = keys.shape[1]
    keys, owner = keys.reshape(-1), np.repeat(np.arange(len(ids)), bands)
    part_of = lambda k: ((k >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
    order = np.lexsort((h[owner], keys))
    first, head = _first(keys[order])
    mine, top = owner[order], owner[order[head]]
    pair = np.flatnonzero(~first & (mine != top))
    if len(pair):
        a, b, k = mine[pair], top[pair], keys[order[pair]]
        both, again = np.unique(a * len(ids) + b, return_inverse=True)
        share = judge(both // len(ids), both % len(ids))[again]
        named = [pa.array([ids[i] for i in x.tolist()], pa.binary()) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(part_of(k)), pa.nulls(len(k), pa.binary()), pa.array(k.view(np.int64)), *named, pa.array(share)], _NAMES)
    at = order[first]
    packed = np.stack([keys[at], h[owner[at]]], axis=1)
    some, begin = np.unique(part_of(keys[at]), return_index=True)
    block = [packed[s:e].tobytes() for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(block, pa.binary()), *(pa.nulls(len(some), x) for x in _KINDS[2:])], _NAMES)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_MET: every entry that isn't its bucket's first, with that first one; and the judged pairs as they are. Rows come
    by range of buckets; of what has been read of a range only one entry for each bucket is kept, however many it has."""
    known, owners = np.zeros(0, _U), np.zeros(0, _U)
    waiting: list[bytes] = []
    names = [x.split()[0] for x in _MET.split(", ")]

    def work() -> Iterator[pa.RecordBatch]:
        nonlocal known, owners
        entries = np.frombuffer(b"".join(waiting), _U).reshape(-1, 2)
        waiting.clear()
        keys, ids = np.concatenate([known, entries[:, 0]]), np.concatenate([owners, entries[:, 1]])
        later = np.arange(len(keys)) >= len(known)  # what is known stays first
        order = np.lexsort((ids, later, keys))
        k, i, new = keys[order], ids[order], later[order]
        first, head = _first(k)
        top = i[head]
        pair = new & ~first & (i != top)
        known, owners = k[first], i[first]
        found = [pa.array(x[pair].view(np.int64)) for x in (k, i, top)]
        yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(len(found[0]), x) for x in _KINDS[3:])], names)

    size, part = 0, None
    for batch in batches:
        judged = batch.filter(pc.is_valid(batch.column(5)))
        if judged.num_rows:
            h = [pa.array(np.frombuffer(b"".join(judged.column(c).to_pylist()), np.int64)[::2]) for c in (3, 4)]
            yield pa.RecordBatch.from_arrays([judged.column(2), *h, *judged.columns[3:]], names)
        batch = batch.filter(pc.is_valid(batch.column(1)))
        for now, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if waiting and (now != part or size > 2 * BATCH_BYTES):
                yield from work()
                size = 0
            if now != part:
                known, owners = known[:0], owners[:0]
            part = now
            waiting.append(block)
            size += len(block)
    if waiting:
        yield from work()


Judge = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]


def _judged(pairs: DataFrame, items: DataFrame, key: str, judge: Judge) -> DataFrame:
    """JUDGED of pairs (bucket array, {key}a, {key}b), which are joined with the items (h, id, item) by one of these."""

    def side(x: str) -> DataFrame:
        return items.select(F.col(key).alias(f"{key}{x}"), F.col("id").alias(f"i{x}"), F.col("item").alias(f"l{x}"))

    joined = pairs.join(side("a"), f"{key}a").join(side("b"), f"{key}b").filter("ia <> ib")
    return map_batches(joined.select("bucket", F.col("ia").alias("a"), "la", F.col("ib").alias("b"), "lb"), judge, JUDGED)


def linked(meeting: DataFrame, items: DataFrame, judge: Judge, threshold: float, name: str, refine: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Accepted (a, b) pairs of ids that link whatever shares a bucket and is similar.

    meeting: MEETING of all batches. items: (h, id, item), repeated or not. judge: of a batch of (bucket, a, item of a,
    b, item of b) the rows of JUDGED. refine: may replace shares, row by row.
    """
    # in a fixed order, so that a task that runs again finds the same heads
    blocks = meeting.repartitionById(shards(meeting), F.col("part")).sortWithinPartitions("part", "block")
    met = map_partitions(blocks, _meet, _MET)
    met = written(met, f"{name}-met")
    near = met.filter("share is not null").groupBy("a", "b").agg(F.collect_set("bucket").alias("bucket"), F.first("share").alias("share"))
    pairs = met.filter("share is null").groupBy("ha", "hb").agg(F.collect_set("bucket").alias("bucket"))
    # the items that share a bucket with another; the others don't move
    some = met.select(F.explode(F.array("ha", "hb")).alias("h")).distinct()
    texts = written(items.join(some, "h", "left_semi").groupBy("h", "id").agg(F.first("item").alias("item")), f"{name}-items")
    found = _judged(pairs, texts, "h", judge).unionByName(near)
    found = written(found, f"{name}-judged")
    discard(met)
    refined = refine(found)
    if refined is not found:
        refined = written(refined, f"{name}-refined")
        discard(found)
    found = refined
    good = found.filter(F.col("share") >= threshold).select("a", "b")
    bad = found.filter(F.col("share") < threshold).select(F.explode("bucket").alias("bucket"), "a", "b")
    far = written(bad, f"{name}-far")
    if far.isEmpty():
        discard(texts)
        return good
    # those that fail against their head, and those below a head that fails, meet all others of the bucket that nothing
    # has linked them to yet
    roots = components(good, name=f"{name}-good")
    pairs = found.select(F.explode("bucket").alias("bucket"), "a", "b").join(far.select("bucket").distinct(), "bucket", "left_semi")
    pairs = written(pairs, f"{name}-members")
    below = pairs.join(far.select("bucket", F.col("a").alias("b")), ["bucket", "b"]).select("bucket", F.col("a").alias("id"))
    apart = far.select("bucket", F.col("a").alias("id")).union(below).distinct().withColumn("apart", F.lit(True))
    members = pairs.select("bucket", F.explode(F.array("a", "b")).alias("id")).distinct().join(apart, ["bucket", "id"], "left")
    members = members.join(roots, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("root", "id").alias("root"), "apart")
    members = written(members, f"{name}-rooted")
    x = members.filter("apart").select("bucket", F.col("id").alias("x"), F.col("root").alias("rx"))
    y = members.select("bucket", F.col("id").alias("y"), F.col("root").alias("ry"))
    rest = x.join(y, "bucket").filter("rx <> ry").select(F.greatest("x", "y").alias("ida"), F.least("x", "y").alias("idb")).distinct()
    tried = far.select(F.greatest("a", "b").alias("ida"), F.least("a", "b").alias("idb"))
    rest = written(rest.join(tried, ["ida", "idb"], "left_anti").withColumn("bucket", F.array().cast("array<long>")), f"{name}-rest")
    # written, so that judging and what comes after it don't each keep a Python worker
    late = written(_judged(rest, texts, "id", judge), f"{name}-late")
    discard(far, pairs, members, rest, texts)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(refine(late).filter(F.col("share") >= threshold).select("a", "b"))
