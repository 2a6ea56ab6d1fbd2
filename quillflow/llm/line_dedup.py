"""Operator 5: fuzzy duplicates among lines, by MinHash over character shingles.

A line is compared by its normal form, lower-cased and without spaces at its ends; lines whose normal form is empty
take no part. Lines with equal normal forms are one, known by a 128-bit hash. Each distinct line's set of shingles (every
run of 8 bytes of its UTF-8; a shorter line is one shingle) is hashed once into K bins whose least values are its
signature, empty bins borrowing from full ones (A. Shrivastava, optimal densification, 2017). Lines that share a bucket
of a band are linked to a head of that bucket where the exact Jaccard similarity of their shingle sets reaches the
threshold; distributed union-find makes components, each keeping its first line by (doc_id, line_no).

Buckets are worked off as in meeting.py: by heads of two levels, without a cap. The documents are read twice, for the
lines, which are written to the shared folder, and for the buckets. Of the texts one copy of each distinct line moves, to
meet the lines that share a bucket across batches.

Defined results: null texts and rows with null doc_id have no lines; lines with the same (doc_id, line_no), as in
repeated rows, are one occurrence of each distinct line. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .meeting import MEETING, linked, meet_here, shards
from .shared import spread, unused, written
from .textcore import chunks, map_batches, mix

#: At similarity s a pair shares a bucket with probability 1 - (1 - s**5)**12: 0.96 at 0.75, 0.99 at 0.8, 0.999 at 0.86.
SHINGLE, BANDS, ROWS, THRESHOLD = 8, 12, 5, 0.75
K = BANDS * ROWS
#: Shingles that are compared or signed at once; a longer line is a piece of work of its own.
PIECE = 1 << 16
_U = np.uint64
#: Sorts behind every shingle: no UTF-8 text has such a byte.
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number within the row, start and end, without spaces around, of each line that isn't blank."""
    rows = np.flatnonzero(np.diff(offsets) > 0)
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([rows, np.searchsorted(offsets, breaks, "right") - 1])
    start, end = np.concatenate([offsets[:-1][rows], breaks + 1]), np.concatenate([offsets[1:][rows], breaks])
    # the nth start and the nth end of a text are those of its nth line
    start, end = start[np.lexsort((start, row))], end[np.lexsort((end, row))]
    row = np.sort(row)
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    number = np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))
    text = np.flatnonzero((data != 32) & (data != 10))
    low, high = np.searchsorted(text, start), np.searchsorted(text, end)
    some = low < high
    return row[some], number[some], text[low[some]], text[high[some] - 1] + 1


class Lines:
    """Some lines' bytes in one array, with the shingles of any of them."""

    def __init__(self, lines: list[bytes]):
        self.raw = b"".join([*lines, b"\0" * SHINGLE])
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.size) - self.size
        self.count = np.maximum(1, self.size - SHINGLE + 1)  # shingles, repeated ones included
        self.grams = np.ndarray(max(0, len(self.raw) - SHINGLE + 1), "<u8", self.raw, strides=(1,))

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nth of which, and the 8 bytes of each shingle; a short line's are filled with zeros behind it."""
        n = self.count[which]
        nth = np.repeat(np.arange(len(which)), n)
        at = np.arange(len(nth)) + np.repeat(self.start[which] - np.cumsum(n) + n, n)
        found = self.grams[at]
        short = np.flatnonzero(self.size[which] < SHINGLE)
        if len(short):
            # the bytes of the next line are cut off, and the length keeps "a" apart from "a\0"
            where = (np.cumsum(n) - n)[short]
            bits = (self.size[which[short]] * 8).astype(_U)
            found[where] = (found[where] & ((_U(1) << bits) - _U(1))) | ((_U(0xF8) + (bits >> _U(3))) << _U(56))
        return nth, found

    def pieces(self, which: np.ndarray) -> Iterator[np.ndarray]:
        """which, in order, in parts of about PIECE shingles."""
        total = np.cumsum(self.count[which])
        at = 0
        while at < len(which):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE, "right")))
            yield which[at:stop]
            at = stop


def signatures(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x K least values by bin. Rows without shingles stay at the greatest value."""
    empty = np.uint32(0xFFFFFFFF)
    sign = np.full(n * K, empty, np.uint32)
    high = hashes >> _U(32)
    np.minimum.at(sign, row * K + ((high * _U(K)) >> _U(32)).astype(np.int64), np.minimum(hashes & _U(0xFFFFFFFF), _U(0xFFFFFFFE)).astype(np.uint32))
    full = sign != empty
    some = full.reshape(n, K).any(axis=1)
    todo = np.flatnonzero(~full & np.repeat(some, K))
    turn = 0
    while len(todo):  # an empty bin tries the same bins in every row
        turn += 1
        line, slot = np.divmod(todo, K)
        if turn > 8 * K:
            take = full.reshape(n, K)[line].argmax(axis=1)
        else:
            take = (mix(slot.astype(np.uint64) * _U(1_000_003) + _U(turn)) % _U(K)).astype(np.int64)
        source = line * K + take
        ok = full[source]
        sign[todo[ok]] = sign[source[ok]]
        todo = todo[~ok]
    return sign.reshape(n, K)


def bucket_keys(lines: Lines) -> np.ndarray:
    """Lines x BANDS keys."""
    out = [np.zeros((0, BANDS), _U)]
    for which in lines.pieces(np.arange(len(lines.size))):
        row, grams = lines.shingles(which)
        sign = signatures(row, mix(grams), len(which)).reshape(len(which), BANDS, ROWS).astype(_U)
        keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=_U)), (len(which), BANDS)).copy()
        for j in range(ROWS):
            keys = mix(keys + sign[:, :, j] * _U(0x9FB21C651E98DF25))
        out.append(keys)
    return np.concatenate(out)


class Sets:
    """The distinct shingles of some lines, each line's in ascending order, made once."""

    def __init__(self, lines: Lines, which: np.ndarray):
        self.place = np.zeros(len(lines.size), np.int64)
        order = which[np.argsort(lines.count[which], kind="stable")]
        self.place[order] = np.arange(len(order))
        kept, sizes = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(order):  # lines of like size are the rows of one matrix
            least = int(lines.count[order[at]])
            near = int(np.searchsorted(lines.count[order], least * 5 // 4 + 8, "right"))
            some = order[at : max(at + 1, min(near, at + max(1, PIECE // least)))]
            count = lines.count[some]
            nth, grams = lines.shingles(some)
            rows = np.full((len(some), int(count[-1])), _NONE)
            rows[nth, np.arange(len(nth)) - np.repeat(np.cumsum(count) - count, count)] = grams
            rows.sort(axis=1)
            new = rows != _NONE
            new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
            kept.append(rows[new])
            sizes.append(new.sum(axis=1))
            at += len(some)
        self.values, self.size = np.concatenate(kept), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size


def jaccard(lines: Lines, a: np.ndarray, b: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of pairs of lines. Of a pair whose sets' sizes show it to be below
    least, it's the bound that they set."""
    sets = Sets(lines, np.unique(np.concatenate([a, b])))
    a, b = sets.place[a], sets.place[b]
    low, high = np.minimum(sets.size[a], sets.size[b]), np.maximum(sets.size[a], sets.size[b])
    share = low / np.maximum(1, high)
    open_ = np.flatnonzero(share >= least)
    open_ = open_[np.argsort(b[open_], kind="stable")]
    total = np.cumsum(sets.size[a[open_]])
    last = np.flatnonzero(np.append(b[open_[1:]] != b[open_[:-1]], True)) + 1 if len(open_) else open_
    at = 0
    for end in last.tolist():  # all that are compared with the same line
        own = sets.values[sets.start[b[open_[at]]] :][: sets.size[b[open_[at]]]]
        while at < end:
            stop = max(at + 1, min(end, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE, "right"))))
            pairs = open_[at:stop]
            n = sets.size[a[pairs]]
            begin = np.cumsum(n) - n
            theirs = sets.values[np.arange(int(n.sum())) + np.repeat(sets.start[a[pairs]] - begin, n)]
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            shared = np.add.reduceat(hit, begin, dtype=np.int64)
            share[pairs] = shared / (n + len(own) - shared)
            at = stop
    return share


def _distinct(batch: pa.RecordBatch, places: bool) -> tuple[list[bytes], list[bytes], tuple[np.ndarray, ...]]:
    """Ids and lines of a batch's distinct lines; and if asked for, of each occurrence the line's place in these, doc_id
    and number, in order and once each."""
    ids: dict[bytes, int] = {}
    lines: list[bytes] = []
    node, doc, no = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for chunk in chunks(batch.column(1)):
        row, number, start, end = line_spans(chunk.data, chunk.offsets)
        raw = chunk.data.tobytes()
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            line = raw[s:e]
            i = ids.setdefault(xxhash.xxh3_128_digest(line), len(lines))
            if i == len(lines):
                lines.append(line)
            node.append(i)
        if places:
            doc.append(batch.column(0).slice(chunk.rows.start, chunk.n).to_numpy()[row])
            no.append(number)
    if not places:
        return list(ids), lines, ()
    nodes, docs, nos = np.array(node, np.int64), np.concatenate(doc), np.concatenate(no).astype(np.int32)
    order = np.lexsort((nos, docs, nodes))
    nodes, docs, nos = nodes[order], docs[order], nos[order]
    new = np.ones(len(nodes), bool)
    new[1:] = (nodes[1:] != nodes[:-1]) | (docs[1:] != docs[:-1]) | (nos[1:] != nos[:-1])
    return list(ids), lines, (nodes[new], docs[new], nos[new])


def _h(ids: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(ids), _U)[::2]


LINES = "h long, id binary, line string, docs array<long>, nos array<int>"


def _lines(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's distinct lines, with the places of each."""
    ids, lines, (nodes, docs, nos) = _distinct(batch, True)
    h = _h(ids).view(np.int64)
    bound = np.concatenate([[0], np.cumsum(np.bincount(nodes, minlength=len(ids)))]).astype(np.int32)
    for low in range(0, len(ids), 8192):  # rows that go back are bounded like those that came
        high = min(len(ids), low + 8192)
        lists = [pa.ListArray.from_arrays(pa.array(bound[low : high + 1] - bound[low]), pa.array(x[bound[low] : bound[high]])) for x in (docs, nos)]
        columns = [pa.array(h[low:high]), pa.array(ids[low:high], pa.binary()), pa.array(lines[low:high], pa.binary()).cast(pa.string()), *lists]
        yield pa.RecordBatch.from_arrays(columns, ["h", "id", "line", "docs", "nos"])


def _meeting(batch: pa.RecordBatch, parts: int, threshold: float) -> Iterator[pa.RecordBatch]:
    ids, lines, _ = _distinct(batch, False)
    if ids:
        some = Lines(lines)
        yield from meet_here(bucket_keys(some), ids, _h(ids), lambda a, b: jaccard(some, a, b, threshold), parts)


def _similar(batch: pa.RecordBatch, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of lines (bucket, a, la, b, lb) with the similarity of the two."""
    seen: dict[bytes, int] = {}
    texts: list[bytes] = []
    places = []
    for ids, lines in ((batch.column(1), batch.column(2)), (batch.column(3), batch.column(4))):
        found = [seen.setdefault(x, len(seen)) for x in ids.to_pylist()]
        new = np.unique(np.array(found, np.int64), return_index=True)
        first = new[1][new[0] >= len(texts)]
        texts += lines.take(pa.array(first)).cast(pa.binary()).to_pylist()
        places.append(np.array(found, np.int64))
    share = jaccard(Lines(texts), *places, threshold)
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(share)], ["bucket", "a", "b", "share"])


def duplicate_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no) of each line to drop, and the line of its component that stays."""
    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and length(text) > 0")
    lines = written(map_batches(rows, _lines, LINES), "line-texts")
    meeting = map_batches(rows, partial(_meeting, parts=shards(rows), threshold=threshold), MEETING)
    near = linked(meeting, lines.select("h", "id", F.col("line").alias("item")), partial(_similar, threshold=threshold), threshold, "line")
    groups = components(near, name="line-edges")
    # a root is the least node of its component, so it has no root of its own
    placed = lines.select("id", "docs", "nos").join(groups, F.col("id") == groups["node"], "left").select(F.coalesce("root", "id").alias("group"), "docs", "nos")
    placed = placed.withColumn("first", F.struct(F.get("docs", F.lit(0)).alias("doc_id"), F.get("nos", F.lit(0)).alias("line_no")))
    placed = written(placed, "line-places")
    kept = placed.groupBy("group").agg(F.min("first").alias("kept"), F.sum(F.size("docs")).alias("n")).filter("n > 1").select("group", "kept")
    all_of = placed.join(kept, "group").select("kept", F.explode(F.arrays_zip("docs", "nos")).alias("at"))
    gone = all_of.filter("not (at.docs = kept.doc_id and at.nos = kept.line_no)")
    out = gone.select(F.col("at.docs").alias("doc_id"), F.col("at.nos").alias("line_no"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"))
    return out.distinct()


def drop_duplicate_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the text rebuilt without the lines to drop; rows without any such line are as they were."""
    own, lost = unused(docs, "_id"), unused(docs, "_lost")
    gone = duplicate_lines(docs, threshold).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line_no").alias(lost))
    both = docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(lost, i)), "\n")
    return both.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
