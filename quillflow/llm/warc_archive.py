"""Operator 4: a content-addressed archive of WARC records.

read_warc() gives the records of WARC files. archive() splits records into headers, one row each and byte for byte as given, and payloads, each distinct payload
once under its SHA-256 digest. reconstruct() joins the two and gives every original record back, after computing the
digest and the length of the stored payload anew. The payload moves through one shuffle, on its digest, after copies
within a task are dropped; the join needs no further exchange of it.

Defined results: repeated records stay repeated. An empty payload is stored like any other; a null one has a null
digest, isn't stored, and comes back null with a null record. A null header is an empty one. Null keys and null other
columns pass through. Columns besides the named ones aren't read. Empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .textcore import BATCH_BYTES, map_batches

CRLF = "\r\n"


def header_of(url: Column, key: Column, payload: Column) -> Column:
    """The header lines of a WARC/1.1 resource record that holds a fetched page."""
    lines = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.coalesce(F.octet_length(payload), F.lit(0)).cast("string")),
    ]
    return F.concat_ws(CRLF, *lines)


def records(pages: DataFrame) -> DataFrame:
    """(record_id, header, payload) of the pages table."""
    payload = F.col("html").cast("string")
    return pages.select(F.col("page_id").alias("record_id"), header_of(F.col("url"), F.col("page_id"), payload).alias("header"), payload.cast("binary").alias("payload"))


def _inflated(raw: bytes) -> bytes:
    """The members of a gzip file, one after the other; other bytes as they are."""
    if not raw.startswith(b"\x1f\x8b"):
        return raw
    out = []
    while raw.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        raw = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def records_of(raw: bytes) -> Iterator[tuple[str | None, bytes, bytes | None, str | None]]:
    """Record id, header, payload and error of each record of a WARC file. A header is kept byte for byte, without the
    empty line behind it; what can't be read on from ends the file with an error."""
    try:
        raw = _inflated(raw)
    except zlib.error as e:
        yield None, b"", None, f"gzip: {e}"
        return
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        head = raw[at:end] if end >= 0 else raw[at:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
        size = fields.get(b"content-length", b"")
        name = fields[b"warc-record-id"].decode("utf-8", "replace") if b"warc-record-id" in fields else None
        if end < 0 or not head.startswith(b"WARC/") or not size.isdigit():
            yield name, head[:4096], None, f"no record at byte {at}"
            return
        begin, stop = end + 4, end + 4 + int(size)
        if stop > len(raw):
            yield name, head, None, f"the record at byte {at} is cut off"
            return
        yield name, head, raw[begin:stop], None
        at = stop + 4 if raw[stop : stop + 4] == b"\r\n\r\n" else stop


def _read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string())
    names = ["path", "record_id", "header", "payload", "error"]
    for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        rows, size = [], 0
        for name, head, payload, error in records_of(raw.as_py() or b""):
            rows.append((path, name, head, payload, error))
            size += len(head) + len(payload or b"")
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_id, header, payload, error) of the records of .warc and .warc.gz files, of up to 2 GB each, as
    archive() takes them where error is null."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").option("recursiveFileLookup", "true").load(path)
    return map_batches(found.select("path", "content"), _read, "path string, record_id string, header binary, payload binary, error string")


def archive(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """headers (record_id, header, digest, length) and payloads (digest, length, payload)."""
    digest = F.sha2("payload", 256)
    kind = recs.schema["header"].dataType.simpleString()
    headers = recs.select("record_id", F.coalesce("header", F.lit("").cast(kind)).alias("header"), digest.alias("digest"), F.octet_length("payload").alias("length"))
    stored = recs.filter("payload is not null").select(digest.alias("digest"), "payload")
    payloads = stored.groupBy("digest").agg(F.first("payload").alias("payload"))
    return headers, payloads.select("digest", F.octet_length("payload").alias("length"), "payload")


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(record_id, digest, length, verified, record): the records' bytes, and whether digest and length hold."""
    stored = payloads.select("digest", F.col("length").alias("stored_length"), "payload")
    both = headers.join(stored, "digest", "left")
    end = F.lit(CRLF * 2).cast("binary")
    record = F.concat(F.col("header").cast("binary"), end, F.col("payload"), end)
    holds = (F.sha2("payload", 256) == F.col("digest")) & (F.col("stored_length") == F.col("length")) & (F.octet_length("payload") == F.col("length"))
    return both.select("record_id", "digest", "length", F.coalesce(holds, F.col("digest").isNull()).alias("verified"), record.alias("record"))


def write_archive(recs: DataFrame, path: str) -> None:
    """Stores the archive under a folder; payloads are ordered by digest within files, so lookups skip row groups."""
    headers, payloads = archive(recs)
    headers.write.parquet(f"{path}/headers")
    payloads.sortWithinPartitions("digest").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return reconstruct(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, archived and rebuilt; the bytes are text here, as the pages are."""
    back = reconstruct(*archive(records(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
    return back.select(F.col("record_id").alias("page_id"), "digest", F.col("length").cast("long").alias("length"), "verified", F.decode("record", "UTF-8").alias("record"))


ORACLE = """
WITH r AS (
  SELECT page_id, html, CAST(octet_length(encode(html)) AS BIGINT) AS length, chr(13) || chr(10) AS nl FROM pages)
SELECT page_id, sha256(html) AS digest, length, true AS verified,
  'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || nl
  || 'WARC-Target-URI: ' || coalesce(p.url, '') || nl || 'Content-Type: text/html' || nl
  || 'Content-Length: ' || CAST(length AS VARCHAR) || nl || nl || html || nl || nl AS record
FROM r JOIN (SELECT page_id, url FROM pages) p USING (page_id)
"""
