"""Sinks: contents and metadata as files or tables, status lines, and the rows that failed."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import model


def status_lines(df: DataFrame) -> DataFrame:
    """(reference, status, detail) of every document."""
    return df.select("reference", model.status().alias("status"), F.coalesce("error", "rejected_by").alias("detail"))


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(model.status().alias("status")).agg(F.count("*").alias("documents"))


def events(df: DataFrame) -> DataFrame:
    """(reference, depth, event, by) of what happened to each document: imported, rejected (by a filter) or failed (with
    the error), and for a parent split into how many children."""
    own = df.select("reference", "depth", F.lower(F.when(model.status() == "ERROR", "failed").otherwise(model.status())).alias("event"), F.coalesce("error", "rejected_by").alias("by"))
    kids = df.filter("depth > 0").groupBy(F.element_at("parent_refs", -1).alias("reference"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").cast("string").alias("by"))
    return own.union(kids.select("reference", "depth", F.lit("split").alias("event"), "by"))


def write_report(report: DataFrame, path: str, samples: int = 3) -> None:
    """A field report as one CSV file with a header: field, occurrences and a column for each sample. It has a row for
    each field, so it's small however many documents there are."""
    columns = [F.get("samples", F.lit(i)).alias(f"sample{i + 1}") for i in range(samples)]
    report.select("field", *(["occurrences"] if "occurrences" in report.columns else []), *columns).orderBy("field").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def metadata_json() -> Column:
    return F.to_json("metadata")


def write_tables(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Imported documents as one table of contents and metadata, and the others as one of statuses."""
    imported = df.filter(model.active())
    imported.select("reference", "parent_refs", "depth", "content", metadata_json().alias("metadata")).write.format(format).save(f"{path}/imported")
    status_lines(df.filter(~model.active())).write.format(format).save(f"{path}/other")


def quarantine(df: DataFrame, path: str) -> None:
    """Documents with an error, whole, for another try."""
    df.filter(F.col("error").isNotNull()).select("reference", "error", "content_type", "raw", "content", metadata_json().alias("metadata")).write.mode("append").parquet(path)


def properties_text(meta: dict[str, list[str]]) -> str:
    from ..operators.external import dump

    return dump(meta, "properties")


def output_name(reference: str, depth: int, index: int | None, folder: str, suffix: str = "-imported.txt") -> str:
    """A file name for a document: that of its reference and a digest of the whole of it, since many folders may have a
    file of that name; children have depth and index before the extension."""
    base = re.sub(r"[^\w.-]+", "_", reference.split("!", 1)[0].rsplit("/", 1)[-1]) or "document"
    digest = hashlib.sha256(reference.encode()).hexdigest()[:16]
    stem, dot, ext = f"{base}{suffix}".rpartition(".")
    nth = f"_{depth}-{index}" if depth else ""
    return os.path.join(folder, f"{stem}{nth}-{digest}{dot}{ext}")


def write_files(df: DataFrame, folder: str, metadata_format: str = "properties", name: Callable[..., str] = output_name) -> None:
    """A file of content and one of metadata for each imported document, written by the tasks into a shared folder."""

    def write(rows) -> None:
        from ..operators.external import dump

        for r in rows:
            path = name(r.reference, r.depth, r.child_index, folder)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(r.content or "")
            meta = {k: list(v) for k, v in json.loads(r.meta).items()}
            with open(f"{path}.{'properties' if metadata_format == 'properties' else metadata_format}", "w", encoding="utf-8") as f:
                f.write(dump(meta, metadata_format))

    df.filter(model.active()).select("reference", "depth", "child_index", "content", metadata_json().alias("meta")).foreachPartition(write)
