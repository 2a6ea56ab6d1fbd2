"""Sources: files, tables, streams and the empty document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import model
from ..stored import spread


def files(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Files as documents: the path is the reference, the bytes are raw. Missing paths raise when the plan is made;
    files without a byte are passed over by the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return model.documents(reader.load(path), "path", raw="content")


def file_stream(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """New files of a folder as they arrive."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return model.documents(reader.load(path), "path", raw="content")


def table(df: DataFrame, reference: str | Column, content: str | Column, metadata: dict[str, str | Column] | Column | None = None, content_type: str | None = None) -> DataFrame:
    """Rows of a table, a stream included, as documents whose content is a text column."""
    return model.documents(spread(df, few=True), reference, content, metadata=metadata, content_type=None if content_type is None else F.lit(content_type))


def empty(spark: SparkSession, reference: str) -> DataFrame:
    """One document without content."""
    return model.documents(spark.range(1), F.lit(reference))
