"""The document row: one schema for files, table rows, streams and the children that splitters make."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, functions as F

META = "map<string,array<string>>"
CHILD = f"struct<reference:string,content:string,raw:binary,content_type:string,metadata:{META}>"

REFERENCE, CONTENT_TYPE, CONTENT_ENCODING, CONTENT_FAMILY = "document.reference", "document.contentType", "document.contentEncoding", "document.contentFamily"
EMBEDDED_PARENT, EMBEDDED_REFERENCE, EMBEDDED_INDEX = "document.embedded.parent.reference", "document.embedded.reference", "document.embedded.index"
IMPORTED_DATE, LANGUAGE, TRANSLATED_FROM, TITLE, UUID = "document.importedDate", "document.language", "document.translatedFrom", "document.generatedTitle", "document.uuid"

#: Working columns of a document row, in order, with the value each starts from.
COLUMNS: dict[str, tuple[str, Column | None]] = {
    "reference": ("string", None),
    "parent_refs": ("array<string>", None),
    "depth": ("int", None),
    "child_index": ("int", None),
    "content_type": ("string", None),
    "content_encoding": ("string", None),
    "raw": ("binary", None),
    "content": ("string", None),
    "metadata": (META, None),
    "rejected_by": ("string", None),
    "error": ("string", None),
    "has_include": ("boolean", None),
    "include_hit": ("boolean", None),
    "children": (f"array<{CHILD}>", None),
}


def empty_meta() -> Column:
    return F.create_map().cast(META)


def documents(df: DataFrame, reference: Column | str, content: Column | str | None = None, raw: Column | str | None = None, metadata: Mapping[str, Column | str] | Column | None = None, content_type: Column | None = None) -> DataFrame:
    """Rows of any table as documents. metadata: columns by field name, each a string or array of strings, or a map.

    A null value gives no field; neither content nor raw means empty content; a null reference is kept as an empty one.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    if isinstance(metadata, Column):
        meta = F.coalesce(metadata.cast(META), empty_meta())
    else:
        pairs = []
        for name, value in (metadata or {}).items():
            value = col(value)
            values = value if dict(df.select(value.alias("v")).dtypes)["v"].startswith("array") else F.array(value.cast("string"))
            pairs.append(F.struct(F.lit(name).alias("key"), F.filter(values.cast("array<string>"), lambda v: v.isNotNull()).alias("value")))
        meta = F.map_from_entries(F.filter(F.array(*pairs), lambda e: F.size(e["value"]) > 0)).cast(META) if pairs else empty_meta()
    body = F.lit("") if content is None and raw is None else F.lit(None) if content is None else col(content)
    start = {
        "reference": F.coalesce(col(reference).cast("string"), F.lit("")),
        "parent_refs": F.array().cast("array<string>"),
        "depth": F.lit(0),
        "child_index": F.lit(None),
        "content_type": F.lit(None) if content_type is None else content_type,
        "content_encoding": F.lit(None),
        "raw": F.lit(None) if raw is None else col(raw),
        "content": body,
        "metadata": meta,
        "rejected_by": F.lit(None),
        "error": F.lit(None),
        "has_include": F.lit(False),
        "include_hit": F.lit(False),
        "children": F.array().cast(COLUMNS["children"][0]),
    }
    return df.select(*(start[name].cast(kind).alias(name) for name, (kind, _) in COLUMNS.items()))


#: Names of boolean columns that hold handlers to a branch, the innermost last.
_BRANCHES: ContextVar[tuple[str, ...]] = ContextVar("branches", default=())


@contextmanager
def branch(flag: str) -> Iterator[None]:
    """While a branch is compiled, rows without its flag aren't active."""
    token = _BRANCHES.set((*_BRANCHES.get(), flag))
    try:
        yield
    finally:
        _BRANCHES.reset(token)


def free() -> Column:
    """Whether a row has no error and is in the branch that is being compiled."""
    on = F.col("error").isNull()
    for flag in _BRANCHES.get():
        on = on & F.col(flag)
    return on


def active() -> Column:
    """Whether handlers still work on a row."""
    return F.col("rejected_by").isNull() & free()


def rejected(where: Column, by: str) -> Column:
    """rejected_by after rejecting some rows. It names itself once, so that a filter on it stays small when pushed
    through many such steps."""
    return F.coalesce(F.col("rejected_by"), F.when(free() & where, F.lit(by)))


def status() -> Column:
    return F.when(F.col("error").isNotNull(), "ERROR").when(F.col("rejected_by").isNotNull(), "REJECTED").otherwise("IMPORTED")
