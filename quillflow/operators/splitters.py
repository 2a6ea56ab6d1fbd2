"""Splitters: generators of child documents, which re-enter the pipeline. Children wait in an array column of their
parent's row, so the parent is computed once, and are exploded at the end of the pass."""

from __future__ import annotations

import csv
import io
import xml.sax
import xml.sax.handler
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import Any, ClassVar
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import model
from ..functions import dom
from .base import REGISTRY, Handler, register, text

Child = dict[str, Any]

#: Bytes of a batch that goes to a worker.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass(kw_only=True)
class Splitter(Handler):
    kind: ClassVar[str] = "splitter"
    #: Whether the parent keeps its content.
    keeps_content: ClassVar[bool] = True

    def function(self) -> Callable[[str, str, str | None, dict[str, list[str]]], list[Child]]:
        """From reference, content, type and metadata to children; it travels to the workers, so it holds plain values."""
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        """Runs over Arrow batches of whole rows: the optimizer can't move an exploded column's Python call, nor repeat it.
        They are bounded in bytes unless the session has a bound of its own, which stays set for when the rows are wanted."""
        if df.sparkSession.conf.get(_BATCH, None) is None:
            df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
        df = df.withColumn("_split", F.coalesce(self.guard(), F.lit(False)))
        schema = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
        return df.mapInArrow(partial(_split, function=self.function()), schema).drop("_split")


#: Rows, and bytes of a batch, that are split at once: their trees, children and copies of metadata are held together.
SPLIT_ROWS, SPLIT_BYTES = 256, 4 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and bytes, one row at least."""
    for batch in batches:
        step = max(1, min(SPLIT_ROWS, SPLIT_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _split(batches: Iterator[pa.RecordBatch], function: Callable) -> Iterator[pa.RecordBatch]:
    empty: Child = {"reference": None, "content": None, "raw": None, "content_type": None, "metadata": {}}
    for batch in pieces(batches):
        rows = np.flatnonzero(batch.column("_split").to_numpy(zero_copy_only=False))
        if len(rows):
            some = batch.take(pa.array(rows))
            at = batch.schema.get_field_index("children")
            kids = batch.column(at).to_pylist()
            parts = (some.column(c).to_pylist() for c in ("reference", "content", "content_type", "metadata"))
            for i, ref, content, kind, meta in zip(rows.tolist(), *parts, strict=True):
                known = {k: list(v or ()) for k, v in meta or ()}
                kids[i] = [*(kids[i] or ()), *(empty | x for x in function(ref, content or "", kind, known))]
            for child in (c for i in rows.tolist() for c in kids[i]):
                child["metadata"] = list(child["metadata"].items()) if isinstance(child["metadata"], dict) else child["metadata"]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(kids, batch.column(at).type))
        yield batch


@register
@dataclass(kw_only=True)
class CsvSplitter(Splitter):
    """A child for each record. Fields are named by the first row or columnN; the parent's metadata is inherited; the
    reference is the parent's, an exclamation mark, and a column's value or row-N, where N counts the header row."""

    separator_character: str = ","
    quote_character: str = '"'
    escape_character: str = "\\"
    use_first_row_as_fields: bool = False
    lines_to_skip: int = 0
    reference_column: str | None = None
    content_columns: list[str] = field(default_factory=list)

    def function(self):
        sep, quote, esc, first, skip, ref_col, content_cols = self.separator_character, self.quote_character, self.escape_character, self.use_first_row_as_fields, self.lines_to_skip, self.reference_column, list(self.content_columns)

        def run(ref: str, content: str, _: str | None, meta: dict[str, list[str]]) -> list[Child]:
            source = io.StringIO(content, newline="")
            for _line in range(skip):
                source.readline()
            names: list[str] = []
            children = []
            for n, row in enumerate(csv.reader(source, delimiter=sep, quotechar=quote or None, escapechar=esc if esc and esc != quote else None, doublequote=True)):
                if first and n == 0:
                    names = row
                    continue
                if not row:
                    continue
                fields = {k: list(v) for k, v in meta.items()}
                child_ref, body = f"row-{n + 1}", []
                for i, value in enumerate(row):
                    name = names[i] if i < len(names) else f"column{i + 1}"
                    position = str(i + 1)
                    if ref_col is not None and ref_col in (name, position) and value.strip():
                        child_ref = value
                    if name in content_cols or position in content_cols:
                        body.append(value)
                    else:
                        fields[name] = [*fields.get(name, []), value]
                fields[model.EMBEDDED_REFERENCE] = [child_ref]
                children.append({"reference": f"{ref}!{child_ref}", "content": " ".join(body), "content_type": "text/plain", "metadata": fields})
            return children

        return run


@register
@dataclass(kw_only=True)
class DOMSplitter(Splitter):
    """A child for each element that the selector hits, unless it is the whole document itself."""

    selector: str
    parser: str = "html"

    def function(self):
        selector, parser = self.selector, self.parser

        def run(ref: str, content: str, ctype: str | None, meta: dict[str, list[str]]) -> list[Child]:
            root = dom.parse(content, parser)
            tops = root.elements()
            found = [n for n in dom.select(root, selector) if not (len(tops) == 1 and n is tops[0])]
            out = []
            for n in found:
                path = dom.css_path(n)
                out.append({"reference": f"{ref}!{path}", "content": dom.outer_html(n), "content_type": ctype, "metadata": {**meta, model.EMBEDDED_REFERENCE: [path]}})
            return out

        return run


class _Paths(xml.sax.handler.ContentHandler):
    """Collects the markup of elements at one absolute path, reading the document as a stream."""

    def __init__(self, path: str):
        self.want, self.at, self.found = [x for x in path.split("/") if x], [], []
        self.parts: list[str] | None = None

    def startElement(self, name, attrs):
        self.at.append(name)
        if self.parts is None and self.at == self.want:
            self.parts = []
        if self.parts is not None:
            self.parts.append(f"<{name}" + "".join(f" {k}={quoteattr(v)}" for k, v in attrs.items()) + ">")

    def characters(self, content):
        if self.parts is not None and content.strip():
            self.parts.append(escape(content))

    def endElement(self, name):
        if self.parts is not None:
            self.parts.append(f"</{name}>")
            if self.at == self.want:
                self.found.append("".join(self.parts))
                self.parts = None
        self.at.pop()


def elements_at(content: str, path: str) -> list[str]:
    handler = _Paths(path)
    reader = xml.sax.make_parser()
    reader.setFeature(xml.sax.handler.feature_external_ges, False)
    reader.setContentHandler(handler)
    try:
        reader.parse(io.BytesIO(content.encode()))
    except xml.sax.SAXException:
        return handler.found if handler.found else []
    return handler.found


@register
@dataclass(kw_only=True)
class XMLStreamSplitter(Splitter):
    """A child for each element at an absolute path, such as /people/person."""

    path: str

    def function(self):
        path = self.path

        def run(ref: str, content: str, _: str | None, meta: dict[str, list[str]]) -> list[Child]:
            return [{"reference": f"{ref}!{i}", "content": x, "content_type": "text/xml", "metadata": {**meta, model.EMBEDDED_REFERENCE: [str(i)]}} for i, x in enumerate(elements_at(content, path))]

        return run


@register
@dataclass(kw_only=True)
class PageSplitter(Splitter):
    """A child for each page of text whose pages end with form feeds, as parsers of paged formats give it. A document of
    one page is only tagged with its number."""

    reference_page_prefix: str = "#"

    def function(self):
        prefix = self.reference_page_prefix

        def run(ref: str, content: str, ctype: str | None, meta: dict[str, list[str]]) -> list[Child]:
            pages = content.removesuffix("\f").split("\f")
            if len(pages) < 2 or "document.pdf.pageNumber" in meta:
                return []
            number = lambda n: {**meta, "document.pdf.pageNumber": [str(n)], "document.pdf.numberOfPages": [str(len(pages))]}
            return [{"reference": f"{ref}{prefix}{n}", "content": page, "content_type": ctype, "metadata": number(n)} for n, page in enumerate(pages, 1)]

        return run

    def apply(self, df: DataFrame) -> DataFrame:
        from ..functions.fields import put

        m = F.col("metadata")
        single = self.guard() & ~text().rlike(r"\f[\s\S]") & ~F.map_contains_key(m, F.lit("document.pdf.pageNumber")) & (F.col("content_type") == "application/pdf")
        tagged = put(put(m, "document.pdf.pageNumber", F.array(F.lit("1")), "replace"), "document.pdf.numberOfPages", F.array(F.lit("1")), "replace")
        df = super().apply(df)
        return df.withColumn("metadata", F.when(F.coalesce(single, F.lit(False)), tagged).otherwise(m))


PDFPageSplitter = PageSplitter
REGISTRY["PDFPageSplitter"] = PageSplitter


@register
@dataclass(kw_only=True)
class TranslatorSplitter(Splitter):
    """A child for each target language, by a translation function that the caller gives: (text, source, target) to
    text. The content goes to it in pieces of chunk_chars, cut at white space. Documents that are translations, or in
    the target language, get none."""

    translate: Callable[[str, str, str], str]
    target_languages: list[str]
    source_language: str | None = None
    source_language_field: str = model.LANGUAGE
    fields_to_translate: list[str] = field(default_factory=list)
    ignore_content: bool = False
    ignore_non_translated_fields: bool = False
    chunk_chars: int = 2000

    def function(self):
        translate, targets, source, source_field = self.translate, list(self.target_languages), self.source_language, self.source_language_field
        names, no_content, only, size = list(self.fields_to_translate), self.ignore_content, self.ignore_non_translated_fields, self.chunk_chars

        def pieces(x: str) -> list[str]:
            out = []
            while len(x) > size:
                cut = max(x.rfind(" ", 0, size), x.rfind("\n", 0, size)) + 1 or size
                out.append(x[:cut])
                x = x[cut:]
            return [*out, x] if x else out

        def run(ref: str, content: str, ctype: str | None, meta: dict[str, list[str]]) -> list[Child]:
            own = source or next(iter(meta.get(source_field, [])), None)
            if own is None or model.TRANSLATED_FROM in meta:
                return []
            out = []
            for target in targets:
                if target.lower() == own.lower():
                    continue
                tr = lambda x, t=target: "".join(translate(p, own, t) for p in pieces(x))
                fields = {} if only else {k: list(v) for k, v in meta.items()}
                fields |= {k: [tr(v) for v in meta[k]] for k in names if k in meta}
                fields |= {model.LANGUAGE: [target], model.TRANSLATED_FROM: [own], model.EMBEDDED_REFERENCE: [f"translation-{target}"]}
                out.append({"reference": f"{ref}!translation-{target}", "content": "" if no_content else tr(content), "content_type": ctype, "metadata": fields})
            return out

        return run
