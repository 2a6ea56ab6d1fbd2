"""Parsers: raw bytes to text, metadata and embedded documents, for the formats that need no outside library."""

from __future__ import annotations

import base64
import csv
import gzip
import io
import json
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import model
from ..functions import dom
from ..functions.fields import put_map
from .detect import EXTENSIONS, decode, detect_charset, detect_type
from .pdf import parse_pdf

Meta = dict[str, list[str]]
#: text, metadata, embedded documents as (name, bytes)
Parsed = tuple[str, Meta, list[tuple[str, bytes]]]
Parser = Callable[[bytes, str | None, str], Parsed]


class Unsupported(ValueError):
    """No parser for this content here."""


#: Bytes that one compressed member may hold; more is an error of its document, not the end of a worker.
MOST_BYTES = 512 << 20


def xml_root(raw: bytes) -> ElementTree.Element:
    """The root of an XML document; entities of its own, which may expand without bound, are refused."""
    if re.search(rb"<!ENTITY", raw):
        raise Unsupported("XML with entities of its own")
    return ElementTree.fromstring(raw)


def unzipped(z: zipfile.ZipFile, name: str | zipfile.ZipInfo) -> bytes:
    with z.open(name) as f:
        out = f.read(MOST_BYTES + 1)
    if len(out) > MOST_BYTES:
        raise Unsupported(f"a member of more than {MOST_BYTES} bytes")
    return out


def gunzipped(raw: bytes) -> bytes:
    with gzip.GzipFile(fileobj=io.BytesIO(raw)) as f:
        out = f.read(MOST_BYTES + 1)
    if len(out) > MOST_BYTES:
        raise Unsupported(f"more than {MOST_BYTES} bytes")
    return out


def parse_text(raw: bytes, charset: str | None, name: str) -> Parsed:
    return decode(raw, charset) or "", {}, []


def parse_html(raw: bytes, charset: str | None, name: str) -> Parsed:
    root = dom.parse(decode(raw, charset) or "")
    meta: Meta = {}
    for node in root.walk():
        if node.tag == "title" and "title" not in meta:
            meta["title"] = meta["dc:title"] = [dom.text_of(node)]
        elif node.tag == "meta":
            key = node.attrs.get("name") or node.attrs.get("property") or node.attrs.get("http-equiv")
            if key and "content" in node.attrs:
                meta.setdefault(key, []).append(node.attrs["content"])
    body = next((n for n in root.walk() if n.tag == "body"), root)
    return _lines(body), meta, []


def _lines(node: dom.Node) -> str:
    """Text with a line for each block."""
    out: list[str] = []

    def walk(n: dom.Node) -> None:
        for c in n.children:
            if c.tag is None:
                if not c.data:
                    out.append(re.sub(r"\s+", " ", c.text))
            elif c.tag not in ("head", "title"):
                edge = c.tag in dom.BLOCK
                if edge:
                    out.append("\n")
                walk(c)
                if edge:
                    out.append("\n")

    walk(node)
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()


def parse_xml(raw: bytes, charset: str | None, name: str) -> Parsed:
    try:
        root = xml_root(raw)
        return re.sub(r"\s*\n\s*", "\n", "\n".join(t.strip() for t in root.itertext() if t.strip())), {}, []
    except (ElementTree.ParseError, Unsupported):
        return dom.text_of(dom.parse(decode(raw, charset) or "", "xml")), {}, []


def parse_csv(raw: bytes, charset: str | None, name: str) -> Parsed:
    return "\n".join("\t".join(row) for row in csv.reader(io.StringIO(decode(raw, charset) or "", newline=""))), {}, []


def parse_json(raw: bytes, charset: str | None, name: str) -> Parsed:
    text = decode(raw, charset) or ""
    json.loads(text)
    return text, {}, []


def parse_rtf(raw: bytes, charset: str | None, name: str) -> Parsed:
    """Plain text of RTF: groups that hold no text (fonts, colours, pictures and the like) are left out."""
    source, out, stack, skip, unicode_skip, pending = raw.decode("latin-1"), [], [], False, 1, 0
    codepage = "cp1252"
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "latentstyles", "listtable", "listoverridetable"}
    for m in re.finditer(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", source, re.I):
        word, number, code, symbol, brace, char = m.groups()
        if brace == "{":
            stack.append((skip, unicode_skip))
        elif brace == "}":
            if stack:
                skip, unicode_skip = stack.pop()
        elif symbol:
            if symbol == "*":
                skip = True
            elif not skip:
                out.append({"~": "\xa0", "\n": "\n", "\r": "\n"}.get(symbol, symbol if symbol in "{}\\" else ""))
        elif word:
            if word in hidden:
                skip = True
            elif word == "ansicpg":
                codepage = f"cp{number}"
            elif word == "uc":
                unicode_skip = int(number or 1)
            elif not skip:
                if word in ("par", "line", "page", "sect"):
                    out.append("\n")
                elif word == "tab":
                    out.append("\t")
                elif word == "u":
                    out.append(chr(int(number) % 65536))
                    pending = unicode_skip
                else:
                    out.append({"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}.get(word, ""))
        elif not skip and (code or char):
            if pending:
                pending -= 1
            else:
                out.append(char or bytes([int(code, 16)]).decode(codepage, "replace"))
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip(), {}, []


_CORE = {"title": "dc:title", "creator": "dc:creator", "subject": "dc:subject", "description": "dc:description", "language": "dc:language", "created": "dcterms:created", "modified": "dcterms:modified", "keywords": "meta:keyword", "lastModifiedBy": "meta:last-author"}
_OFFICE_PARTS = re.compile(r"word/(?:document|footnotes|endnotes|header\d*|footer\d*)\.xml|ppt/slides/slide(\d+)\.xml|ppt/notesSlides/notesSlide\d+\.xml|xl/sharedStrings\.xml|xl/worksheets/sheet\d+\.xml|content\.xml")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _office_text(source: bytes) -> str:
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        name = _local(e.tag)
        if name in ("t", "span", "a", "h", "p") and e.text:
            out.append(e.text)
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "line-break"):
            out.append("\n")
        for c in e:
            walk(c)
            if c.tail and name in ("p", "h", "span", "a"):
                out.append(c.tail)
        if name in ("p", "h", "si", "row"):
            out.append("\n")

    walk(xml_root(source))
    return "".join(out)


def _natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def _sheet_text(source: bytes, strings: list[str]) -> str:
    rows = []
    for row in xml_root(source).iter():
        if _local(row.tag) == "row":
            cells = []
            for c in row:
                value = next((x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t")), "")
                cells.append(strings[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(strings) else value)
            rows.append("\t".join(cells))
    return "\n".join(rows)


def parse_zipped_office(raw: bytes, charset: str | None, name: str) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted(z.namelist(), key=_natural)
        meta: Meta = {}
        for part in ("docProps/core.xml", "docProps/app.xml", "meta.xml"):
            if part in names:
                for e in xml_root(unzipped(z, part)).iter():
                    if e.text and e.text.strip() and _local(e.tag) in _CORE:
                        meta.setdefault(_CORE[_local(e.tag)], []).append(e.text.strip())
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in xml_root(unzipped(z, "xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        parts = []
        for part in names:
            if part.startswith("xl/worksheets/sheet"):
                parts.append(_sheet_text(unzipped(z, part), strings))
            elif part != "xl/sharedStrings.xml" and _OFFICE_PARTS.fullmatch(part):
                parts.append(_office_text(unzipped(z, part)))
        embedded = [(x, unzipped(z, x)) for x in names if re.search(r"/(?:media|embeddings)/[^/]+$|^Pictures/[^/]+$", x)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(parts)).strip(), meta, embedded


def parse_zip(raw: bytes, charset: str | None, name: str) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return "", {}, [(x.filename, unzipped(z, x)) for x in z.infolist() if not x.is_dir()]


def parse_gzip(raw: bytes, charset: str | None, name: str) -> Parsed:
    return "", {}, [(re.sub(r"\.gz$", "", name.rsplit("/", 1)[-1]) or "embedded-1", gunzipped(raw))]


def parse_xfdl(raw: bytes, charset: str | None, name: str) -> Parsed:
    """A form: plain XML, or a line that names the type and base64 of gzip below it."""
    if raw.lstrip().startswith(b"application/vnd.xfdl"):
        raw = gunzipped(base64.b64decode(raw.split(b"\n", 1)[1]))
    root = xml_root(raw)
    title = next((e.text for e in root.iter() if _local(e.tag) == "title" and e.text), None)
    out = [(v.text or "").strip() for f in root.iter() if _local(f.tag) == "field" for v in f if _local(v.tag) == "value"]
    return "\n".join(x for x in out if x), ({"title": [title]} if title else {}), []


def parse_eml(raw: bytes, charset: str | None, name: str) -> Parsed:
    from email import message_from_bytes
    from email.policy import default

    mail = message_from_bytes(raw, policy=default)
    meta = {k: [str(v)] for k, v in (("dc:title", mail["subject"]), ("Message-From", mail["from"]), ("Message-To", mail["to"])) if v}
    body = mail.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = parse_html(text.encode(), "UTF-8", name)[0]
    return text.strip(), meta, [(a.get_filename() or f"embedded-{i}", a.get_payload(decode=True) or b"") for i, a in enumerate(mail.iter_attachments(), 1)]


_OFFICE = tuple(EXTENSIONS[x] for x in ("docx", "docm", "dotx", "xlsx", "xlsm", "pptx", "ppsx", "odt", "ods", "odp"))
#: Names of embedded documents that a merged text lacks, with their types.
UNPARSED = "document.embedded.unparsed"
PARSERS: list[tuple[str, Parser]] = [
    (r"text/html|application/xhtml\+xml|application/vnd\.wap\.xhtml\+xml", parse_html), (r"text/csv|text/tab-separated-values", parse_csv), (r"application/json", parse_json), (r"application/rtf|text/rtf", parse_rtf),
    (r"application/vnd\.xfdl", parse_xfdl), ("|".join(map(re.escape, _OFFICE)), parse_zipped_office), (r"application/zip|application/epub\+zip", parse_zip), (r"application/gzip", parse_gzip), (r"message/rfc822", parse_eml),
    (r"application/pdf", parse_pdf), (r"(?:application|text)/(?:[\w.-]+\+)?xml|image/svg\+xml", parse_xml), (r"text/.*|application/javascript", parse_text),
]


@dataclass
class ParserFactory:
    """Parser by content type. Types that the ignored pattern matches keep their content as it is.

    Embedded documents are merged into their container's text and metadata, unless split_types matches the container's
    type, which makes them children. no_extract_containers and no_extract_embedded leave them out. Other patterns are
    regular expressions on whole types. parsers: functions of the caller's by pattern, tried first; this is also where
    OCR and the like are plugged in. Content without a parser gives the row an error, never made-up text; an embedded
    document without one, or deeper than max_embedded_depth when merged, is named in the field UNPARSED.
    """

    ignored_types: str | None = None
    split_types: str | None = None
    no_extract_containers: str | None = None
    no_extract_embedded: str | None = None
    parsers: list[tuple[str, Parser]] = field(default_factory=list)
    dc_policy: str = "both"
    max_embedded_depth: int = 200

    def splits(self) -> bool:
        return bool(self.split_types)

    def parser_of(self, kind: str) -> Parser | None:
        return next((p for pattern, p in [*self.parsers, *PARSERS] if re.fullmatch(pattern, kind)), None)

    def names(self, meta: Meta) -> Meta:
        """Dublin Core names: preserve them, take the prefix off (legacy), or both."""
        out: Meta = {}
        for k, found in meta.items():
            plain = k.removeprefix("dc:")
            keys = [k] if not k.startswith("dc:") or self.dc_policy == "preserve" else [plain] if self.dc_policy == "legacy" else [k, plain]
            for key in keys:
                mine = out.setdefault(key, [])
                mine += [v for v in found if v not in mine]
        return out

    def parse_one(self, raw: bytes, kind: str, charset: str | None, name: str, depth: int = 0) -> tuple[str, Meta, list[dict[str, Any]]]:
        parser = self.parser_of(kind)
        if parser is None:
            raise Unsupported(f"no parser for {kind}")
        text, meta, embedded = parser(raw, charset, name)
        meta = self.names(meta)
        children: list[dict[str, Any]] = []
        if embedded and not (self.no_extract_containers and re.fullmatch(self.no_extract_containers, kind)):
            for i, (inner_name, inner) in enumerate(embedded):
                inner_kind = detect_type(inner, inner_name)
                if self.no_extract_embedded and re.fullmatch(self.no_extract_embedded, inner_kind):
                    continue
                short = inner_name.rsplit("/", 1)[-1] or f"embedded-{i + 1}"
                if self.split_types and re.fullmatch(self.split_types, kind):
                    fields = {model.EMBEDDED_REFERENCE: [short], "document.embedded.type": ["package-file" if "zip" in kind else "file-file"]}
                    children.append({"reference": f"{name}!{short}", "content": None, "raw": inner, "content_type": inner_kind, "metadata": fields})
                elif depth < self.max_embedded_depth and self.parser_of(inner_kind):
                    more, fields, below = self.parse_one(inner, inner_kind, None, f"{name}!{short}", depth + 1)
                    text = f"{text}\n{more}".strip()
                    for k, v in fields.items():
                        meta.setdefault(k, []).extend(x for x in v if x not in meta[k])
                    meta.setdefault("Content-Type", []).extend(x for x in [inner_kind] if x not in meta.get("Content-Type", []))
                    children += below
                else:
                    why = inner_kind if depth < self.max_embedded_depth else f"deeper than {depth} levels"
                    meta.setdefault(UNPARSED, []).append(f"{short} ({why})")
        return text, meta, children

    def parse(self, df: DataFrame) -> DataFrame:
        me, ignored = self, self.ignored_types

        @F.pandas_udf(f"text string, fields {model.META}, children {model.COLUMNS['children'][0]}, error string")
        def run(on: pd.Series, raw: pd.Series, kind: pd.Series, charset: pd.Series, ref: pd.Series) -> pd.DataFrame:
            def one(ok: bool, x: bytes | None, k: str, c: str | None, r: str) -> tuple:
                if not ok:
                    return None, {}, [], None
                try:
                    return *me.parse_one(bytes(x or b""), k, c or detect_charset(x or b""), r), None
                except Exception as e:  # a document that can't be parsed is an error of its row, not of the query
                    return None, {}, [], f"{type(e).__name__}: {e}"[:500]

            return pd.DataFrame([one(*x) for x in zip(on, raw, kind, charset, ref, strict=True)], columns=["text", "fields", "children", "error"])

        size = F.coalesce(F.length("raw"), F.octet_length("content"), F.lit(0))
        wanted = model.active() & (size > 0)
        if ignored:
            wanted = wanted & ~F.col("content_type").rlike(f"\\A(?:{ignored})\\z")
        plain = F.col("raw").isNull() & (F.col("content_type") == "text/plain") & F.lit(not self.parsers)
        df = df.withColumn("_on", wanted & ~plain)
        df = df.withColumn("_p", run("_on", F.when(F.col("_on"), F.coalesce("raw", F.encode("content", "UTF-8"))), "content_type", F.when(F.col("raw").isNull(), F.lit("UTF-8")).otherwise(F.col("content_encoding")), "reference"))
        ok = F.col("_on") & F.col("_p.error").isNull()
        change = {
            "content": F.when(ok, F.coalesce("_p.text", F.lit(""))).otherwise(F.col("content")),
            "metadata": F.when(ok, put_map(F.col("metadata"), F.col("_p.fields"), "append")).otherwise(F.col("metadata")),
            "children": F.when(ok, F.concat("children", F.col("_p.children"))).otherwise(F.col("children")),
            "error": F.coalesce("error", "_p.error"),
            "raw": F.when(~ok, F.col("raw")),
        }
        return df.withColumns(change).drop("_on", "_p")
