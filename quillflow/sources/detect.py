"""Content types, families and character sets of documents."""

from __future__ import annotations

import codecs
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import model

#: Bytes that detection looks at; a zip's directory needs the whole file.
HEAD = 4096

EXTENSIONS = {
    "txt": "text/plain", "text": "text/plain", "log": "text/plain", "md": "text/plain", "csv": "text/csv", "tsv": "text/tab-separated-values", "htm": "text/html", "html": "text/html",
    "xhtml": "application/xhtml+xml", "xml": "application/xml", "rss": "application/rss+xml", "atom": "application/atom+xml", "svg": "image/svg+xml", "json": "application/json", "rtf": "application/rtf",
    "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "7z": "application/x-7z-compressed", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "doc": "application/msword", "dot": "application/msword", "xls": "application/vnd.ms-excel",
    "ppt": "application/vnd.ms-powerpoint", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docm": "application/vnd.ms-word.document.macroenabled.12",
    "dotx": "application/vnd.openxmlformats-officedocument.wordprocessingml.template", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsm": "application/vnd.ms-excel.sheet.macroenabled.12",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "ppsx": "application/vnd.openxmlformats-officedocument.presentationml.slideshow", "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation", "epub": "application/epub+zip", "mp3": "audio/mpeg", "wav": "audio/x-wav", "mp4": "video/mp4",
    "xfdl": "application/vnd.xfdl", "js": "application/javascript", "css": "text/css", "eml": "message/rfc822", "msg": "application/vnd.ms-outlook", "vsd": "application/vnd.visio", "pub": "application/x-mspublisher",
    "wpd": "application/vnd.wordperfect", "qpw": "application/x-quattro-pro", "wb3": "application/x-quattro-pro",
}
_MAGIC = [
    (b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"), (b"II*\x00", "image/tiff"), (b"MM\x00*", "image/tiff"),
    (b"\x1f\x8b", "application/gzip"), (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"), (b"{\\rtf", "application/rtf"), (b"\xff\x57\x50\x43", "application/vnd.wordperfect"), (b"ID3", "audio/mpeg"), (b"SQLite format 3\x00", "application/x-sqlite3"),
    (b"application/vnd.xfdl", "application/vnd.xfdl"),
]
_OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_OLE_STREAMS = [("WordDocument", "application/msword"), ("Workbook", "application/vnd.ms-excel"), ("Book", "application/vnd.ms-excel"), ("PowerPoint Document", "application/vnd.ms-powerpoint"), ("VisioDocument", "application/vnd.visio"), ("__substg1.0_", "application/vnd.ms-outlook"), ("Quill", "application/x-mspublisher"), ("NativeContent_MAIN", "application/x-quattro-pro")]
_OOXML = [("wordprocessingml", "docx"), ("spreadsheetml", "xlsx"), ("presentationml", "pptx")]
_GENERIC = frozenset({"application/zip", "application/x-tika-ooxml", "application/x-tika-msoffice", "application/octet-stream", "text/plain", "application/xml", "application/gzip"})

FAMILIES = [
    ("html", ("text/html", "application/xhtml+xml", "application/vnd.wap.xhtml+xml")), ("pdf", ("application/pdf",)), ("csv", ("text/csv",)),
    ("wordprocessor", ("application/msword", "application/rtf", "application/vnd.wordperfect", "application/vnd.oasis.opendocument.text", EXTENSIONS["docx"], EXTENSIONS["docm"], EXTENSIONS["dotx"])),
    ("spreadsheet", ("application/vnd.ms-excel", EXTENSIONS["xlsx"], EXTENSIONS["xlsm"], EXTENSIONS["ods"], "application/x-quattro-pro")),
    ("presentation", ("application/vnd.ms-powerpoint", EXTENSIONS["pptx"], EXTENSIONS["ppsx"], EXTENSIONS["odp"])),
    ("archive", ("application/zip", "application/gzip", "application/x-tar", "application/x-7z-compressed")), ("email", ("message/rfc822", "application/vnd.ms-outlook")),
    ("ebook", ("application/epub+zip",)), ("diagram", ("application/vnd.visio",)), ("publishing", ("application/x-mspublisher",)), ("form", ("application/vnd.xfdl",)),
    ("feed", ("application/rss+xml", "application/atom+xml")), ("xml", ("application/xml", "text/xml")),
]


def extension(name: str | None) -> str:
    m = re.search(r"\.([A-Za-z0-9]{1,5})(?:[?#].*)?$", name or "")
    return m[1].lower() if m else ""


def detect_type(raw: bytes, name: str | None = None) -> str:
    """The type by content, refined by the name where the content tells only a container or plain text."""
    by_name = EXTENSIONS.get(extension(name))
    found = _by_content(raw)
    if found in _GENERIC and by_name and not (found == "text/plain" and not by_name.startswith(("text/", "application/json", "application/javascript", "message/"))):
        return by_name
    return found


def _by_content(raw: bytes) -> str:
    if not raw:
        return "text/plain"
    for magic, kind in _MAGIC:
        if raw.startswith(magic):
            return kind
    if raw.startswith(_OLE):
        for stream, kind in _OLE_STREAMS:
            if stream.encode("utf-16-le") in raw:
                return kind
        return "application/x-tika-msoffice"
    if raw.startswith(b"PK\x03\x04"):
        return _zip_type(raw)
    if raw.startswith(b"RIFF") and raw[8:12] == b"WEBP":
        return "image/webp"
    if raw.startswith((codecs.BOM_UTF8, codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        head = raw[:HEAD].decode(detect_charset(raw), "ignore")
    else:
        if b"\x00" in raw[:HEAD]:
            return "application/octet-stream"
        head = raw[:HEAD].decode("latin-1")
    start = head.lstrip("\ufeff \t\r\n").lower()
    if re.match(r"<!doctype\s+html|<html[\s>]|<head[\s>]|<body[\s>]", start) or re.match(r"<(?:!--|title|table|div|p|h1|a|script)[\s>]", start):
        return "text/html"
    if start.startswith("<?xml") or re.match(r"<[a-z_][\w.:-]*(?:\s[^<>]*)?>", start):
        body = re.sub(r"\A<\?xml.*?\?>\s*(?:<!--.*?-->\s*|<!doctype[^>]*>\s*)*", "", start, flags=re.S)
        for root, kind in (("<html", "application/xhtml+xml"), ("<rss", "application/rss+xml"), ("<rdf:rdf", "application/rdf+xml"), ("<feed", "application/atom+xml"), ("<svg", "image/svg+xml"), ("<xfdl", "application/vnd.xfdl")):
            if body.startswith(root):
                return kind
        return "application/xml"
    return "text/plain"


def _zip_type(raw: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = set(z.namelist())
            if "mimetype" in names:
                return z.read("mimetype").decode("ascii", "ignore").strip() or "application/zip"
            if "[Content_Types].xml" in names:
                types = z.read("[Content_Types].xml").decode("utf-8", "ignore")
                for word, ext in _OOXML:
                    if word in types:
                        return EXTENSIONS[ext]
                return "application/x-tika-ooxml"
    except (zipfile.BadZipFile, OSError, RuntimeError):
        pass
    return "application/zip"


def family(kind: str | None) -> str | None:
    if not kind:
        return None
    for name, kinds in FAMILIES:
        if kind in kinds:
            return name
    top = kind.split("/")[0]
    return top if top in ("text", "image", "audio", "video") else "other"


def family_column(c: Column) -> Column:
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, kinds in FAMILIES:
        out = out.when(c.isin(list(kinds)), name)
    top = F.substring_index(c, "/", 1)
    return out.when(top.isin("text", "image", "audio", "video"), top).otherwise("other")


def clean_charset(name: str | None) -> str | None:
    try:
        return codecs.lookup((name or "").strip().strip("\"'")).name.upper().replace("_", "-") if name else None
    except LookupError:
        return None


def detect_charset(raw: bytes, declared: str | None = None) -> str:
    """Byte-order mark, then a declaration that fits, then UTF-8 if valid, then a declaration in the markup, then the
    single-byte set of Western Europe."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16"), (codecs.BOM_UTF16_BE, "UTF-16")):
        if raw.startswith(mark):
            return name

    def fits(name: str) -> bool:
        try:
            raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            return False
        return True

    hint = clean_charset(declared)
    if hint and fits(hint):
        return hint
    if fits("utf-8"):
        return "UTF-8"
    m = re.search(rb"charset\s*=\s*[\"']?\s*([\w.:-]+)|encoding\s*=\s*[\"']([\w.:-]+)", raw[:HEAD], re.I)
    inside = clean_charset((m[1] or m[2]).decode("ascii", "ignore")) if m else None
    if inside and fits(inside):
        return inside
    return guess_charset(raw)


#: Character sets without a mark, with the scripts that text in them is mostly of.
_WIDE = (("EUC-JP", "jp"), ("SHIFT_JIS", "jp"), ("EUC-KR", "kr"), ("GB18030", "cn"), ("BIG5", "cn"))
_NARROW = (("WINDOWS-1251", "Ѐ-ӿ"), ("KOI8-R", "Ѐ-ӿ"), ("ISO-8859-5", "Ѐ-ӿ"), ("IBM866", "Ѐ-ӿ"), ("WINDOWS-1253", "Ͱ-Ͽ"), ("WINDOWS-1256", "؀-ۿ"))
_SCRIPT = {"jp": re.compile("[\u3040-\u30ff]"), "kr": re.compile("[\uac00-\ud7a3]"), "cn": re.compile("[\u4e00-\u9fff]")}
#: The most usual characters of Chinese text, which bytes of other sets seldom decode to.
_USUAL = frozenset("的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长知民样现分将外但身些與這國來個會們時說學為對後還發經")


def guess_charset(raw: bytes) -> str:
    """The character set of bytes that are not UTF-8 and name none, by how text in a script looks: of characters of more
    bytes, most are of one script's usual ones; words of one byte a letter don't mix scripts or cases. Else the single-byte
    set of Western Europe."""
    high = len(re.findall(rb"[\x80-\xff]", raw))
    best, best_score = None, 0.6
    for name, script in _WIDE:
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        wide = [c for c in text if c > "\x7f"]
        hits = sum(c in _USUAL for c in wide) * 2.5 if script == "cn" else len(_SCRIPT[script].findall(text)) * (1.6 if script == "jp" else 1.0)
        score = min(1.0, hits / max(1, len(wide))) * min(1.0, 2 * len(wide) / max(1, high) * 1.0)
        if score > best_score:
            best, best_score = name, score
    for name, letters in _NARROW:
        text = raw.decode(name, "replace")
        words = [w for w in re.findall(r"[^\W\d_]+", text) if any(c > "\x7f" for c in w)]
        marked = sum(map(len, words))
        other = sum(c > "\x7f" and not c.isspace() for c in text) - sum(c > "\x7f" for w in words for c in w)
        pure = sum(len(w) for w in words if len(w) > 1 and re.fullmatch(f"[{letters}]+", w) and (w.islower() or w.isupper() or w[1:].islower() or not w.upper() != w.lower()))
        lower = sum(c.islower() for w in words for c in w) / max(1, marked) if letters[0] in "ЀͰ" else 1.0
        score = pure / max(1, marked + 2 * other) * (0.6 + 0.4 * lower)
        if score > best_score:
            best, best_score = name, score
    return best or ("WINDOWS-1252" if re.search(rb"[\x80-\x9f]", raw) else "ISO-8859-1")


def decode(raw: bytes | None, charset: str | None) -> str | None:
    if raw is None:
        return None
    name = clean_charset(charset) or detect_charset(raw)
    return raw.decode(name, "replace").removeprefix("\ufeff")


def decoded(raw: Column, charset: Column) -> Column:
    """Bytes as text; bad bytes become replacement characters, an unknown or null character set is detected."""

    @F.pandas_udf("string")
    def run(r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([decode(x, n) for x, n in zip(r, c, strict=True)], dtype=object)

    return run(raw, charset)


def prepare(df: DataFrame) -> DataFrame:
    """Content type, encoding and family of rows, with the four reserved fields. Rows that come as text need no Python:
    their type is the given one, else by the reference's extension, else plain text."""
    by_name = F.lit(None).cast("string")
    ext = F.lower(F.regexp_extract("reference", r"\.([A-Za-z0-9]{1,5})(?:[?#].*)?$", 1))
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    by_name = F.coalesce(F.try_element_at(table, ext), F.lit("text/plain"))

    @F.pandas_udf("kind string, charset string")
    def of_raw(raw: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if x is None else (detect_type(x, n), detect_charset(x)) for x, n in zip(raw, name, strict=True)]
        return pd.DataFrame(rows, columns=["kind", "charset"])

    if isinstance(df.schema["raw"].dataType, type(None)) or _always_null(df, "raw"):
        kind, charset = F.coalesce("content_type", by_name), F.coalesce("content_encoding", F.lit("UTF-8"))
    else:
        df = df.withColumn("_seen", of_raw("raw", "reference"))
        kind = F.coalesce("content_type", "_seen.kind", by_name)
        charset = F.coalesce("content_encoding", "_seen.charset", F.lit("UTF-8"))
    df = df.withColumns({"content_type": kind, "content_encoding": charset}).drop("_seen")
    own = {model.REFERENCE: F.col("reference"), model.CONTENT_TYPE: F.col("content_type"), model.CONTENT_ENCODING: F.col("content_encoding"), model.CONTENT_FAMILY: family_column(F.col("content_type"))}
    rest = F.map_filter("metadata", lambda k, _: ~k.isin(*own))
    return df.withColumn("metadata", F.map_concat(rest, F.create_map(*(x for k, v in own.items() for x in (F.lit(k), F.array(v))))))


def _always_null(df: DataFrame, column: str) -> bool:
    """Whether the optimizer knows a column to be null in every row, as for documents made from text columns. What it
    knows of a stream can't be asked before that starts."""
    if df.isStreaming:
        return False
    plan = df.select(column)._jdf.queryExecution().optimizedPlan()
    text = plan.projectList().toString() if plan.nodeName() == "Project" else ""
    return text.startswith("List(null AS")
