"""Nothing is cut off on the way, and readers of more formats: PDF, character sets, the command line."""

from __future__ import annotations

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from test_handlers import after, doc, meta

from quillflow import __main__ as command, model, stored
from quillflow.functions import common, text as T
from quillflow.functions.matcher import basic, regex
from quillflow.operators import filters as fi, splitters as sp, taggers as ta, transformers as tr
from quillflow.operators.base import REGISTRY
from quillflow.operators.taggers import RegexRule
from quillflow.plans.flow import Pipeline
from quillflow.sources import detect, files, pdf, sinks
from quillflow.sources.parsers import UNPARSED, ParserFactory, Unsupported, xml_root


def test_all_values_of_a_field_are_formatted(spark):
    days = [f"{d:02d} Mar 2020" for d in range(1, 13)] + ["no date"]
    tag = ta.DateFormatTagger(from_field="d", to_field="t", from_formats=["yyyy-MM-dd", "dd MMM yyyy"], to_format="yyyy/MM/dd")
    assert meta(doc(spark, d=["2019-01-31", *days]), tag)["t"] == ["2019/01/31", *(f"2020/03/{d:02d}" for d in range(1, 13))]
    keep = ta.DateFormatTagger(from_field="d", from_formats=["dd MMM yyyy"], to_format="yyyy/MM/dd", keep_bad_dates=True)
    assert meta(doc(spark, d=days), keep)["d"] == [*(f"2020/03/{d:02d}" for d in range(1, 13)), "no date"]


def nested(depth: int, inner: bytes = b"the text within", name: str = "a.txt") -> bytes:
    for i in range(depth):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, inner)
        inner, name = out.getvalue(), f"n{i}.zip"
    return inner


def raw_doc(spark, raw: bytes, name: str):
    return model.documents(spark.createDataFrame([(name, bytearray(raw))], "r string, b binary"), "r", raw="b")


def test_children_go_as_deep_as_there_are_any(spark):
    out = Pipeline(parsers=ParserFactory(split_types="application/zip")).run(raw_doc(spark, nested(7), "top.zip")).orderBy("depth").collect()
    assert [r.depth for r in out] == list(range(8)) and out[-1].content == "the text within"


def test_embedded_documents_are_merged_from_any_depth_or_named(spark):
    row = Pipeline(parsers=ParserFactory()).run(raw_doc(spark, nested(12), "top.zip")).first()
    assert row.content == "the text within" and UNPARSED not in row.metadata
    row = Pipeline(parsers=ParserFactory(max_embedded_depth=3)).run(raw_doc(spark, nested(12), "top.zip")).first()
    assert row.content == "" and "deeper" in row.metadata[UNPARSED][0]
    row = Pipeline(parsers=ParserFactory()).run(raw_doc(spark, nested(1, b"\x89PNG\r\n\x1a\n", "a.png"), "top.zip")).first()
    assert row.metadata[UNPARSED] == ["a.png (image/png)"]


def test_a_stream_says_what_it_does_not_unroll(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "top.zip").write_bytes(nested(4))
    pipeline = Pipeline(parsers=ParserFactory(split_types="application/zip"), max_depth=2)
    rows = []
    out = pipeline.run(files.file_stream(spark, str(tmp_path / "in"))).select("depth", "error")
    out.writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.depth, r.error) for r in rows if r.error) == [(2, "children deeper than 2 levels")] and len(rows) == 3


def test_files_of_equal_names_have_their_own_outputs():
    names = {sinks.output_name(ref, 0, None, "out") for ref in ("s3://b/a/x.txt", "s3://b/c/x.txt")}
    assert len(names) == 2 and all(n.startswith("out/x.txt-imported-") and n.endswith(".txt") for n in names)


def test_tables_are_stored_only_where_all_see_them(spark):
    df = stored.written(spark.range(3).toDF("n"), "three")
    assert df.count() == 3
    stored.discard(df)
    with pytest.raises(Exception, match="(?i)not.exist|no such|PATH_NOT_FOUND"):
        df.count()


@pytest.mark.parametrize(("text", "charset"), [
    ("Привет, мир! Это простой текст на русском языке.", "WINDOWS-1251"), ("Привет, мир! Это простой текст на русском языке.", "KOI8-R"), ("Καλημέρα κόσμε, αυτό είναι ένα απλό κείμενο", "WINDOWS-1253"),
    ("これは日本語のテキストです。東京は日本の首都です。", "SHIFT_JIS"), ("これは日本語のテキストです。東京は日本の首都です。", "EUC-JP"), ("这是一个简单的中文文本,我们要检测它的编码。", "GB18030"), ("안녕하세요, 이것은 한국어 텍스트입니다.", "EUC-KR"),
    ("Straße über Köln, schöne Grüße", "ISO-8859-1"), ("“Ça va” très bien – été", "WINDOWS-1252"),
])
def test_character_sets_by_their_scripts(text, charset):
    assert detect.detect_charset(text.encode(charset)) == charset


def test_a_byte_far_into_a_text_tells_the_set():
    assert detect.detect_charset(b"caf\xe9 " * 20_000 + b"\x93so\x94") == "WINDOWS-1252"


def make_pdf(pages: list[bytes], extra: dict[int, bytes] | None = None) -> bytes:
    """A file with one content stream for each page; even ones are compressed."""
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>".encode(), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 5: b"<< /Title (A \\(short\\) title) /Author <FEFF00C4> >>"} | (extra or {})
    for i, page in enumerate(pages):
        objects[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>".encode()
        body, kind = (zlib.compress(page), "/Filter /FlateDecode ") if i % 2 == 0 else (page, "")
        objects[11 + 2 * i] = f"<< {kind}/Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(f"{n} 0 obj\n".encode() + x + b"\nendobj\n" for n, x in objects.items()) + b"trailer << /Root 1 0 R /Info 5 0 R >>\n%%EOF"


CMAP = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0416> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange endcmap"
WIDE = {4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>", 6: b"<< /Length %d >>\nstream\n" % len(CMAP) + CMAP + b"\nendstream"}


def test_pdf_pages_and_metadata(spark):
    raw = make_pdf([b"BT /F1 12 Tf 72 700 Td (First line) Tj 0 -14 Td [(sec) 20 (ond) -300 (line)] TJ ET", b"BT /F2 9 Tf 10 10 Td <000100100011> Tj ET", b"BT /F1 9 Tf (caf\\351 \\(x\\)) Tj T* (end) ' ET"], WIDE)
    text, fields, _ = pdf.parse_pdf(raw, None, "a.pdf")
    assert text == "First line\nsecond line\fЖab\fcafé (x)\nend"
    assert fields == {"xmpTPg:NPages": ["3"], "dc:title": ["A (short) title"], "dc:creator": ["Ä"]}
    out = Pipeline(parsers=ParserFactory(), post=[sp.PDFPageSplitter()]).run(raw_doc(spark, raw, "a.pdf")).orderBy("depth", "child_index").collect()
    assert [r.content for r in out[1:]] == ["First line\nsecond line", "Жab", "café (x)\nend"] and out[2].metadata["document.pdf.pageNumber"] == ["2"]
    assert REGISTRY["PDFPageSplitter"] is sp.PageSplitter


@pytest.mark.parametrize("raw", [b"%PDF-1.4 nothing", make_pdf([b"BT ET"]).replace(b"/Root", b"/Encrypt 9 0 R /Root"), make_pdf([b"x"])[:200]])
def test_broken_pdf_is_an_error_of_its_row(spark, raw):
    rows = Pipeline(parsers=ParserFactory()).run(raw_doc(spark, raw, "a.pdf")).select(model.status().alias("status"), "error").collect()
    assert rows[0].status == "ERROR" and rows[0].error.startswith("PDFError")


def test_xml_with_entities_is_refused():
    with pytest.raises(Unsupported):
        xml_root(b'<!DOCTYPE a [<!ENTITY b "bbbb">]><a>&b;</a>')


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<html><title>T</title><body>Hello there</body></html>")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-broken")
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"post": [], "parsers": {"class": "ParserFactory"}}))
    assert command.main(["check", "-c", str(config)]) == 0
    (tmp_path / "bad.xml").write_text("<importer><postParseHandlers><nothing/></postParseHandlers></importer>")
    assert command.main(["check", "-c", str(tmp_path / "bad.xml")]) == 2
    assert command.main(["import", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out")]) == 1
    said = capsys.readouterr().out
    assert "IMPORTED\tfile:" in said and "ERROR\tfile:" in said
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 2 and names[0].startswith("a.html-imported-") and names[1] == names[0] + ".properties"


def test_events_and_listeners(spark):
    told = []
    pipeline = Pipeline(parsers=ParserFactory(split_types="application/zip"), listeners=[lambda event, depth: told.append((event, depth))])
    out = pipeline.run(raw_doc(spark, nested(1), "top.zip"))
    assert told == [("begin", 0), ("level", 0), ("level", 1), ("end", 1)]
    assert {tuple(r) for r in sinks.events(out).collect()} == {("top.zip", 0, "imported", None), ("top.zip!a.txt", 1, "imported", None), ("top.zip", 0, "split", "1")}


def test_field_report_as_a_file(spark, tmp_path):
    report = ta.field_report(Pipeline().run(doc(spark, f=["b", "a", "b"], g="x")))
    sinks.write_report(report, str(tmp_path / "r"), 2)
    lines = next((tmp_path / "r").glob("*.csv")).read_text().split("\n")
    assert lines[0] == "field,occurrences,sample1,sample2" and "f,1,a,b" in lines and any(x.startswith("g,1,x") for x in lines)


def test_groups_of_content_types():
    assert common.types(common.HTML, common.CSV).pattern.split(",")[0] == "text/html" and "text/csv" in common.types(common.CSV).pattern


def test_sentences_end_at_marks_before_white_space():
    x = "One here. Two (is) here! \"Three?\" v1.2 goes on… and last"
    assert T.sentences(x) == ["One here.", "Two (is) here!", '"Three?"', "v1.2 goes on…", "and last"]
    assert T.change_case("one here.  two HERE! x", "sentences") == "One here.  Two HERE! X"
    assert T.change_case("one. TWO here", "sentencesFully") == "One. Two here" and T.sentences("") == []


@pytest.mark.parametrize(("kind", "want"), [
    ("upper", "A FEW. WORDS HERE"), ("lower", "a few. words here"), ("swap", "A FEW. wORDS hERE"), ("words", "A Few. Words Here"), ("wordsFully", "A Few. Words Here"),
    ("string", "A few. Words Here"), ("stringFully", "A few. words here"), ("sentences", "A few. Words Here"), ("sentencesFully", "A few. Words here"),
])
def test_cases(spark, kind, want):
    assert meta(doc(spark, f="a few. Words Here"), ta.CharacterCaseTagger(case_type=kind, field_matcher=basic("f"))) == {"f": [want]}


def test_values_read_in_the_wrong_set(spark):
    assert meta(doc(spark, f=["cafÃ©", "plain"]), ta.CharsetTagger(field_matcher=basic("f")))["f"] == ["café", "plain"]


def test_patterns_of_the_content(spark):
    tag = ta.TextPatternTagger(patterns=[RegexRule(r"(\w+)=(\d+)", field_group=1, value_group=2), RegexRule("t.o", "t")])
    assert meta(doc(spark, "a=1 b=22 two too"), tag) == {"a": ["1"], "b": ["22"], "t": ["two", "too"]}


def test_debug_leaves_rows_as_they_are(spark):
    assert meta(doc(spark, f="x"), ta.DebugTagger(log_fields=["f"], log_content=True)) == {"f": ["x"]}


def test_dom_content_filter(spark):
    page = "<html><body><p class='k'>good news</p></body></html>"
    keep = fi.DOMContentFilter(selector="p.k", regex=".*news.*")
    assert after(doc(spark, page, "text/html"), keep).status == "IMPORTED"
    assert after(doc(spark, page, "text/html"), fi.DOMContentFilter(selector="p.k", regex=".*bad.*")).status == "REJECTED"
    assert after(doc(spark, page, "text/html"), fi.DOMContentFilter(selector="div")).status == "REJECTED"


def test_an_image_that_cannot_be_read_is_an_error_of_its_row(spark):
    out = Pipeline(pre=[tr.ImageTransformer(scale_factor=0.5)]).run(raw_doc(spark, b"\x89PNG\r\n\x1a\nbroken", "a.png")).first()
    assert out.error


def test_python_handlers_work_on_active_rows_only(spark):
    def fails(x: str) -> str:
        raise AssertionError(x)

    df = Pipeline(post=[fi.TextFilter(field_matcher=basic("f"), value_matcher=regex("x"), on_match="exclude")]).run(doc(spark, "text", f="x"))
    out = df.withColumn("content", F.when(model.active(), tr.rewritten(fails, F.when(model.active(), F.col("content")))).otherwise(F.col("content")))
    assert out.first().content == "text"
