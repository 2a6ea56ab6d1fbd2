"""Parsers, files in and out, configuration, and streams."""

from __future__ import annotations

import base64
import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillflow import model
from quillflow.functions.matcher import basic, regex
from quillflow.operators import filters as fi, taggers as ta
from quillflow.plans import config
from quillflow.plans.flow import If, Pipeline, Reject
from quillflow.sources import files, sinks
from quillflow.sources.detect import detect_charset, detect_type
from quillflow.sources.parsers import ParserFactory
from quillflow.streaming import live


def zipped(**parts: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def docx(text: str) -> bytes:
    body = f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>'
    return zipped(**{"[Content_Types].xml": b"<Types>wordprocessingml.document.main</Types>", "word__document.xml": body.encode(), "docProps__core.xml": b'<c xmlns:dc="d"><dc:title>My title</dc:title></c>'})


XFDL = b"<XFDL><globalpage><title>Form</title></globalpage><page><field><value>one</value></field><field><value>two</value></field></page></XFDL>"
FILES = {
    "a.html": b"<html><head><title>T</title><meta name=author content=Me></head><body><h1>Head</h1><p>Text &amp; more</body></html>",
    "b.txt": "Élan vital".encode("latin-1"), "c.docx": docx("Hello office"), "d.csv": b"x,y\n1,2\n", "e.json": b'{"a": 1}', "f.rtf": rb"{\rtf1\ansi Hello {\b rtf}\par caf\'e9}",
    "g.xfdl": XFDL, "h.xfdl": b'application/vnd.xfdl; content-encoding="base64-gzip"\n' + base64.b64encode(gzip.compress(XFDL)), "i.zip": zipped(**{"in.txt": b"inner text", "sub__x.html": b"<p>page</p>"}),
    "j.bin": bytes(range(256)), "k.txt": b"",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        (path / name).write_bytes(data)
    return path


def test_parsers_over_files(spark, folder):
    rows = Pipeline(parsers=ParserFactory()).run(files.files(spark, str(folder))).select("*", model.status().alias("status")).collect()
    got = {r.reference.rsplit("/", 1)[-1]: r for r in rows}
    text = {k: r.content for k, r in got.items()}
    assert text["a.html"] == "Head\nText & more" and got["a.html"].metadata["title"] == ["T"] and got["a.html"].metadata["author"] == ["Me"]
    assert text["b.txt"] == "Élan vital" and text["c.docx"] == "Hello office" and got["c.docx"].metadata["dc:title"] == ["My title"]
    assert "Hello rtf" in text["f.rtf"] and "café" in text["f.rtf"]
    assert text["g.xfdl"] == text["h.xfdl"] == "one\ntwo" and got["h.xfdl"].metadata["title"] == ["Form"]
    assert text["i.zip"] == "inner text\npage"
    assert got["j.bin"].status == "ERROR" and "no parser" in got["j.bin"].error and "k.txt" not in got


def test_embedded_documents_as_children(spark, folder):
    out = Pipeline(parsers=ParserFactory(split_types="application/zip")).run(files.files(spark, str(folder), "*.zip")).orderBy("depth", "child_index").collect()
    assert [(r.depth, r.content) for r in out] == [(0, ""), (1, "inner text"), (1, "page")]
    assert out[1].metadata[model.EMBEDDED_REFERENCE] == ["in.txt"] and out[1].parent_refs[0].endswith("i.zip")
    none = Pipeline(parsers=ParserFactory(no_extract_embedded="text/html")).run(files.files(spark, str(folder), "*.zip")).first()
    assert none.content == "inner text"


@pytest.mark.parametrize(("raw", "name", "kind"), [
    (b"%PDF-1.7", "x", "application/pdf"), (b"<?xml version='1.0'?><rss/>", "x", "application/rss+xml"), (b"<!DOCTYPE html><html>", "x", "text/html"), (b"a,b", "x.csv", "text/csv"), (b"plain words", "x", "text/plain"),
    (docx("x"), "noname", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), (b"\x89PNG\r\n\x1a\n", "x.txt", "image/png"),
])
def test_types(raw, name, kind):
    assert detect_type(raw, name) == kind


def test_charsets():
    assert detect_charset("é".encode()) == "UTF-8" and detect_charset("é".encode("latin-1")) == "ISO-8859-1" and detect_charset("“é”".encode("cp1252")) == "WINDOWS-1252" and detect_charset("é".encode("utf-16")) == "UTF-16"


def test_sinks(spark, tmp_path):
    df = model.documents(spark.createDataFrame([("a/x.txt", "good"), ("b", "bad")], "r string, c string"), "r", "c")
    out = Pipeline(post=[fi.TextFilter(value_matcher=basic("bad"), on_match="exclude"), ta.ConstantTagger(constants=[("k", "v 1")])]).run(df)
    sinks.write_tables(out, str(tmp_path / "t"))
    assert [r.reference for r in spark.read.parquet(str(tmp_path / "t/imported")).collect()] == ["a/x.txt"]
    assert [(r.reference, r.status) for r in spark.read.parquet(str(tmp_path / "t/other")).collect()] == [("b", "REJECTED")]
    for kind in ("json", "xml", "properties"):
        sinks.write_files(out, str(tmp_path / kind), kind)
        names = sorted(p.name for p in (tmp_path / kind).iterdir())
        assert len(names) == 2 and (tmp_path / kind / names[0]).read_text() == "good" and "v" in (tmp_path / kind / names[1]).read_text()


def test_configuration_round_trips(spark):
    p = Pipeline(pre=[ta.ConstantTagger(constants=[("a", "b")])], post=[If(config.load_value({"class": "TextCondition", "value_matcher": {"class": "TextMatcher", "pattern": "x"}}), [Reject()]), fi.TextFilter(value_matcher=regex("a.*", ignore_case=True))], parsers=ParserFactory(split_types="application/zip"))
    again = config.load_pipeline(json.loads(json.dumps(config.dump_pipeline(p))))
    assert config.dump_pipeline(again) == config.dump_pipeline(p)
    with pytest.raises(config.ConfigError):
        config.load_pipeline({"post": [{"class": "os.system"}]})
    with pytest.raises(config.ConfigError):
        config.load_pipeline({"post": [{"class": "ConstantTagger", "nope": 1}]})


XML = """<pipeline><postParseHandlers>
  <if><condition class="TextCondition"><fieldMatcher>lang</fieldMatcher><valueMatcher>en</valueMatcher></condition>
    <then><handler class="ConstantTagger"><constant name="v">yes</constant></handler></then>
    <else><reject/></else></if>
  <handler class="ReplaceTransformer"><replace><valueMatcher replaceAll="true">a</valueMatcher><toValue>b</toValue></replace></handler>
</postParseHandlers></pipeline>"""


def test_configuration_from_xml(spark):
    df = model.documents(spark.createDataFrame([("1", "aha", "en"), ("2", "aha", "de")], "r string, c string, lang string"), "r", "c", metadata={"lang": "lang"})
    rows = {r.reference: r for r in config.load_xml(XML).run(df).select("*", model.status().alias("status")).collect()}
    assert rows["1"].content == "bhb" and rows["1"].metadata["v"] == ["yes"] and rows["2"].status == "REJECTED"


def test_streams_import_files_once(spark, folder, tmp_path):
    pipeline = Pipeline(parsers=ParserFactory(), post=[ta.KeepOnlyTagger(field_matcher=basic("title"))])
    for _ in range(2):
        live.start(files.file_stream(spark, str(folder), "*.html"), pipeline, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.content, json.loads(r.metadata)) for r in rows] == [("Head\nText & more", {"title": ["T"]})]


def test_stream_report_is_that_of_the_batch(spark, tmp_path):
    spark.createDataFrame([("1", "en"), ("2", "de"), ("3", None)], "r string, lang string").write.parquet(str(tmp_path / "in"))
    schema = "r string, lang string"
    stream = model.documents(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "r", F.lit(""), metadata={"lang": "lang"})
    live.report(stream).writeStream.format("memory").queryName("fields").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r.field, r.occurrences, r.samples) for r in spark.table("fields").collect()] == [("lang", 2, ["de", "en"])]


def test_empty_and_missing(spark):
    assert Pipeline().run(files.empty(spark, "none")).first().content == ""
    df = model.documents(spark.createDataFrame([(None, None, None)], "r string, c string, m string"), "r", "c", metadata={"m": "m"})
    row = Pipeline(post=[ta.TextStatisticsTagger(), ta.KeepOnlyTagger(field_matcher=regex("m|document.stat.wordCount"))]).run(df).first()
    assert row.reference == "" and dict(row.metadata) == {"document.stat.wordCount": ["0"]}
