"""One query or more for each kind of handler over the test tables, with the same in SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import model
from ..functions.matcher import basic, csv, regex, wildcard
from ..operators import filters as fi, splitters as sp, taggers as ta, transformers as tr
from ..operators.conditions import All, BlankCondition, DateCondition, DOMCondition, NumericCondition, ReferenceCondition, ScriptCondition, TextCondition
from ..operators.taggers import DOMRule, RegexRule
from ..operators.transformers import Between
from ..sources import files, sinks
from ..sources.parsers import ParserFactory
from .flow import If, IfNot, Pipeline, Reject

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def plain(tag: str) -> str:
    """In SQL: the text of the first element of that tag, where it holds no other."""
    inner = f"regexp_extract(html, '<{tag}>(.*?)</{tag}>', 1)"
    return f"trim(replace(replace(replace({inner}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(load(spark, sf_dir, "documents"), "doc_id", "text", {"lang": "lang", "source": "source"})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(load(spark, sf_dir, "pages"), "url", "html", {"page_id": "page_id"}, "text/html")


def rows(spark: SparkSession, sf_dir: str, table: str, key: str, /, **fields: str) -> DataFrame:
    return files.table(load(spark, sf_dir, table), key, F.lit(""), fields)


def first(name: str) -> Column:
    return F.get(F.col("metadata")[name], F.lit(0))


def joined(name: str) -> Column:
    return F.array_join(F.col("metadata")[name], "|")


def imported(df: DataFrame, *columns: Column, **pipeline) -> DataFrame:
    """The result of a pipeline's post handlers (or other parts) on rows that weren't rejected."""
    return Pipeline(**pipeline).run(df).filter(model.active()).select(*columns)


def ref() -> Column:
    return F.col("reference").cast("long").alias("id")


# Flagship

_LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x, chr(32) || chr(9))), lambda x: x <> '')"
_WORD = r"[\p{L}\p{M}\p{N}_]+-?[\p{L}\p{M}\p{N}_]*"


@query(
    rf"""WITH d AS (SELECT doc_id, regexp_replace(text, '[0-9]', '#', 'g') AS text FROM documents WHERE lang IN ('en', 'de')),
l AS (SELECT doc_id, text, {_LINES} AS lines FROM d),
w AS (SELECT doc_id, length(text) AS n, len(lines) AS p, CAST(list_sum(list_transform(lines, lambda x: len(regexp_extract_all(x, '{_WORD}')))) AS BIGINT) AS w FROM l)
SELECT doc_id AS id, CAST(n AS VARCHAR) AS chars, CAST(coalesce(w, 0) AS VARCHAR) AS words, CAST(p AS VARCHAR) AS paragraphs FROM w"""
)
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INCLUDE by language, replace digits, statistics, keep only those."""
    post = [
        fi.TextFilter(field_matcher=basic("lang"), value_matcher=csv("en,de")),
        tr.ReplaceTransformer(replacements=[(regex("[0-9]", replace_all=True), "#")]),
        ta.TextStatisticsTagger(),
        ta.KeepOnlyTagger(field_matcher=wildcard("document.stat.*")),
    ]
    stat = lambda k: first(f"document.stat.{k}")
    return imported(docs(spark, sf_dir), ref(), stat("characterCount").alias("chars"), stat("wordCount").alias("words"), stat("paragraphCount").alias("paragraphs"), post=post)


# Filters and conditions


@query("SELECT doc_id AS id FROM documents WHERE lang IN ('en', 'fr') AND NOT regexp_matches(source, '^src1')")
def text_filter_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = [
        fi.TextFilter(field_matcher=basic("lang"), value_matcher=basic("EN", ignore_case=True)),
        fi.TextFilter(field_matcher=basic("lang"), value_matcher=basic("fr")),
        fi.TextFilter(field_matcher=basic("source"), value_matcher=wildcard("src1*"), on_match="exclude"),
    ]
    return imported(docs(spark, sf_dir), ref(), post=post)


@query("SELECT doc_id AS id FROM documents WHERE regexp_matches(text, '(?i)idiot') AND NOT contains(text, '$$$')")
def content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = [fi.TextFilter(value_matcher=basic("IDIOT", ignore_case=True, partial=True)), fi.TextFilter(value_matcher=basic("$$$", partial=True), on_match="exclude")]
    return imported(docs(spark, sf_dir), ref(), post=post)


@query("SELECT doc_id AS id FROM documents WHERE regexp_matches(text, '(?is)^.*licen[cs]ed.*$') AND source NOT IN ('src3', 'src5')")
def regex_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older forms of the content, metadata and reference filters."""
    post = [
        fi.RegexContentFilter(regex=".*licen[cs]ed.*"),
        fi.RegexMetadataFilter(field="source", regex="SRC[0-9]+", case_sensitive=True, on_match="exclude"),
        fi.RegexMetadataFilter(field="source", regex="SRC[35]", on_match="exclude"),
        fi.RegexReferenceFilter(regex="[^0-9]+", on_match="exclude"),
        fi.EmptyMetadataFilter(fields=["lang"], on_match="exclude"),
    ]
    return imported(docs(spark, sf_dir), ref(), post=post)


@query("SELECT page_id, url FROM pages WHERE contains(url, '.example.net/') AND url LIKE 'https%'")
def reference_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pre = [fi.ReferenceFilter(value_matcher=wildcard("*.example.net/*"))]
    post = [If(ReferenceCondition(wildcard("http:*")), [Reject()])]
    return imported(pages(spark, sf_dir), first("page_id").cast("long").alias("page_id"), F.col("reference").alias("url"), pre=pre, post=post)


@query("SELECT event_id AS id FROM events WHERE value >= 20 AND value < 60.5")
def numeric_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, "events", "event_id", value="value")
    return imported(df, ref(), post=[fi.NumericMetadataFilter(field_matcher=basic("value"), conditions=[("ge", 20), ("lt", 60.5)])])


@query("SELECT event_id AS id, CASE WHEN value > 50 THEN 'high' WHEN value <= 10 THEN 'low' ELSE 'mid' END AS level FROM events")
def numeric_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, "events", "event_id", value="value")
    low = If(NumericCondition(wildcard("val*"), [("LE", 10)]), [ta.ConstantTagger(constants=[("level", "low")])], [ta.ConstantTagger(constants=[("level", "mid")])])
    post = [If(NumericCondition(basic("value"), [("GT", 50)]), [ta.ConstantTagger(constants=[("level", "high")])], [low])]
    return imported(df, ref(), first("level").alias("level"), post=post)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-03-15'")
def date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    df = files.table(orders, "o_orderkey", F.lit(""), {"day": "day"})
    return imported(df, ref(), post=[fi.DateMetadataFilter(field_matcher=basic("day"), format="yyyy-MM-dd", conditions=[("ge", "1995-01-01"), ("lt", "1996-03-15")])])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderdate >= TIMESTAMP '1997-06-01 02:00:00' THEN 'new' ELSE 'old' END AS age FROM orders")
def date_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch milliseconds against a date in another zone."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
    df = files.table(orders, "o_orderkey", F.lit(""), {"ms": "ms"})
    test = DateCondition(basic("ms"), [("ge", "1997-05-31T22:00:00")], condition_zone_id="America/New_York")
    return imported(df, ref(), first("age").alias("age"), post=[If(test, [ta.ConstantTagger(constants=[("age", "new")])], [ta.ConstantTagger(constants=[("age", "old")])])])


@query("SELECT conv_id * 1000 + turn AS id FROM conversations WHERE length(text) > 0 AND role = 'user'")
def empty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = files.table(load(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn"), "text", {"user": F.when(F.col("role") == "user", F.col("role"))})
    return imported(df, ref(), post=[fi.EmptyFilter(on_match="exclude"), fi.EmptyFilter(field_matcher=basic("user"), on_match="exclude")])


@query("SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'user' THEN 'asked' ELSE 'told' END AS kind FROM conversations")
def blank_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = files.table(load(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn"), "text", {"user": F.when(F.col("role") == "user", F.col("role"))})
    post = [IfNot(BlankCondition(wildcard("us*")), [ta.ConstantTagger(constants=[("kind", "asked")])], [ta.ConstantTagger(constants=[("kind", "told")])])]
    return imported(df, ref(), first("kind").alias("kind"), post=post)


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' OR value > 90")
def script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, "events", "event_id", value="value", type="event_type")
    return imported(df, ref(), post=[fi.ScriptFilter(script="array_contains(metadata['type'], 'click') or cast(metadata['value'][0] as double) > 90")])


@query("SELECT page_id FROM pages WHERE contains(html, '<h1>') AND regexp_matches(html, '<h1>[^<]*the')")
def dom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(pages(spark, sf_dir), first("page_id").cast("long").alias("page_id"), post=[fi.DOMFilter(selector="article > h1", value_matcher=basic("the", partial=True))])


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '<h1>[^<]*the[^<]*</h1>') AND contains(html, '<article>')")
def dom_content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older form of the DOM filter: a regular expression on the values of elements."""
    return imported(pages(spark, sf_dir), first("page_id").cast("long").alias("page_id"), post=[fi.DOMContentFilter(selector="article > h1", regex=".*the.*", case_sensitive=True)])


# Taggers

_CUSTOMER = {"name": "c_name", "segment": "c_mktsegment", "nation": "c_nationkey"}


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "customer", "c_custkey", **_CUSTOMER)


@query("SELECT c_custkey AS id, 'a|b' AS fixed, c_mktsegment || '|x' AS segment, 'y|' || c_name AS name, '7' AS nation, 'new' AS fresh FROM customer")
def constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = [
        ta.ConstantTagger(constants=[("fixed", "a"), ("fixed", "b")]),
        ta.ConstantTagger(constants=[("segment", "x")], on_set="append"),
        ta.ConstantTagger(constants=[("name", "y")], on_set="prepend"),
        ta.ConstantTagger(constants=[("nation", "7")], on_set="replace"),
        ta.ConstantTagger(constants=[("fixed", "z"), ("fresh", "new")], on_set="optional"),
    ]
    return imported(customers(spark, sf_dir), ref(), *(joined(k).alias(k) for k in ("fixed", "segment", "name", "nation", "fresh")), post=post)


@query("SELECT c_custkey AS id, c_name || '|' || c_name AS name, c_mktsegment || '|' || CAST(c_nationkey AS VARCHAR) AS both FROM customer")
def copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = [ta.CopyTagger(copies=[(basic("name"), "name"), (basic("segment"), "both"), (regex("nat.*"), "both")])]
    return imported(customers(spark, sf_dir), ref(), joined("name").alias("name"), joined("both").alias("both"), post=post)


@query("SELECT c_custkey AS id, c_name AS renamed_name, c_mktsegment || '|' || CAST(c_nationkey AS VARCHAR) AS merged, 'renamed_name,merged' AS fields FROM customer")
def rename_merge_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = [
        ta.RenameTagger(field_matcher=regex("(na)(me)"), to_field="renamed_$1$2"),
        ta.CopyTagger(copies=[(basic("segment"), "a"), (basic("nation"), "b")]),
        ta.DeleteTagger(field_matcher=csv("segment,nation")),
        ta.MergeTagger(field_matcher=csv("a,b"), to_field="merged", delete_from_fields=True),
        ta.KeepOnlyTagger(field_matcher=regex("renamed_.*|merged|a|b")),
    ]
    names = F.array_join(F.map_keys("metadata"), ",")
    return imported(customers(spark, sf_dir), ref(), first("renamed_name").alias("renamed_name"), joined("merged").alias("merged"), names.alias("fields"), post=post)


@query("SELECT p_partkey AS id, string_split(p_type, ' ')[1] AS head, string_split(p_type, ' ')[-1] AS tail, replace(p_type, ' ', '/') AS path, replace(p_type, ' ', ',') AS plain FROM part")
def split_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, "part", "p_partkey", type="p_type")
    post = [
        ta.SplitTagger(field_matcher=basic("type"), to_field="words", separator=" "),
        ta.SplitTagger(field_matcher=basic("type"), separator="\\s+", separator_regex=True),
        *(ta.CopyTagger(copies=[(basic("words"), k)]) for k in ("head", "tail", "path", "plain")),
        ta.ForceSingleValueTagger(field_matcher=basic("head"), action="keepFirst"),
        ta.ForceSingleValueTagger(field_matcher=basic("tail"), action="keepLast"),
        ta.ForceSingleValueTagger(field_matcher=basic("path"), action="mergeWith:/"),
        ta.ForceSingleValueTagger(field_matcher=basic("plain")),
    ]
    return imported(df, ref(), *(joined(k).alias(k) for k in ("head", "tail", "path", "plain")), post=post)


@query(
    """WITH s AS (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)
SELECT p_partkey AS id, array_to_string(list_transform(range(1, len(w) + 1), lambda n: array_to_string(w[1:n], '/')), '|') AS paths FROM s"""
)
def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, "part", "p_partkey", type="p_type")
    return imported(df, ref(), joined("paths").alias("paths"), post=[ta.HierarchyTagger(from_field="type", to_field="paths", from_separator=" ", to_separator="/")])


@query("SELECT p_partkey AS id, CASE WHEN length(p_name) > 12 THEN p_name[:9] || '...' ELSE p_name END AS name FROM part")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, "part", "p_partkey", name="p_name")
    return imported(df, ref(), first("name").alias("name"), post=[ta.TruncateTagger(field_matcher=basic("name"), max_length=12, suffix="...")])


@query("SELECT c_custkey AS id, regexp_replace(c_name, '^Customer#0*', 'C-') AS code, CASE WHEN contains(c_mktsegment, 'I') THEN regexp_replace(c_mktsegment, 'I', 'i') END AS first_i, replace(c_mktsegment, 'I', 'i') AS all_i FROM customer")
def replace_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = [
        ta.ReplaceTagger(field_matcher=basic("segment"), value_matcher=basic("I", partial=True), to_value="i", to_field="first_i", discard_unchanged=True),
        ta.ReplaceTagger(field_matcher=basic("segment"), value_matcher=basic("I", replace_all=True), to_value="i"),
        ta.ReplaceTagger(field_matcher=basic("name"), value_matcher=regex("Customer#0*(.*)"), to_value="C-$1", to_field="code"),
    ]
    return imported(customers(spark, sf_dir), ref(), first("code").alias("code"), first("first_i").alias("first_i"), first("segment").alias("all_i"), post=post)


@query("SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '(?i)the')) AS VARCHAR) AS the, CAST(len(regexp_extract_all(source, '[0-9]')) AS VARCHAR) AS digits FROM documents")
def count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = [ta.CountMatchesTagger(to_field="the", count_matcher=basic("THE", ignore_case=True)), ta.CountMatchesTagger(to_field="digits", field_matcher=basic("source"), count_matcher=regex("[0-9]"))]
    return imported(docs(spark, sf_dir), ref(), first("the").alias("the"), first("digits").alias("digits"), post=post)


@query("SELECT doc_id AS id, CAST(octet_length(encode(text)) AS VARCHAR) AS bytes FROM documents")
def document_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(docs(spark, sf_dir), ref(), first("bytes").alias("bytes"), post=[ta.DocumentLengthTagger(to_field="bytes")])


@query(
    r"""SELECT page_id, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), '|') AS links, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
  CASE WHEN regexp_matches(html, '<meta charset="') THEN regexp_extract(html, '<meta (charset)="([^"]*)"', 2) END AS charset FROM pages"""
)
def regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        RegexRule('<a href="([^"]*)"', "links", value_group=1),
        RegexRule("<title>(.*?)</title>", "title", value_group=1),
        RegexRule('<META (charset)="([^"]*)"', field_group=1, value_group=2, ignore_case=True),
    ]
    columns = [first("page_id").cast("long").alias("page_id"), F.coalesce(joined("links"), F.lit("")).alias("links"), F.coalesce(first("title"), F.lit("")).alias("title"), first("charset").alias("charset")]
    return imported(pages(spark, sf_dir), *columns, post=[ta.RegexTagger(patterns=rules)])


@query("SELECT page_id, array_to_string(list_reverse(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)), '|') AS items FROM pages")
def text_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists; of these marks no pair overlaps another."""
    post = [ta.TextBetweenTagger(to_field="li", start_matcher=basic("<li>"), end_matcher=basic("</li>"))]
    return imported(pages(spark, sf_dir), first("page_id").cast("long").alias("page_id"), F.coalesce(joined("li"), F.lit("")).alias("items"), post=post)


@query(
    r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(url || ' and www.example.org/x.', '(?i)\b(?:https?:|www\.)[^\s<>"'']+'),
  lambda u: CASE WHEN lower(u[:4]) = 'http' THEN regexp_replace(u, '[.,]+$', '') ELSE 'https://' || regexp_replace(u, '[.,]+$', '') END))), '|') AS urls FROM pages"""
)
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = files.table(load(spark, sf_dir, "pages"), "page_id", F.concat("url", F.lit(" and www.example.org/x.")))
    return imported(df, F.col("reference").cast("long").alias("page_id"), joined("urls").alias("urls"), post=[ta.URLExtractorTagger(to_field="urls")])


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%d/%m/%Y') AS day, CAST(epoch_ms(o_orderdate) AS VARCHAR) AS ms, 'bad' AS kept FROM orders")
def date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"), F.lit("bad").alias("kept"))
    df = files.table(orders, "o_orderkey", F.lit(""), {"day": "day", "kept": "kept"})
    formats = ["yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss"]
    post = [
        ta.DateFormatTagger(from_field="day", to_field="ms", from_formats=formats),
        ta.DateFormatTagger(from_field="kept", from_formats=formats, keep_bad_dates=True),
        ta.DateFormatTagger(from_field="day", from_formats=formats, to_format="dd/MM/yyyy"),
    ]
    return imported(df, ref(), first("day").alias("day"), first("ms").alias("ms"), first("kept").alias("kept"), post=post)


@query(
    """SELECT p_partkey AS id, upper(p_name) AS up, lower(p_type) AS low, upper(p_name[1]) || p_name[2:] AS capital,
  array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS words FROM part"""
)
def character_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, "part", "p_partkey", up="p_name", low="p_type", capital="p_name", words="p_type")
    kinds = {"up": "upper", "low": "lower", "capital": "string", "words": "wordsFully"}
    post = [ta.CharacterCaseTagger(case_type=kind, field_matcher=basic(name)) for name, kind in kinds.items()]
    return imported(df, ref(), *(first(k).alias(k) for k in kinds), post=post)


@query(
    """SELECT p_partkey AS id, translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') AS swapped,
  upper(p_name[1]) || lower(p_name[2:]) AS string, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS words,
  upper(p_name[1]) || p_name[2:] || '. ' || upper(p_type[1]) || p_type[2:] AS sentences, upper(p_name[1]) || lower(p_name[2:]) || '. ' || upper(p_type[1]) || lower(p_type[2:]) AS sentences_fully FROM part"""
)
def letter_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases that character_case lacks."""
    part = load(spark, sf_dir, "part").withColumn("both", F.concat("p_name", F.lit(". "), "p_type"))
    kinds = {"swapped": ("swap", "p_type"), "string": ("stringFully", "p_name"), "words": ("words", "p_name"), "sentences": ("sentences", "both"), "sentences_fully": ("sentencesFully", "both")}
    df = files.table(part, "p_partkey", F.lit(""), {k: column for k, (_, column) in kinds.items()})
    post = [ta.CharacterCaseTagger(case_type=kind, field_matcher=basic(k)) for k, (kind, _) in kinds.items()]
    return imported(df, ref(), *(first(k).alias(k) for k in kinds), post=post)


@query("SELECT doc_id AS id, array_to_string(regexp_extract_all(text, '[0-9]+'), '|') AS numbers, lang FROM documents")
def text_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of the content, with a debugging step that changes nothing."""
    post = [ta.TextPatternTagger(patterns=[RegexRule("[0-9]+", "numbers")]), ta.DebugTagger(log_fields=["numbers"])]
    return imported(docs(spark, sf_dir), ref(), F.coalesce(joined("numbers"), F.lit("")).alias("numbers"), first("lang").alias("lang"), post=post)


@query("SELECT p_partkey AS id, p_name || chr(233) AS read, p_type AS kept FROM part")
def charset_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose UTF-8 bytes were read as Latin-1 come back; others stay."""
    part = load(spark, sf_dir, "part").withColumn("wrong", F.concat("p_name", F.lit("\u00c3\u00a9")))
    df = files.table(part, "p_partkey", F.lit(""), {"read": "wrong", "kept": "p_type"})
    return imported(df, ref(), first("read").alias("read"), first("kept").alias("kept"), post=[ta.CharsetTagger(field_matcher=wildcard("*e*"))])


_STANDARD = "'document.reference', 'document.contentType', 'document.contentEncoding', 'document.contentFamily'"


@query(
    """WITH v AS (SELECT 'lang' AS field, lang AS s FROM documents UNION ALL SELECT 'source', source FROM documents),
d AS (SELECT field, count(*) AS occurrences FROM v WHERE s IS NOT NULL GROUP BY field)
SELECT d.field, occurrences, array_to_string(list_sort((SELECT list(DISTINCT s) FROM v WHERE v.field = d.field))[1:3], '|') AS samples FROM d"""
)
def field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ta.field_report(docs(spark, sf_dir))
    return report.select("field", "occurrences", F.array_join("samples", "|").alias("samples"))


@query()
def title_and_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = [ta.TitleGeneratorTagger(detect_heading=True), ta.LanguageTagger(fallback_language="xx")]
    return imported(docs(spark, sf_dir), ref(), first(model.TITLE).alias("title"), first(model.LANGUAGE).alias("language"), post=post)


@query("SELECT c_custkey AS id, true AS fresh, true AS unique_id FROM customer")
def date_and_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values differ in every run; what holds of them is checked."""
    post = [ta.CurrentDateTagger(), ta.UUIDTagger()]
    fresh = F.abs(first(model.IMPORTED_DATE).cast("long") - F.unix_millis(F.current_timestamp())) < 86_400_000
    return imported(customers(spark, sf_dir), ref(), fresh.alias("fresh"), first(model.UUID).rlike("^[0-9a-f-]{36}$").alias("unique_id"), post=post)


# Transformers


def changed(spark: SparkSession, sf_dir: str, *post, table: str = "documents") -> DataFrame:
    key = ref() if table == "documents" else first("page_id").cast("long").alias("id")
    return imported(docs(spark, sf_dir) if table == "documents" else pages(spark, sf_dir), key, F.col("content").alias("text"), post=list(post))


@query("SELECT doc_id AS id, regexp_replace(replace(text, 'the', 'THE'), '[aeiou]+', '_', 'g') AS text FROM documents")
def replace_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir, tr.ReplaceTransformer(replacements=[(basic("the", replace_all=True), "THE"), (regex("[aeiou]+", replace_all=True), "_")]))


@query(r"SELECT doc_id AS id, regexp_replace(regexp_replace(text, '(?:e)+e', 'e', 'g'), '(?: )+ ', ' ', 'g') AS text FROM documents")
def reduce_consecutives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir, tr.ReduceConsecutivesTransformer(reduce=["e", "\\s"]))


@query(r"SELECT page_id AS id, regexp_replace(regexp_replace(html, '(?s)^.*?<article>', ''), '(?s)(</article>).*$', '\1') AS text FROM pages")
def strip_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir, tr.StripBeforeTransformer(strip_before_matcher=basic("<article>"), inclusive=True), tr.StripAfterTransformer(strip_after_matcher=basic("</article>")), table="pages")


@query(r"SELECT page_id AS id, regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '(?s)(<style>).*?(</style>)', '\1\2', 'g') AS text FROM pages")
def strip_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir, tr.StripBetweenTransformer(strip_between=[Between(basic("<script>"), basic("</script>"), True), Between(basic("<style>"), basic("</style>"))]), table="pages")


@query("SELECT doc_id AS id, text[11:60] AS text FROM documents")
def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir, tr.SubstringTransformer(begin=10, end=60))


@query("SELECT doc_id AS id, '' AS text, text AS body FROM documents WHERE lang = 'es'")
def no_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = [fi.TextFilter(field_matcher=basic("lang"), value_matcher=basic("es")), tr.NoContentTransformer(to_field="body")]
    return imported(docs(spark, sf_dir), ref(), F.col("content").alias("text"), first("body").alias("body"), post=post)


@query("SELECT doc_id AS id, lower(text) AS text, CAST(length(text) AS VARCHAR) AS size FROM documents")
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = [ta.ScriptTagger(script="map('size', array(cast(length(content) as string)))"), tr.ScriptTransformer(script="lower(content)")]
    return imported(docs(spark, sf_dir), ref(), F.col("content").alias("text"), first("size").alias("size"), post=post)


@query("SELECT doc_id AS id, text FROM documents")
def charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in UTF-8 come back as the text they were, whether the set is named or detected."""
    table = load(spark, sf_dir, "documents")
    df = model.documents(table, "doc_id", raw=F.encode("text", "UTF-8"))
    return imported(df, ref(), F.col("content").alias("text"), pre=[tr.CharsetTransformer()])


# DOM, splitters, parsing, flows


@query(f"SELECT page_id, {plain('title')} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<li>')) AS VARCHAR) AS items FROM pages")
def dom_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [DOMRule("head > title", "title"), DOMRule("html", "lang", "attr(lang)"), DOMRule("nav li", "items", "tagName")]
    columns = [first("page_id").cast("long").alias("page_id"), F.coalesce(first("title"), F.lit("")).alias("title"), F.coalesce(first("lang"), F.lit("")).alias("lang"), F.size(F.coalesce(F.col("metadata")["items"], F.array())).cast("string").alias("items")]
    return imported(pages(spark, sf_dir), *columns, post=[ta.DOMTagger(rules=rules)])


@query("SELECT page_id AS id, false AS has_nav, false AS has_script, " + plain("h1") + " AS heading FROM pages")
def dom_transformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes navigation and scripts, then keeps the heading alone."""
    df = Pipeline(post=[tr.DOMDeleteTransformer(selectors=["nav", "script"])]).run(pages(spark, sf_dir))
    gone = df.select(F.col("content").contains("<nav").alias("has_nav"), F.col("content").contains("<script").alias("has_script"), "*").drop("children")
    flow = tr.DOMPreserveTransformer(rules=[DOMRule("h1")])
    out = flow.apply(gone)
    return out.select(first("page_id").cast("long").alias("id"), "has_nav", "has_script", F.col("content").alias("heading"))


@query("SELECT page_id, CAST(NULL AS INTEGER) AS child, 0 AS depth FROM pages UNION ALL SELECT page_id, CAST(i AS INTEGER), 1 FROM pages, LATERAL (SELECT unnest(range(0, len(regexp_extract_all(html, '<li>')))) AS i)")
def import_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and their list items as children, through the whole pipeline again."""
    out = Pipeline(pre=[sp.DOMSplitter(selector="nav li")], max_depth=2).run(pages(spark, sf_dir))
    return out.select(first("page_id").cast("long").alias("page_id"), F.col("child_index").alias("child"), "depth")


@query("SELECT c_nationkey AS nation, c_name AS name, c_mktsegment AS segment, 'row-' || CAST(1 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS VARCHAR) AS ref FROM customer")
def csv_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation as one CSV document, split into records again."""
    line = F.concat(F.lit('"'), "c_name", F.lit('",'), "c_mktsegment")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda r: r["line"])
    table = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("name,segment\n"), F.array_join(lines, "\n")).alias("csv"))
    out = Pipeline(pre=[sp.CsvSplitter(use_first_row_as_fields=True)], max_depth=1).run(files.table(table, "c_nationkey", "csv", {}, "text/csv"))
    kids = out.filter("depth = 1")
    return kids.select(F.get("parent_refs", F.lit(0)).cast("int").alias("nation"), first("name").alias("name"), first("segment").alias("segment"), first(model.EMBEDDED_REFERENCE).alias("ref"))


@query("SELECT n_regionkey AS region, n_name AS name, n_nationkey AS key FROM nation")
def xml_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as one XML document, split at an absolute path."""
    one = F.concat(F.lit('<nation key="'), "n_nationkey", F.lit('"><name>'), "n_name", F.lit("</name></nation>"))
    table = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<region><list>"), F.array_join(F.collect_list(one), ""), F.lit("</list></region>")).alias("xml"))
    pipeline = Pipeline(pre=[If(BlankCondition(basic(model.EMBEDDED_INDEX)), [sp.XMLStreamSplitter(path="/region/list/nation")])], max_depth=1)
    kids = pipeline.run(files.table(table, "n_regionkey", "xml", {}, "application/xml")).filter("depth = 1")
    return kids.select(F.get("parent_refs", F.lit(0)).cast("int").alias("region"), F.xpath_string("content", F.lit("nation/name")).alias("name"), F.xpath_int("content", F.lit("nation/@key")).alias("key"))


@query(
    f"""SELECT page_id, {plain('title')} AS title, 'html' AS family, contains(html, '<h1>') AS has_heading FROM pages"""
)
def parse_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes: detected, parsed to text and metadata, then handled."""
    df = model.documents(load(spark, sf_dir, "pages"), "url", raw=F.encode("html", "UTF-8"), metadata={"page_id": "page_id"})
    test = All([DOMCondition("h1"), ScriptCondition("size(metadata) > 3")])
    pre = [If(test, [ta.ConstantTagger(constants=[("heading", "yes")])])]
    post = [If(TextCondition(basic("html"), basic(model.CONTENT_FAMILY)), [ta.ConstantTagger(constants=[("family", "html")])])]
    columns = [first("page_id").cast("long").alias("page_id"), first("title").alias("title"), first("family").alias("family"), F.coalesce(first("heading") == "yes", F.lit(False)).alias("has_heading")]
    return imported(df.withColumn("content", F.decode("raw", "UTF-8")), *columns, pre=pre, post=post, parsers=ParserFactory())


@query(
    """SELECT doc_id AS id, CASE WHEN lang = 'en' THEN CASE WHEN contains(text, 'idiot') THEN 'rude' ELSE 'fine' END ELSE 'other' END AS verdict,
  CASE WHEN lang = 'de' AND source = 'src1' THEN 'REJECTED' ELSE 'IMPORTED' END AS status FROM documents"""
)
def if_else_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda v: ta.ConstantTagger(constants=[("verdict", v)])
    english = TextCondition(basic("en"), basic("lang"))
    post = [
        If(english, [If(TextCondition(basic("idiot", partial=True)), [tag("rude")], [tag("fine")])], [tag("other")]),
        If(All([TextCondition(basic("de"), basic("lang")), TextCondition(basic("src1"), basic("source"))]), [Reject()]),
        ta.ConstantTagger(constants=[("late", "yes")]),
    ]
    return Pipeline(post=post).run(docs(spark, sf_dir)).select(ref(), first("verdict").alias("verdict"), model.status().alias("status"))


@query("SELECT CASE WHEN lang = 'en' AND source <> 'src5' THEN 'IMPORTED' ELSE 'REJECTED' END AS status, count(*) AS documents FROM documents GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pre = [fi.TextFilter(field_matcher=basic("source"), value_matcher=basic("src5"), on_match="exclude"), fi.TextFilter(field_matcher=basic("lang"), value_matcher=basic("en"))]
    return sinks.status_counts(Pipeline(pre=pre).run(docs(spark, sf_dir)))


@query("SELECT doc_id AS id, CASE WHEN source = 'src2' THEN 'yes' END AS marked FROM documents")
def restrict_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.base import PropertyMatcher

    post = [ta.ConstantTagger(constants=[("marked", "yes")], restrict_to=[PropertyMatcher(basic("source"), basic("src2"))])]
    return imported(docs(spark, sf_dir), ref(), first("marked").alias("marked"), post=post)
