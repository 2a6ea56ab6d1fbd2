"""Taggers: projections of the metadata map. Rejected rows and rows a restriction excludes keep theirs."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import model
from ..functions import dates, dom, language, text as T
from ..functions.fields import OnSet, drop, grouped, keep, let, no_values, pick, put, put_map, values
from ..functions.matcher import TextMatcher, as_matcher
from .base import Handler, blank, register, text

def meta() -> Column:
    return F.col("metadata")



@dataclass(kw_only=True)
class Tagger(Handler):
    kind: ClassVar[str] = "tagger"

    def tag(self, m: Column) -> Column:
        """The metadata map after the tagger."""
        raise NotImplementedError

    def uses_python(self) -> bool:
        """Whether tag() holds a Python function, which can't be part of a lambda."""
        return False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.uses_python():
            # Python functions run before a branch is chosen, so rows that aren't active go to them without a field
            df = df.withColumn("_on", self.guard()).withColumn("_active", F.when(F.col("_on"), meta()))
            return df.withColumn("metadata", F.when(F.col("_on"), self.tag(F.col("_active"))).otherwise(meta())).drop("_on", "_active")
        return df.withColumn("metadata", let(lambda m, on: F.when(on, self.tag(m)).otherwise(m), meta(), self.guard()))


def many(function: Callable[[str], list[str]], source: Column) -> Column:
    """A Python function from a string to strings, over each string of an array column; results are joined."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: [y for x in (xs if xs is not None else ()) if x is not None for y in function(x)])

    return run(source)


def source_of(m: Column, field_matcher: TextMatcher | None) -> Column:
    """The values of matching fields, or without a field matcher the content as the one value."""
    if field_matcher is None or not as_matcher(field_matcher).configured:
        return F.array(text())
    return pick(m, as_matcher(field_matcher))


def change_fields(m: Column, field_matcher: TextMatcher, change: Callable[[Column], Column]) -> Column:
    """The map with the value arrays of matching fields changed; fields left without values go."""
    matcher = as_matcher(field_matcher)
    changed = F.transform_values(m, lambda k, v: F.when(matcher.test(k), change(v)).otherwise(v))
    return F.map_filter(changed, lambda _, v: F.size(v) > 0)


def in_place(m: Column, field_matcher: TextMatcher, function: Callable[[str], str]) -> Column:
    """The map with a Python function applied to every value of matching fields."""

    @F.pandas_udf("array<array<string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda fields: [[function(x) for x in xs] for xs in (fields if fields is not None else ())])

    found = keep(m, as_matcher(field_matcher))
    return F.map_concat(drop(m, as_matcher(field_matcher)), F.map_from_arrays(F.map_keys(found), run(F.map_values(found))))


@register
@dataclass(kw_only=True)
class CharacterCaseTagger(Tagger):
    """case_type: upper, lower, swap, words, wordsFully, string, stringFully, sentences, sentencesFully."""

    case_type: str
    field_matcher: TextMatcher
    apply_to: str = "value"

    def __post_init__(self) -> None:
        if self.case_type not in T.CASES:
            raise ValueError(f"unknown case: {self.case_type}")

    def uses_python(self) -> bool:
        return self.case_type not in ("upper", "lower")

    def tag(self, m: Column) -> Column:
        kind, matcher = self.case_type, as_matcher(self.field_matcher)
        built_in = {"upper": F.upper, "lower": F.lower}.get(kind)
        if self.apply_to in ("value", "both"):
            m = change_fields(m, matcher, lambda v: F.transform(v, built_in)) if built_in else in_place(m, matcher, lambda x: T.change_case(x, kind))
        if self.apply_to in ("field", "both"):
            if built_in:
                names = F.transform(F.map_keys(m), lambda k: F.when(matcher.test(k), built_in(k)).otherwise(k))
            else:
                marked = F.transform(F.map_keys(m), lambda k: F.concat(F.when(matcher.test(k), "1").otherwise("0"), k))
                names = many(lambda x: [T.change_case(x[1:], kind) if x[0] == "1" else x[1:]], marked)
            m = grouped(F.arrays_zip(names.alias("key"), F.map_values(m).alias("value")))
        return m


@register
@dataclass(kw_only=True)
class CharsetTagger(Tagger):
    """Re-reads values whose bytes were decoded in the wrong character set."""

    field_matcher: TextMatcher
    source_charset: str | None = None
    target_charset: str = "UTF-8"

    def uses_python(self) -> bool:
        return True

    def tag(self, m: Column) -> Column:
        from ..sources.detect import detect_charset

        source, target = self.source_charset, self.target_charset

        def one(x: str) -> str:
            if (source or "").lower() == target.lower():
                return x
            if source is not None:
                return x.encode(source, "replace").decode(target, "replace")
            try:
                raw = x.encode("latin-1")
            except UnicodeEncodeError:
                return x
            return raw.decode(detect_charset(raw), "replace")

        return in_place(m, self.field_matcher, one)


@register
@dataclass(kw_only=True)
class ConstantTagger(Tagger):
    constants: list[tuple[str, str]]
    on_set: OnSet = "append"

    def tag(self, m: Column) -> Column:
        by: dict[str, list[str]] = {}
        for name, value in self.constants:
            by.setdefault(name, []).append(value)
        for name, new in by.items():
            m = put(m, name, F.array(*map(F.lit, new)), self.on_set)
        return m


@register
@dataclass(kw_only=True)
class CopyTagger(Tagger):
    copies: list[tuple[TextMatcher, str]]
    on_set: OnSet = "append"

    def tag(self, m: Column) -> Column:
        for matcher, to in self.copies:
            m = let(lambda x, matcher=matcher, to=to: put(x, to, pick(x, as_matcher(matcher)), self.on_set), m)
        return m


@register
@dataclass(kw_only=True)
class CountMatchesTagger(Tagger):
    to_field: str
    count_matcher: TextMatcher
    field_matcher: TextMatcher | None = None
    on_set: OnSet = "append"

    def tag(self, m: Column) -> Column:
        counts = F.transform(source_of(m, self.field_matcher), as_matcher(self.count_matcher).count)
        return put(m, self.to_field, F.array(F.aggregate(counts, F.lit(0).cast("int"), lambda a, n: a + n).cast("string")), self.on_set)


@register
@dataclass(kw_only=True)
class CurrentDateTagger(Tagger):
    """The time of the query (of the micro-batch in a stream), as milliseconds or in a pattern."""

    to_field: str = model.IMPORTED_DATE
    format: str | None = None
    on_set: OnSet = "append"

    def tag(self, m: Column) -> Column:
        return put(m, self.to_field, F.array(dates.write(F.current_timestamp(), self.format)), self.on_set)


@register
@dataclass(kw_only=True)
class DateFormatTagger(Tagger):
    """Every value that one of the formats fits, in another. Without to_field the field's values become the new ones."""

    from_field: str
    to_field: str | None = None
    from_formats: list[str] = field(default_factory=lambda: [dates.EPOCH])
    to_format: str = dates.EPOCH
    keep_bad_dates: bool = False
    on_set: OnSet = "append"

    def apply(self, df: DataFrame) -> DataFrame:
        textual = [f for f in self.from_formats if dates.is_textual(f)]
        if not textual:
            return super().apply(df)
        # all values of active rows in one Python call; others give null
        df = df.withColumn("_walls", dates.walls(F.when(self.guard(), values(meta(), self.from_field)), textual))
        return super().apply(df).drop("_walls")

    def tag(self, m: Column) -> Column:
        textual = [f for f in self.from_formats if dates.is_textual(f)]

        def one(v: Column, i: Column, walls: Column | None) -> Column:
            times = [dates.instant(F.get(F.get(walls, F.lit(textual.index(f))), i)) if f in textual else dates.parse(v, f) for f in self.from_formats]
            new = dates.write(F.coalesce(*times), self.to_format)
            return F.coalesce(new, v) if self.keep_bad_dates else new

        def all_of(found: Column, walls: Column | None = None) -> Column:
            return F.filter(F.transform(found, lambda v, i: one(v, i, walls)), lambda v: v.isNotNull())

        found = values(m, self.from_field)
        new = let(all_of, found, F.col("_walls")) if textual else all_of(found)
        if self.to_field:
            return put(m, self.to_field, new, self.on_set)
        return F.map_filter(F.transform_values(m, lambda k, v: F.when(k == self.from_field, new).otherwise(v)), lambda _, v: F.size(v) > 0)


@register
@dataclass(kw_only=True)
class DebugTagger(Tagger):
    """Counts rows and chosen fields under an observation name, and logs on the driver; the rows stay as they are."""

    log_fields: list[str] = field(default_factory=list)
    log_content: bool = False
    log_level: str = "debug"
    prefix: str = "debug"

    def apply(self, df: DataFrame) -> DataFrame:
        logging.getLogger("quillflow").log(getattr(logging, self.log_level.upper()), "%s: %s", self.prefix, self.log_fields)
        counts = [F.count("*").alias("rows"), *(F.count(F.when(F.map_contains_key(meta(), name), 1)).alias(name) for name in self.log_fields)]
        return df.observe(f"{self.prefix}-{id(self)}", *counts, *([F.sum(F.length(text())).alias("content_chars")] if self.log_content else []))


@register
@dataclass(kw_only=True)
class DeleteTagger(Tagger):
    field_matcher: TextMatcher

    def tag(self, m: Column) -> Column:
        return drop(m, as_matcher(self.field_matcher))


@register
@dataclass(kw_only=True)
class DocumentLengthTagger(Tagger):
    """The length of the content in bytes."""

    to_field: str
    on_set: OnSet = "append"

    def tag(self, m: Column) -> Column:
        size = F.coalesce(F.octet_length("content"), F.octet_length("raw"), F.lit(0))
        return put(m, self.to_field, F.array(size.cast("string")), self.on_set)


@dataclass(frozen=True)
class DOMRule:
    selector: str
    to_field: str = ""
    extract: str = "text"
    on_set: OnSet = "append"
    match_blanks: bool = False
    delete: bool = False
    default_value: str | None = None


def dom_rules(sources: list[str], rules: list[tuple], parser: str) -> tuple[list[list[str]], list[str]]:
    """For each rule its values, and the documents with deleted elements gone."""
    found: list[list[str]] = [[] for _ in rules]
    rest = []
    for one in sources:
        root = dom.parse(one, parser)
        for i, (selector, extract, match_blanks, delete, default) in enumerate(rules):
            nodes = dom.select(root, selector)
            got = [dom.value_of(n, extract) for n in nodes]
            got = [default if default is not None and not v.strip() else v for v in got] or ([default] if default is not None else [])
            found[i] += [v for v in got if match_blanks or v.strip()]
            if delete:
                for n in nodes:
                    if n.parent and n in n.parent.children:
                        n.parent.children.remove(n)
        rest.append(dom.inner_html(root))
    return found, rest


@register
@dataclass(kw_only=True)
class DOMTagger(Tagger):
    """Values of elements to fields, from the content or from a field; delete takes the elements out of it."""

    rules: list[DOMRule]
    from_field: str | None = None
    parser: str = "html"

    def apply(self, df: DataFrame) -> DataFrame:
        rules, parser = [(r.selector, r.extract, r.match_blanks, r.delete, r.default_value) for r in self.rules], self.parser
        source = values(meta(), self.from_field) if self.from_field else F.array(text())

        @F.pandas_udf("found array<array<string>>, rest array<string>")
        def run(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([dom_rules([x for x in (xs if xs is not None else ()) if x], rules, parser) for xs in s], columns=["found", "rest"])

        df = df.withColumn("_dom", run(F.when(self.guard(), source)))
        m = meta()
        for i, r in enumerate(self.rules):
            m = put(m, r.to_field, F.get(F.col("_dom.found"), F.lit(i)), r.on_set)
        change = {"metadata": m}
        if any(r.delete for r in self.rules):
            if self.from_field:
                change["metadata"] = put(m, self.from_field, F.col("_dom.rest"), "replace")
            else:
                change["content"] = F.coalesce(F.get(F.col("_dom.rest"), F.lit(0)), F.col("content"))
        on = self.guard()
        return df.withColumn("_on", on).withColumns({k: F.when(F.col("_on"), v).otherwise(F.col(k)) for k, v in change.items()}).drop("_dom", "_on")


@register
@dataclass(kw_only=True)
class ForceSingleValueTagger(Tagger):
    """action: keepFirst, keepLast, mergeWith:separator, or empty to join by commas."""

    field_matcher: TextMatcher
    action: str = ""

    def tag(self, m: Column) -> Column:
        if self.action == "keepFirst":
            one = lambda v: F.slice(v, 1, 1)
        elif self.action == "keepLast":
            one = lambda v: F.slice(v, -1, 1)
        else:
            separator = self.action.partition(":")[2] if self.action.startswith("mergeWith") else ","
            one = lambda v: F.array(F.array_join(v, separator))
        return change_fields(m, self.field_matcher, lambda v: F.when(F.size(v) > 1, one(v)).otherwise(v))


@register
@dataclass(kw_only=True)
class HierarchyTagger(Tagger):
    from_field: str
    from_separator: str
    to_field: str | None = None
    to_separator: str | None = None
    keep_empty_segments: bool = False
    regex: bool = False
    on_set: OnSet = "append"

    def uses_python(self) -> bool:
        return self.regex or self.keep_empty_segments

    def tag(self, m: Column) -> Column:
        source = values(m, self.from_field)
        if self.uses_python():
            args = (self.from_separator, self.to_separator, self.keep_empty_segments, self.regex)
            new = many(lambda x: T.hierarchy(x, *args), source)
        else:
            to = self.to_separator or self.from_separator

            def one(v: Column) -> Column:
                segments = F.filter(F.split(v, "\\Q" + self.from_separator + "\\E", -1), lambda s: s != "")
                lead = F.when(F.startswith(v, F.lit(self.from_separator)), to).otherwise("")
                paths = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.concat(lead, F.array_join(F.slice(segments, F.lit(1), n), to)))
                return F.when(F.size(segments) > 0, paths).otherwise(no_values())

            new = F.flatten(F.transform(source, one))
        return put(m, self.to_field, new, self.on_set) if self.to_field else put(m, self.from_field, new, "replace")


@register
@dataclass(kw_only=True)
class KeepOnlyTagger(Tagger):
    field_matcher: TextMatcher

    def tag(self, m: Column) -> Column:
        return keep(m, as_matcher(self.field_matcher))


@register
@dataclass(kw_only=True)
class LanguageTagger(Tagger):
    """The best language of the content, or of its first section_chars if set; with keep_probabilities ranked tags and
    probabilities too."""

    keep_probabilities: bool = False
    fallback_language: str | None = None
    languages: list[str] = field(default_factory=list)
    to_field: str = model.LANGUAGE
    section_chars: int | None = None
    profiles: dict[str, dict[str, int]] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        profiles, languages = self.profiles, self.languages or None

        @F.pandas_udf("array<struct<tag:string,probability:double>>")
        def ranked(s: pd.Series) -> pd.Series:
            of = language.table(profiles or language.default_profiles(), languages) if profiles or languages else language.default_table()
            return s.map(lambda x: None if x is None else [{"tag": a, "probability": b} for a, b in language.rank(x, of=of)])

        section = text() if self.section_chars is None else F.substring(text(), 1, self.section_chars)
        df = df.withColumn("_ranked", ranked(F.when(self.guard(), section)))
        best = F.coalesce(F.get(F.col("_ranked"), F.lit(0))["tag"], F.lit(self.fallback_language))
        m = put(meta(), self.to_field, F.array(best), "replace")
        if self.keep_probabilities:
            size = len(self.languages) or len(self.profiles or language.default_profiles())
            for i in range(size):
                r = F.get(F.col("_ranked"), F.lit(i))
                m = put(m, f"{self.to_field}.{i + 1}.tag", F.array(r["tag"]), "replace")
                m = put(m, f"{self.to_field}.{i + 1}.probability", F.array(r["probability"].cast("string")), "replace")
        return df.withColumn("metadata", F.when(self.guard(), m).otherwise(meta())).drop("_ranked")


@register
@dataclass(kw_only=True)
class MergeTagger(Tagger):
    """Values of matching fields to one field, which they replace."""

    field_matcher: TextMatcher
    to_field: str
    delete_from_fields: bool = False
    single_value: bool = False
    single_value_separator: str = ""

    def tag(self, m: Column) -> Column:
        found = pick(m, as_matcher(self.field_matcher))
        if self.single_value:
            found = F.when(F.size(found) > 0, F.array(F.array_join(found, self.single_value_separator))).otherwise(no_values())
        rest = drop(m, as_matcher(self.field_matcher)) if self.delete_from_fields else m
        return put(rest, self.to_field, found, "replace")


@dataclass(frozen=True)
class RegexRule:
    """Groups: -1 or 0 is the whole match. With field_group the field's name is what that group matched."""

    regex: str
    to_field: str | None = None
    field_group: int = -1
    value_group: int = -1
    on_set: OnSet = "append"
    ignore_case: bool = False
    ignore_diacritic: bool = False


@register
@dataclass(kw_only=True)
class RegexTagger(Tagger):
    patterns: list[RegexRule]
    field_matcher: TextMatcher | None = None

    def tag(self, m: Column) -> Column:
        for r in self.patterns:
            m = let(lambda x, r=r: self.one(x, r), m)
        return m

    def one(self, m: Column, r: RegexRule) -> Column:
        matcher = TextMatcher(r.regex, "regex", ignore_case=r.ignore_case, ignore_diacritic=r.ignore_diacritic)
        pattern = F.lit(matcher.flags() + matcher.body())
        source = source_of(m, self.field_matcher)
        all_of = lambda g: F.flatten(F.transform(source, lambda v: F.regexp_extract_all(matcher.prepared(v), pattern, F.lit(max(0, g)))))
        found = all_of(r.value_group)
        if r.field_group <= 0:
            return put(m, r.to_field, found, r.on_set)
        entries = F.zip_with(all_of(r.field_group), found, lambda k, v: F.struct(k.alias("key"), F.array(v).alias("value")))
        return put_map(m, grouped(F.filter(entries, lambda e: F.length(e["key"]) > 0)), r.on_set)


@register
@dataclass(kw_only=True)
class TextPatternTagger(RegexTagger):
    """RegexTagger on the content only."""

    def __post_init__(self) -> None:
        self.field_matcher = None


@register
@dataclass(kw_only=True)
class RenameTagger(Tagger):
    """Names that match become to_field, in which $n are groups of a regex."""

    field_matcher: TextMatcher
    to_field: str
    on_set: OnSet = "append"

    def tag(self, m: Column) -> Column:
        matcher = as_matcher(self.field_matcher)
        new = lambda k: matcher.replace(k, self.to_field) if matcher.method == "regex" else F.lit(self.to_field)
        moves = lambda k: matcher.test(k) & (new(k) != k)
        moved = F.filter(F.map_entries(m), lambda e: moves(e["key"]))
        arrived = grouped(F.transform(moved, lambda e: F.struct(new(e["key"]).alias("key"), e["value"].alias("value"))))
        return put_map(F.map_filter(m, lambda k, _: ~moves(k)), arrived, self.on_set)


@register
@dataclass(kw_only=True)
class ReplaceTagger(Tagger):
    """Replaces in values. Values without a change are kept, or left out with discard_unchanged."""

    field_matcher: TextMatcher
    value_matcher: TextMatcher
    to_value: str | None = None
    to_field: str | None = None
    discard_unchanged: bool = False
    on_set: OnSet = "append"

    def change(self, v: Column) -> Column:
        matcher = as_matcher(self.value_matcher)
        new = F.transform(v, lambda x: F.struct(x.alias("old"), matcher.replace(x, self.to_value).alias("new")))
        if self.discard_unchanged:
            new = F.filter(new, lambda p: p["old"] != p["new"])
        return F.transform(new, lambda p: p["new"])

    def tag(self, m: Column) -> Column:
        if self.to_field:
            return put(m, self.to_field, self.change(pick(m, as_matcher(self.field_matcher))), self.on_set)
        return change_fields(m, self.field_matcher, self.change)


@register
@dataclass(kw_only=True)
class ScriptTagger(Tagger):
    """script: a Spark SQL expression, or a function giving a column, for a map of fields that is written (replacing)."""

    script: str | Callable[..., Column]

    def uses_python(self) -> bool:
        return callable(self.script)

    def tag(self, m: Column) -> Column:
        from .conditions import script_column

        return put_map(m, script_column(self.script).cast(model.META), "replace")


@register
@dataclass(kw_only=True)
class SplitTagger(Tagger):
    separator: str
    field_matcher: TextMatcher | None = None
    to_field: str | None = None
    separator_regex: bool = False
    on_set: OnSet = "append"

    def change(self, v: Column) -> Column:
        pattern = self.separator if self.separator_regex else "\\Q" + self.separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return F.filter(F.flatten(F.transform(v, lambda x: F.split(x, pattern, -1))), lambda s: F.length(F.trim(s)) > 0 if self.separator_regex else s != "")

    def tag(self, m: Column) -> Column:
        if self.to_field:
            return put(m, self.to_field, self.change(source_of(m, self.field_matcher)), self.on_set)
        return change_fields(m, self.field_matcher, self.change)


@register
@dataclass(kw_only=True)
class TextBetweenTagger(Tagger):
    to_field: str
    start_matcher: TextMatcher
    end_matcher: TextMatcher
    field_matcher: TextMatcher | None = None
    inclusive: bool = False
    on_set: OnSet = "append"

    def uses_python(self) -> bool:
        return True

    def tag(self, m: Column) -> Column:
        start, end, inclusive = as_matcher(self.start_matcher), as_matcher(self.end_matcher), self.inclusive
        new = many(lambda x: T.text_between(x, start.python(), end.python(), inclusive), source_of(m, self.field_matcher))
        return put(m, self.to_field, new, self.on_set)


STATISTICS = ("characterCount", "wordCount", "sentenceCount", "paragraphCount", "averageWordCharacterCount", "averageSentenceCharacterCount", "averageSentenceWordCount", "averageParagraphCharacterCount", "averageParagraphSentenceCount", "averageParagraphWordCount")


@register
@dataclass(kw_only=True)
class TextStatisticsTagger(Tagger):
    """document.stat.*: counts, and averages to one decimal; lines that aren't blank are paragraphs. An average over
    nothing is left out. With a field matcher there are statistics of each field, under its name."""

    field_matcher: TextMatcher | None = None

    @staticmethod
    def statistics(c: Column, name: Callable[[str], Column]) -> Column:
        """Entries of a text's statistics. Text, lines, words and counts are each computed once."""
        total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, n: a + n)
        average = lambda a, b: F.when(b > 0, F.round(a.cast("decimal(20,0)") / b, 1).cast("decimal(18,1)").cast("string"))

        def lines_of(c: Column) -> Column:
            return F.filter(F.transform(F.split(c, "\r\n|\r|\n", -1), lambda x: F.regexp_replace(x, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")), lambda x: x != "")

        def counts(c: Column, lines: Column) -> Column:
            words = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"(?U)\w+\-?\w*"), F.lit(0))))
            sentences = total(F.transform(lines, lambda x: F.size(F.sentences(x, F.lit("en"), F.lit("US")))))
            return let(lambda words, *rest: let(entries, F.size(words).cast("long"), total(F.transform(words, lambda w: F.length(w))), *rest), words, F.length(c).cast("long"), total(F.transform(lines, lambda x: F.length(x))), sentences, F.size(lines).cast("long"))

        def entries(words: Column, word_chars: Column, size: Column, chars: Column, sents: Column, paragraphs: Column) -> Column:
            found = [size.cast("string"), words.cast("string"), sents.cast("string"), paragraphs.cast("string"), average(word_chars, words), average(chars, sents), average(words, sents), average(chars, paragraphs), average(sents, paragraphs), average(words, paragraphs)]
            return F.array(*(F.struct(name(k).alias("key"), F.array(v).alias("value")) for k, v in zip(STATISTICS, found, strict=True)))

        return let(lambda c: let(counts, c, lines_of(c)), c)

    def tag(self, m: Column) -> Column:
        if self.field_matcher is None or not as_matcher(self.field_matcher).configured:
            new = self.statistics(text(), lambda k: F.lit(f"document.stat.{k}"))
        else:

            def of(e: Column) -> Column:
                return self.statistics(F.array_join(e["value"], "\n\n"), lambda k: F.concat(F.lit("document.stat."), e["key"], F.lit(f".{k}")))

            new = F.flatten(F.transform(F.map_entries(keep(m, as_matcher(self.field_matcher))), of))
        return put_map(m, F.map_from_entries(F.filter(new, lambda e: F.get(e["value"], F.lit(0)).isNotNull())))


@register
@dataclass(kw_only=True)
class TitleGeneratorTagger(Tagger):
    from_field: str | None = None
    to_field: str = model.TITLE
    title_max_length: int = 150
    detect_heading: bool = False
    detect_heading_min_length: int = 10
    detect_heading_max_length: int = 150
    on_set: OnSet = "append"
    max_read_size: int = 10_000

    def uses_python(self) -> bool:
        return True

    def tag(self, m: Column) -> Column:
        args = (self.title_max_length, self.detect_heading, self.detect_heading_min_length, self.detect_heading_max_length)
        source = values(m, self.from_field) if self.from_field else F.array(text())
        new = many(lambda x: [t for t in [T.title(x, *args)] if t], F.transform(F.slice(source, 1, 1), lambda x: F.substring(x, 1, self.max_read_size)))
        unset = F.forall(values(m, self.to_field), blank)
        return F.when(unset, put(m, self.to_field, new, "replace")).otherwise(m) if self.on_set == "optional" else put(m, self.to_field, new, self.on_set)


@register
@dataclass(kw_only=True)
class TruncateTagger(Tagger):
    field_matcher: TextMatcher
    max_length: int
    to_field: str | None = None
    suffix: str = ""
    append_hash: bool = False
    on_set: OnSet = "append"

    def cut(self, x: str) -> str:
        return T.truncate(x, self.max_length, self.suffix, self.append_hash)

    def change(self, v: Column) -> Column:
        if self.append_hash:
            return many(lambda x: [self.cut(x)], v)
        cut = self.max_length - len(self.suffix)
        if cut < 0:
            raise ValueError("the suffix is longer than the text may be")
        return F.transform(v, lambda x: F.when(F.length(x) > self.max_length, F.concat(F.substring(x, 1, cut), F.lit(self.suffix))).otherwise(x))

    def uses_python(self) -> bool:
        return self.append_hash

    def tag(self, m: Column) -> Column:
        if self.to_field:
            return put(m, self.to_field, self.change(pick(m, as_matcher(self.field_matcher))), self.on_set)
        return in_place(m, self.field_matcher, self.cut) if self.append_hash else change_fields(m, self.field_matcher, self.change)


@register
@dataclass(kw_only=True)
class URLExtractorTagger(Tagger):
    """Distinct URLs, sorted; https:// is put before those that lack a scheme, full stops and commas at the end go."""

    to_field: str
    field_matcher: TextMatcher | None = None
    on_set: OnSet = "append"

    def tag(self, m: Column) -> Column:
        found = F.flatten(F.transform(source_of(m, self.field_matcher), lambda v: F.regexp_extract_all(v, F.lit(r"(?i)\b(?:https?:|www\.)[^\s<>\"']+"), F.lit(0))))
        clean = F.transform(found, lambda u: F.regexp_replace(u, r"[.,]+\z", ""))
        full = F.transform(clean, lambda u: F.when(F.lower(F.substring(u, 1, 4)) == "http", u).otherwise(F.concat(F.lit("https://"), u)))
        return put(m, self.to_field, F.array_sort(F.array_distinct(full)), self.on_set)


@register
@dataclass(kw_only=True)
class UUIDTagger(Tagger):
    """A random UUID; a different one in every run."""

    to_field: str = model.UUID
    on_set: OnSet = "append"

    def uses_python(self) -> bool:
        return True

    def tag(self, m: Column) -> Column:
        return put(m, self.to_field, F.array(F.uuid()), self.on_set)


def field_report(docs: DataFrame, max_samples: int = 3, truncate_samples_at: int = -1, with_occurrences: bool = True) -> DataFrame:
    """(field, occurrences, samples): of every field the number of documents that have it, and its first distinct
    samples that aren't blank, in order. Samples are kept by a bounded partial aggregate, not by collecting all values."""
    flat = docs.filter(model.active()).select(F.explode(meta()).alias("field", "v"))
    counts = flat.groupBy("field").agg(F.count("*").alias("occurrences"))
    each = flat.select("field", F.explode("v").alias("s")).filter(~blank(F.col("s"))).distinct()
    from pyspark.sql import Window

    top = each.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("s"))).filter(F.col("n") <= max_samples)
    cut = F.substring("s", 1, truncate_samples_at) if truncate_samples_at > 0 else F.col("s")
    samples = top.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", cut.alias("s")))), lambda x: x["s"]).alias("samples"))
    out = counts.join(samples, "field", "left").select("field", "occurrences", F.coalesce("samples", no_values()).alias("samples"))
    return out if with_occurrences else out.drop("occurrences")


@register
@dataclass(kw_only=True)
class FieldReportTagger(Tagger):
    """Marks where a report is made: the flow gives the rows of this point to field_report()."""

    max_samples: int = 3
    truncate_samples_at: int = -1
    with_occurrences: bool = True
    report: DataFrame | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        self.report = field_report(df, self.max_samples, self.truncate_samples_at, self.with_occurrences)
        return df


