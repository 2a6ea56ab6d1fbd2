"""Filters: rows they don't accept are marked as rejected, never dropped, so that each keeps its status.

An exclude filter rejects at once. Include filters never reject by themselves; at the end of a phase a row is rejected
if it reached an include filter and none accepted it. A filter that a restriction keeps from a row accepts it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar, Literal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import common
from ..functions.matcher import TextMatcher, as_matcher
from ..model import active, rejected
from . import conditions as C
from .base import Handler, register


@dataclass(kw_only=True)
class Filter(Handler):
    on_match: Literal["include", "exclude"] = "include"
    kind: ClassVar[str] = "filter"

    def __post_init__(self) -> None:
        if self.on_match not in ("include", "exclude"):
            raise ValueError(f"unknown onMatch: {self.on_match}")

    def matches(self) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        if self.on_match == "exclude":
            return df.withColumn("rejected_by", rejected(self.applies() & self.matches(), type(self).__name__))
        accepted = active() & (~self.applies() | self.matches())
        return df.withColumns({"include_hit": F.col("include_hit") | accepted, "has_include": F.col("has_include") | active()})


@register
@dataclass(kw_only=True)
class TextFilter(Filter):
    value_matcher: TextMatcher
    field_matcher: TextMatcher | None = None

    def matches(self) -> Column:
        return C.text_test(self.field_matcher, self.value_matcher)


@register
@dataclass(kw_only=True)
class ReferenceFilter(Filter):
    value_matcher: TextMatcher

    def matches(self) -> Column:
        return as_matcher(self.value_matcher).test(F.col("reference"))


@register
@dataclass(kw_only=True)
class EmptyFilter(Filter):
    """Without a field: empty content. With: no matching field, or one whose values are all blank."""

    field_matcher: TextMatcher | None = None

    def matches(self) -> Column:
        if self.field_matcher is None or not as_matcher(self.field_matcher).configured:
            return C.BlankCondition().test()
        return C.fields_blank(self.field_matcher)


@register
@dataclass(kw_only=True)
class NumericMetadataFilter(Filter):
    field_matcher: TextMatcher
    conditions: list[tuple[str, float]] = field(default_factory=list)

    def matches(self) -> Column:
        return C.numeric_test(self.field_matcher, self.conditions)


@register
@dataclass(kw_only=True)
class DateMetadataFilter(Filter):
    field_matcher: TextMatcher
    conditions: list[tuple[str, str]] = field(default_factory=list)
    format: str = "EPOCH"
    doc_zone_id: str = "UTC"
    condition_zone_id: str = "UTC"

    def matches(self) -> Column:
        return C.date_test(self.field_matcher, self.conditions, self.format, self.doc_zone_id, self.condition_zone_id, False)


@register
@dataclass(kw_only=True)
class DOMFilter(Filter):
    selector: str
    parser: str = "html"
    extract: str = "text"
    field_matcher: TextMatcher | None = None
    value_matcher: TextMatcher | None = None

    def applies(self) -> Column:
        if self.restrict_to:
            return super().applies()
        return F.lower(F.coalesce("content_type", F.lit(""))).isin(list(common.DOM))

    def matches(self) -> Column:
        return C.dom_test(self.selector, self.parser, self.extract, self.field_matcher, self.value_matcher, None)


@register
@dataclass(kw_only=True)
class ScriptFilter(Filter):
    script: str | Callable[..., Column]

    def matches(self) -> Column:
        return C.script_test(self.script)


@register
@dataclass(kw_only=True)
class RejectFilter(Filter):
    """Rejects every row it reaches."""

    on_match: Literal["include", "exclude"] = "exclude"

    def matches(self) -> Column:
        return F.lit(True)


@register
@dataclass(kw_only=True)
class RegexContentFilter(Filter):
    regex: str = ""
    case_sensitive: bool = False

    def source(self) -> Column:
        return F.coalesce("content", F.lit(""))

    def matches(self) -> Column:
        return F.lit(True) if not self.regex.strip() else C.regex_flags(self.regex, self.case_sensitive).test(self.source())


@register
@dataclass(kw_only=True)
class RegexReferenceFilter(RegexContentFilter):
    def source(self) -> Column:
        return F.col("reference")


@register
@dataclass(kw_only=True)
class RegexMetadataFilter(Filter):
    field: str
    regex: str = ""
    case_sensitive: bool = False

    def matches(self) -> Column:
        return F.lit(True) if not self.regex.strip() else C.text_test(TextMatcher(self.field), C.regex_flags(self.regex, self.case_sensitive))


@register
@dataclass(kw_only=True)
class EmptyMetadataFilter(Filter):
    fields: list[str] = field(default_factory=list)

    def matches(self) -> Column:
        hit = F.lit(not self.fields)
        for name in self.fields:
            hit = hit | C.fields_blank(TextMatcher(name))
        return hit


@register
@dataclass(kw_only=True)
class DOMContentFilter(Filter):
    selector: str
    regex: str = ""
    case_sensitive: bool = False
    extract: str = "text"
    parser: str = "html"

    def matches(self) -> Column:
        matcher = C.regex_flags(self.regex, self.case_sensitive) if self.regex.strip() else None
        return C.dom_test(self.selector, self.parser, self.extract, None, matcher, None)


def end_of_phase(df: DataFrame) -> DataFrame:
    """Rejects what reached include filters and was accepted by none, and begins the tally anew."""
    lost = F.col("has_include") & ~F.col("include_hit")
    return df.withColumn("rejected_by", rejected(lost, "no include filter accepted")).withColumns({"has_include": F.lit(False), "include_hit": F.lit(False)})
