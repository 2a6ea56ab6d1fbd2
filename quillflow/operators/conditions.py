"""Predicates of if/ifNot, and the tests that filters share with them. A condition is false on a rejected row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions import common, dates, dom
from ..functions.fields import keep, pick
from ..functions.matcher import TextMatcher, as_matcher
from .base import blank, register, text

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
}


class Condition:
    def test(self) -> Column:
        """A boolean column; false is "doesn't match"."""
        raise NotImplementedError


def text_test(field_matcher: TextMatcher | None, value_matcher: TextMatcher) -> Column:
    value_matcher = as_matcher(value_matcher)
    if field_matcher is None or not as_matcher(field_matcher).configured:
        return value_matcher.test(text())
    return F.exists(pick(F.col("metadata"), as_matcher(field_matcher)), value_matcher.test)


def numeric_value(v: Column) -> Column:
    """A decimal number as double; hexadecimal and suffixed forms don't count as numbers."""
    v = F.trim(v)
    return F.when(v.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), v.try_cast("double"))


def compare(name: str, a: Column, b: Column) -> Column:
    if name.lower() not in OPERATORS:
        raise ValueError(f"unknown operator: {name}")
    return F.coalesce(OPERATORS[name.lower()](a, b), F.lit(False))


def numeric_test(field_matcher: TextMatcher, conditions: list[tuple[str, float]]) -> Column:
    if not as_matcher(field_matcher).configured:
        raise ValueError("a numeric test needs a field matcher")

    def one(v: Column) -> Column:
        n = numeric_value(v)
        return reduce(lambda x, y: x & y, (compare(op, n, F.lit(float(number))) for op, number in conditions), n.isNotNull())

    return F.exists(pick(F.col("metadata"), as_matcher(field_matcher)), one)


def date_test(field_matcher: TextMatcher, conditions: list[tuple[str, str]], format: str, doc_zone: str, zone: str, truncate_today: bool, now=None) -> Column:
    if not as_matcher(field_matcher).configured:
        raise ValueError("a date test needs a field matcher")
    points = [(op, *dates.point(text_, zone, now)) for op, text_ in conditions]

    def one(v: Column) -> Column:
        t = dates.parse(v, format, doc_zone)
        hit = t.isNotNull()
        for op, at, is_day in points:
            hit = hit & compare(op, dates.day(t, zone) if is_day and truncate_today else t, at)
        return hit

    return F.exists(pick(F.col("metadata"), as_matcher(field_matcher)), one)


def dom_values(source: Column, selector: str, parser: str, extract: str) -> Column:
    """Extracted values of the elements that a selector hits in each of an array of documents."""

    @F.pandas_udf("array<string>")
    def found(docs: pd.Series) -> pd.Series:
        return docs.map(lambda many: [v for one in (many if many is not None else ()) if one for v in dom.extract_all(one, selector, parser, extract)])

    return found(source)


def dom_test(selector: str, parser: str, extract: str, field_matcher: TextMatcher | None, value_matcher: TextMatcher | None, content_type: TextMatcher | None) -> Column:
    use_field = field_matcher is not None and as_matcher(field_matcher).configured
    source = pick(F.col("metadata"), as_matcher(field_matcher)) if use_field else F.array(text())
    found = dom_values(source, selector, parser, extract)
    hit = F.size(found) > 0 if value_matcher is None else F.exists(found, as_matcher(value_matcher).test)
    if content_type is not None:
        hit = hit & as_matcher(content_type).test(F.col("content_type"))
    return F.coalesce(hit, F.lit(False))


def script_column(script: str | Callable[..., Column]) -> Column:
    """A script is a Spark SQL expression over reference, content, metadata and content_type, or a function giving one."""
    return F.expr(script) if isinstance(script, str) else script()


def script_test(script: str | Callable[..., Column]) -> Column:
    value = script_column(script)
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False))


@register
@dataclass
class TextCondition(Condition):
    value_matcher: TextMatcher
    field_matcher: TextMatcher | None = None

    def test(self) -> Column:
        return text_test(self.field_matcher, self.value_matcher)


@register
@dataclass
class ReferenceCondition(Condition):
    value_matcher: TextMatcher

    def test(self) -> Column:
        return as_matcher(self.value_matcher).test(F.col("reference"))


@register
@dataclass
class BlankCondition(Condition):
    """Without a field: whether the content is empty. With: whether all values of all matching fields are blank, or any
    with match_any_blank; no matching field counts as blank."""

    field_matcher: TextMatcher | None = None
    match_any_blank: bool = False

    def test(self) -> Column:
        if self.field_matcher is None or not as_matcher(self.field_matcher).configured:
            return (F.length(text()) == 0) & (F.coalesce(F.length("raw"), F.lit(0)) == 0)
        found = pick(F.col("metadata"), as_matcher(self.field_matcher))
        quantifier = F.exists if self.match_any_blank else F.forall
        return (F.size(found) == 0) | quantifier(found, blank)


@register
@dataclass
class NumericCondition(Condition):
    field_matcher: TextMatcher
    value_matchers: list[tuple[str, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if len(self.value_matchers) > 2:
            raise ValueError("two numbers at most")

    def test(self) -> Column:
        return numeric_test(self.field_matcher, self.value_matchers)


@register
@dataclass
class DateCondition(Condition):
    field_matcher: TextMatcher
    value_matchers: list[tuple[str, str]] = field(default_factory=list)
    format: str = "EPOCH"
    doc_zone_id: str = "UTC"
    condition_zone_id: str = "UTC"

    def __post_init__(self) -> None:
        if len(self.value_matchers) > 2:
            raise ValueError("two dates at most")

    def test(self) -> Column:
        return date_test(self.field_matcher, self.value_matchers, self.format, self.doc_zone_id, self.condition_zone_id, True)


@register
@dataclass
class DOMCondition(Condition):
    selector: str
    parser: str = "html"
    extract: str = "text"
    field_matcher: TextMatcher | None = None
    value_matcher: TextMatcher | None = None
    content_type_matcher: TextMatcher | None = field(default_factory=lambda: common.types(common.DOM))

    def test(self) -> Column:
        return dom_test(self.selector, self.parser, self.extract, self.field_matcher, self.value_matcher, self.content_type_matcher)


@register
@dataclass
class ScriptCondition(Condition):
    script: str | Callable[..., Column]

    def test(self) -> Column:
        return script_test(self.script)


@dataclass
class All(Condition):
    conditions: list[Condition]

    def test(self) -> Column:
        return reduce(lambda a, b: a & b, (c.test() for c in self.conditions), F.lit(True))


@dataclass
class AnyOf(Condition):
    conditions: list[Condition]

    def test(self) -> Column:
        return reduce(lambda a, b: a | b, (c.test() for c in self.conditions), F.lit(False))


def fields_blank(field_matcher: TextMatcher) -> Column:
    """Whether no field matches, or one matching field has only blank values."""
    found = keep(F.col("metadata"), as_matcher(field_matcher))
    return (F.size(F.map_keys(found)) == 0) | F.exists(F.map_values(found), lambda v: F.forall(v, blank))


def regex_flags(pattern: str, case_sensitive: bool) -> TextMatcher:
    return TextMatcher(pattern, "regex", ignore_case=not case_sensitive)
