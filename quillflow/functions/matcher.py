"""Text matchers: how operators select fields and values, as Spark predicates and replacements."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, functions as F

Method = Literal["basic", "wildcard", "regex", "csv"]


def _fold_table() -> tuple[str, str]:
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _fold_table()
_TABLE = str.maketrans(_ACCENTED, _PLAIN)


def fold(c: Column) -> Column:
    """Latin letters without their diacritics; positions stay."""
    return F.translate(c, _ACCENTED, _PLAIN)


@dataclass(frozen=True)
class TextMatcher:
    """Whole match by default; partial finds. replace_all replaces every hit, else the first. basic is a literal."""

    pattern: str | None = None
    method: Method = "basic"
    ignore_case: bool = False
    ignore_diacritic: bool = False
    replace_all: bool = False
    partial: bool = False

    def __post_init__(self) -> None:
        if self.method not in ("basic", "wildcard", "regex", "csv"):
            raise ValueError(f"unknown method: {self.method}")

    @property
    def configured(self) -> bool:
        return self.pattern is not None

    def body(self, python: bool = False) -> str:
        """The pattern as a regular expression without flags or anchors."""
        text = self.pattern or ""
        if self.ignore_diacritic:
            text = text.translate(_TABLE)
        quote = lambda s: re.sub(r"([\\.\[\]{}()*+?^$|#&~\-/])", r"\\\1", s)
        if self.method == "regex":
            return text
        if self.method == "wildcard":
            return "".join(".*" if c == "*" else "." if c == "?" else quote(c) for c in text)
        if self.method == "csv":
            return "|".join(quote(x.strip()) for x in text.split(","))
        return quote(text)

    def flags(self) -> str:
        return "(?s)" + ("(?iu)" if self.ignore_case else "")

    def finder(self) -> str:
        """For counting and cutting: finds the pattern anywhere, whatever partial says."""
        return f"{self.flags()}(?:{self.body()})"

    def python(self) -> re.Pattern:
        return re.compile(self.body(), re.DOTALL | (re.IGNORECASE if self.ignore_case else 0))

    def prepared(self, c: Column) -> Column:
        return fold(c) if self.ignore_diacritic else c

    def test(self, c: Column) -> Column:
        """Whether a string matches; null is false. A matcher without a pattern matches everything that isn't null."""
        if self.pattern is None:
            return c.isNotNull()
        x = self.prepared(c)
        if self.method == "basic" and not self.ignore_case:
            text = self.pattern.translate(_TABLE) if self.ignore_diacritic else self.pattern
            hit = x.contains(F.lit(text)) if self.partial else x == F.lit(text)
        elif self.method == "csv" and not self.ignore_case and not self.partial:
            hit = x.isin([v.strip() for v in self.pattern.split(",")])
        else:
            hit = x.rlike(self.finder() if self.partial else f"{self.flags()}\\A(?:{self.body()})\\z")
        return F.coalesce(hit, F.lit(False))

    def replace(self, c: Column, to: str | None) -> Column:
        """Replaces the whole value, or with partial the first hit, or with replace_all every hit. $n are groups if the
        method is regex. Values without a hit stay."""
        new = to or ""
        if self.method != "regex":
            new = new.replace("\\", "\\\\").replace("$", "\\$")
        x = self.prepared(c)
        if self.replace_all:
            return F.regexp_replace(x, self.finder(), new) if not self.ignore_diacritic else F.when(x.rlike(self.finder()), F.regexp_replace(x, self.finder(), new)).otherwise(c)
        shifted = re.sub(r"(?<!\\)\$(\d+)", lambda m: f"$<{int(m[1]) + 1}>", new) if self.method == "regex" else new
        if self.partial:
            shifted = re.sub(r"\$<(\d+)>", r"$\1", shifted)
            pattern = f"{self.flags()}\\A(.*?)(?:{self.body()})"
            return F.when(x.rlike(self.finder()), F.regexp_replace(x, pattern, "$1" + shifted)).otherwise(c)
        anchored = f"{self.flags()}\\A(?:{self.body()})\\z"
        return F.when(x.rlike(anchored), F.regexp_replace(x, anchored, new)).otherwise(c)

    def count(self, c: Column) -> Column:
        return F.regexp_count(self.prepared(c), F.lit(self.finder()))


def basic(pattern: str, **options: bool) -> TextMatcher:
    return TextMatcher(pattern, "basic", **options)


def wildcard(pattern: str, **options: bool) -> TextMatcher:
    return TextMatcher(pattern, "wildcard", **options)


def regex(pattern: str, **options: bool) -> TextMatcher:
    return TextMatcher(pattern, "regex", **options)


def csv(pattern: str, **options: bool) -> TextMatcher:
    return TextMatcher(pattern, "csv", **options)


def as_matcher(x: TextMatcher | str | None) -> TextMatcher:
    return x if isinstance(x, TextMatcher) else TextMatcher(x)
