"""Transformers: projections of the content. An empty result is an empty content."""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dom
from ..functions.fields import put
from ..functions.matcher import TextMatcher, as_matcher
from .base import Handler, register, text
from .taggers import DOMRule, dom_rules


@dataclass(kw_only=True)
class Transformer(Handler):
    kind: ClassVar[str] = "transformer"

    def change(self, c: Column) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        # a Python function runs before the branch is chosen, so rows that aren't active go to it as null
        on = self.guard()
        return df.withColumn("content", F.when(on, self.change(F.when(on, text()))).otherwise(F.col("content")))


def rewritten(function: Callable[[str], str], c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(function, na_action="ignore")

    return run(c)


@register
@dataclass(kw_only=True)
class CharsetTransformer(Transformer):
    """Reads the raw bytes, or content decoded as ISO-8859-1, in the source character set, detected if unset. Content
    is held as text, so the target matters only to sinks, which encode."""

    source_charset: str | None = None
    target_charset: str = "UTF-8"

    def apply(self, df: DataFrame) -> DataFrame:
        from ..sources.detect import decoded

        source = F.lit(self.source_charset).cast("string")
        raw = F.coalesce("raw", F.encode("content", "ISO-8859-1"))
        new = decoded(raw, source)
        change = F.when(self.guard() & (F.col("raw").isNotNull() | (source.isNotNull() & (F.lower(source) != self.target_charset.lower()))), new).otherwise(F.col("content"))
        return df.withColumn("content", change)


@register
@dataclass(kw_only=True)
class DOMDeleteTransformer(Transformer):
    selectors: list[str]
    parser: str = "html"

    def change(self, c: Column) -> Column:
        selectors, parser = self.selectors, self.parser
        return rewritten(lambda x: dom.delete(x, selectors, parser), c)


@register
@dataclass(kw_only=True)
class DOMPreserveTransformer(Transformer):
    """Only the extracted values stay, a line each."""

    rules: list[DOMRule]
    parser: str = "html"

    def change(self, c: Column) -> Column:
        rules, parser = [(r.selector, r.extract, r.match_blanks, False, r.default_value) for r in self.rules], self.parser
        return rewritten(lambda x: "\n".join(v for found in dom_rules([x], rules, parser)[0] for v in found), c)


@register
@dataclass(kw_only=True)
class NoContentTransformer(Transformer):
    """Empties the content; with to_field its text is added to that field."""

    to_field: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        on = self.guard()
        if self.to_field:
            df = df.withColumn("metadata", F.when(on, put(F.col("metadata"), self.to_field, F.array(text()))).otherwise(F.col("metadata")))
        return df.withColumns({"content": F.when(on, F.lit("")).otherwise(F.col("content")), "raw": F.when(~on, F.col("raw"))})


_ESCAPES = {"\\s": " ", "\\t": "\t", "\\n": "\n", "\\r": "\r"}


@register
@dataclass(kw_only=True)
class ReduceConsecutivesTransformer(Transformer):
    """A run of a string becomes one, the last of it. \\s \\t \\n \\r stand for white space."""

    reduce: list[str]
    ignore_case: bool = False

    def change(self, c: Column) -> Column:
        for one in self.reduce:
            for code, char in _ESCAPES.items():
                one = one.replace(code, char)
            body = TextMatcher(one).body()
            c = F.regexp_replace(c, ("(?iu)" if self.ignore_case else "") + f"(?:{body})+({body})", "$1")
        return c


@register
@dataclass(kw_only=True)
class ReplaceTransformer(Transformer):
    replacements: list[tuple[TextMatcher, str]]

    def change(self, c: Column) -> Column:
        for matcher, to in self.replacements:
            c = as_matcher(matcher).replace(c, to)
        return c


@register
@dataclass(kw_only=True)
class ScriptTransformer(Transformer):
    script: str | Callable[..., Column]

    def change(self, c: Column) -> Column:
        from .conditions import script_column

        return script_column(self.script).cast("string")


@register
@dataclass(kw_only=True)
class StripAfterTransformer(Transformer):
    """Cuts what follows the first match, and with inclusive the match itself."""

    strip_after_matcher: TextMatcher
    inclusive: bool = False

    def change(self, c: Column) -> Column:
        pattern = as_matcher(self.strip_after_matcher).finder()
        return F.regexp_replace(c, f"(?s)({pattern}).*\\z", "" if self.inclusive else "$1")


@register
@dataclass(kw_only=True)
class StripBeforeTransformer(Transformer):
    strip_before_matcher: TextMatcher
    inclusive: bool = False

    def change(self, c: Column) -> Column:
        pattern = as_matcher(self.strip_before_matcher).finder()
        return F.regexp_replace(c, f"(?s)\\A.*?({pattern})", "" if self.inclusive else "$1")


@dataclass(frozen=True)
class Between:
    start: TextMatcher
    end: TextMatcher
    inclusive: bool = False


@register
@dataclass(kw_only=True)
class StripBetweenTransformer(Transformer):
    """Cuts from each start to the first end after it, in one pass from the left."""

    strip_between: list[Between]

    def change(self, c: Column) -> Column:
        for b in self.strip_between:
            start, end = as_matcher(b.start).finder(), as_matcher(b.end).finder()
            c = F.regexp_replace(c, f"(?s)({start}).*?({end})", "" if b.inclusive else "$1$2")
        return c


@register
@dataclass(kw_only=True)
class SubstringTransformer(Transformer):
    """Characters from begin up to end, excluded; -1 is open."""

    begin: int = 0
    end: int = -1

    def __post_init__(self) -> None:
        if -1 < self.end < self.begin:
            raise ValueError("end is before begin")

    def change(self, c: Column) -> Column:
        begin = max(0, self.begin)
        return F.substring(c, begin + 1, 2**31 - 1 if self.end < 0 else self.end - begin)


@register
@dataclass(kw_only=True)
class ImageTransformer(Transformer):
    """Scales, rotates and crops images in raw, by an imaging library where one is installed; else rows get an error."""

    target_format: str = "png"
    scale_factor: float | None = None
    scale_size: tuple[int, int] | None = None
    stretch: bool = False
    rotate_degrees: float = 0
    crop: tuple[int, int, int, int] | None = None
    options_: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        me = self

        @F.pandas_udf("raw binary, error string")
        def run(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([me._one(x) for x in s], columns=["raw", "error"])

        on = self.guard() & F.col("raw").isNotNull()
        df = df.withColumn("_image", run(F.when(on, F.col("raw"))))
        error = F.when(on, F.col("_image.error")).otherwise(F.col("error"))
        return df.withColumns({"raw": F.when(on & F.col("_image.raw").isNotNull(), F.col("_image.raw")).otherwise(F.col("raw")), "error": error}).drop("_image")

    def _one(self, raw: bytes | None) -> tuple[bytes | None, str | None]:
        if raw is None:
            return None, None
        try:
            from PIL import Image
        except ImportError:
            return None, "no imaging library is installed"
        try:
            return self._changed(Image.open(io.BytesIO(raw))), None
        except Exception as e:  # an image that can't be read is an error of its row
            return None, f"{type(e).__name__}: {e}"[:500]

    def _changed(self, image) -> bytes:
        if self.scale_size:
            image = image.resize(self.scale_size) if self.stretch else image.copy()
            if not self.stretch:
                image.thumbnail(self.scale_size)
        elif self.scale_factor:
            image = image.resize((round(image.width * self.scale_factor), round(image.height * self.scale_factor)))
        if self.rotate_degrees:
            image = image.rotate(-self.rotate_degrees, expand=True)
        if self.crop:
            x, y, w, h = self.crop
            image = image.crop((x, y, x + w, y + h))
        out = io.BytesIO()
        image.save(out, self.target_format)
        return out.getvalue()
