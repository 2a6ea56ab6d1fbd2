"""What all handlers share: restrictions, guards against rejected rows, and the registry of handler names."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import pick
from ..functions.matcher import TextMatcher, as_matcher
from ..model import active

#: Handler classes by name, for declarative configuration. Only what is registered can be named there.
REGISTRY: dict[str, type] = {}



def register(cls: type) -> type:
    REGISTRY[cls.__name__] = cls
    return cls


@dataclass(frozen=True)
class PropertyMatcher:
    """A field and the value that one of its values must match."""

    field_matcher: TextMatcher
    value_matcher: TextMatcher = TextMatcher()

    def test(self, m: Column) -> Column:
        return F.exists(pick(m, as_matcher(self.field_matcher)), lambda v: as_matcher(self.value_matcher).test(v))


@dataclass(kw_only=True)
class Handler:
    """restrict_to: the handler works on a row if any of these matches; always, if there are none."""

    restrict_to: list[PropertyMatcher] = field(default_factory=list)
    kind: ClassVar[str] = "handler"

    def applies(self) -> Column:
        hit = None
        for r in self.restrict_to:
            test = r.test(F.col("metadata"))
            hit = test if hit is None else hit | test
        return F.lit(True) if hit is None else hit

    def guard(self) -> Column:
        return active() if not self.restrict_to else active() & self.applies()

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def options(self) -> dict[str, Any]:
        """Fields that differ from their defaults, for configuration files."""
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) != (f.default_factory() if callable(f.default_factory) else f.default)}  # type: ignore[misc]


def text() -> Column:
    """Content as text, empty rather than null."""
    return F.coalesce(F.col("content"), F.lit(""))


def blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A\s*\z"), F.lit(True))
