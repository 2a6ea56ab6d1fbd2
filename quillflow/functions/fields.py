"""Metadata maps: picking, putting, dropping and renaming fields, all as expressions on map<string,array<string>>."""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

from pyspark.sql import Column, functions as F

from .matcher import TextMatcher

OnSet = Literal["append", "prepend", "replace", "optional"]
NONE = "array<string>"


def no_values() -> Column:
    return F.array().cast(NONE)


def values(m: Column, key: str) -> Column:
    """The values of one field; an empty array if it's absent."""
    return F.coalesce(F.element_at(m, F.lit(key)), no_values())


def pick(m: Column, field: TextMatcher) -> Column:
    """The values of all fields whose names match, in the map's order."""
    if field.method == "basic" and not field.ignore_case and not field.ignore_diacritic and not field.partial and field.configured:
        return values(m, field.pattern)
    return F.flatten(F.map_values(F.map_filter(m, lambda k, _: field.test(k))))


def keep(m: Column, field: TextMatcher) -> Column:
    return F.map_filter(m, lambda k, _: field.test(k))


def drop(m: Column, field: TextMatcher) -> Column:
    return F.map_filter(m, lambda k, _: ~field.test(k))


def merged(old: Column, new: Column, on_set: OnSet) -> Column:
    """The values of a field after a write; old is an empty array where the field is absent."""
    if on_set == "append":
        return F.concat(old, new)
    if on_set == "prepend":
        return F.concat(new, old)
    if on_set == "replace":
        return new
    if on_set == "optional":
        return F.when(F.exists(old, lambda v: F.trim(v) != ""), old).otherwise(new)
    raise ValueError(f"unknown onSet: {on_set}")


def let(f: Callable[..., Column], *bound: Column) -> Column:
    """f of some columns, each computed once however often f uses it: a chain of map changes stays linear in size. The
    columns are the start of an aggregate of nothing, which hands them on as they are; a transform copies its results."""
    row = F.struct(*(c.alias(f"v{i}") for i, c in enumerate(bound)))
    return F.aggregate(F.array().cast("array<int>"), row, lambda acc, _: acc, lambda r: f(*(r[f"v{i}"] for i in range(len(bound)))))


def put(m: Column, key: str | Column, new: Column, on_set: OnSet = "append") -> Column:
    """The map after writing values to a field. No values leave it as it was."""
    name = F.lit(key) if isinstance(key, str) else key

    def written(m: Column, name: Column, new: Column) -> Column:
        old = F.coalesce(F.element_at(m, name), no_values())
        rest = F.map_filter(m, lambda k, _: k != name)
        return F.when(F.size(new) > 0, F.map_concat(rest, F.create_map(name, merged(old, new, on_set)))).otherwise(m)

    return let(written, m, name, F.filter(F.coalesce(new, no_values()), lambda v: v.isNotNull()))


def put_map(m: Column, new: Column, on_set: OnSet = "append") -> Column:
    """The map after writing all fields of another."""

    def written(m: Column, new: Column) -> Column:
        both = F.map_zip_with(m, new, lambda _, a, b: F.when(b.isNull(), a).otherwise(merged(F.coalesce(a, no_values()), b, on_set)))
        return F.when(F.size(new) > 0, both).otherwise(m)

    return let(written, m, new)


def grouped(entries: Column) -> Column:
    """A map from entries whose keys may repeat: the values of equal keys, joined in order."""

    def of(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.flatten(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"])).alias("value"))))

    return let(of, entries)


def transform_values(m: Column, field: TextMatcher, change) -> Column:
    """The map with every value of matching fields changed by an expression."""
    return F.transform_values(m, lambda k, v: F.when(field.test(k), F.transform(v, change)).otherwise(v))
