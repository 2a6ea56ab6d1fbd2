"""Declarative pipelines: plain dictionaries (as from JSON) or XML to Pipeline objects, and dictionaries back.

Only registered handler and condition classes can be named; nothing in a configuration is loaded by path or run as
code, but that a script is a Spark SQL expression.
"""

from __future__ import annotations

import dataclasses
import re
from typing import Any
from xml.etree import ElementTree

from .. import operators
from ..functions.matcher import TextMatcher
from ..operators import conditions, external, filters, splitters, taggers, transformers
from ..operators.base import REGISTRY, Handler, PropertyMatcher
from ..operators.conditions import All, AnyOf, Condition
from ..operators.taggers import DOMRule, RegexRule
from ..operators.transformers import Between
from ..sources.parsers import ParserFactory
from .flow import If, Pipeline, Reject

_VALUES = {c.__name__: c for c in (TextMatcher, PropertyMatcher, DOMRule, RegexRule, Between)}
_ = (operators, conditions, external, filters, splitters, taggers, transformers)


class ConfigError(ValueError):
    """A configuration that names what doesn't exist."""


def dump_value(x: Any) -> Any:
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        out = {"class": type(x).__name__}
        for f in dataclasses.fields(x):
            v = getattr(x, f.name)
            default = f.default_factory() if f.default_factory is not dataclasses.MISSING else f.default
            if v != default:
                out[f.name] = dump_value(v)
        return out
    if isinstance(x, (list, tuple)):
        return [dump_value(v) for v in x]
    if isinstance(x, dict):
        return {k: dump_value(v) for k, v in x.items()}
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    raise ConfigError(f"{type(x).__name__} has no place in a configuration")


def load_value(x: Any) -> Any:
    if isinstance(x, dict):
        body = {k: load_value(v) for k, v in x.items() if k != "class"}
        if "class" not in x:
            return body
        cls = _VALUES.get(x["class"]) or REGISTRY.get(x["class"]) or {"If": If, "Reject": Reject, "All": All, "AnyOf": AnyOf, "ParserFactory": ParserFactory, "Pipeline": Pipeline}.get(x["class"])
        if cls is None:
            raise ConfigError(f"unknown class: {x['class']}")
        known = {f.name for f in dataclasses.fields(cls)}
        if unknown := set(body) - known:
            raise ConfigError(f"{x['class']} has no {', '.join(sorted(unknown))}")
        try:
            return cls(**body)
        except TypeError as e:
            raise ConfigError(f"{x['class']}: {e}") from e
    if isinstance(x, list):
        items = [load_value(v) for v in x]
        return items
    return x


def dump_pipeline(p: Pipeline) -> dict[str, Any]:
    return dump_value(p)


def load_pipeline(config: dict[str, Any]) -> Pipeline:
    found = load_value({"class": "Pipeline", **config})
    if not isinstance(found, Pipeline):
        raise ConfigError("not a pipeline")
    return found


# XML


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def _bool(v: str | None) -> bool:
    return (v or "").strip().lower() == "true"


def _text(e: ElementTree.Element | None) -> str | None:
    return None if e is None or e.text is None else e.text.strip()


def matcher(e: ElementTree.Element | None) -> TextMatcher | None:
    if e is None:
        return None
    return TextMatcher(_text(e) or "", (e.get("method") or "basic").lower(), _bool(e.get("ignoreCase")), _bool(e.get("ignoreDiacritic")), _bool(e.get("replaceAll")), _bool(e.get("partial")))


#: Attribute and element names that a field of ours has under another name.
_NAMES = {"type": "case_type", "class": None, "format": "format", "field": "field", "max_samples": "max_samples", "with_occurences": "with_occurrences", "language": "languages"}


def _typed(cls: type, name: str, value: str) -> Any:
    kind = str(next((f.type for f in dataclasses.fields(cls) if f.name == name), "str"))
    if kind.startswith("bool"):
        return _bool(value)
    if kind.startswith("int"):
        return int(value)
    if kind.startswith("float"):
        return float(value)
    if kind.startswith("list"):
        return [v.strip() for v in value.split(",") if v.strip()]
    return value


def _rules(e: ElementTree.Element, cls: type, child: str) -> list:
    out = []
    for r in e.findall(child):
        values: dict[str, Any] = {}
        for k, v in [*r.attrib.items(), *((c.tag, _text(c) or "") for c in r if not c.tag.endswith("Matcher"))]:
            name = _snake(k)
            if name in {f.name for f in dataclasses.fields(cls)}:
                values[name] = _typed(cls, name, v)
        if cls is Between:
            values |= {"start": matcher(r.find("startMatcher")), "end": matcher(r.find("endMatcher"))}
        if cls is RegexRule and "regex" not in values:
            values["regex"] = _text(r) or ""
        out.append(cls(**values))
    return out


def handler(e: ElementTree.Element) -> Any:
    """A handler, or a list of them where the element holds several rules that a handler of ours takes one at a time."""
    name = (e.get("class") or "").rsplit(".", 1)[-1]
    cls = REGISTRY.get(name)
    if cls is None:
        raise ConfigError(f"unknown class: {name}")
    fields = {f.name for f in dataclasses.fields(cls)}
    values: dict[str, Any] = {}
    for k, v in e.attrib.items():
        k = _NAMES.get(_snake(k), _snake(k))
        if k in fields:
            values[k] = _typed(cls, k, v)
    for c in e:
        k = _snake(c.tag)
        if k in ("field_matcher", "value_matcher", "count_matcher", "start_matcher", "end_matcher", "strip_after_matcher", "strip_before_matcher", "content_type_matcher") and k in fields:
            values[k] = matcher(c)
        elif k == "to_value" and k in fields or k == "to_field" and k in fields:
            values[k] = _text(c) or ""
        elif k in fields and not len(c) and k not in ("conditions", "reduce", "rules", "patterns"):
            values[k] = _typed(cls, k, _text(c) or "")
    if restrict := [PropertyMatcher(matcher(r.find("fieldMatcher")), matcher(r.find("valueMatcher"))) for r in e.findall("restrictTo")]:
        values["restrict_to"] = restrict
    if "constants" in fields:
        values["constants"] = [(c.get("name"), _text(c) or "") for c in e.findall("constant")]
    if "rules" in fields:
        values["rules"] = _rules(e, DOMRule, "dom")
    if "patterns" in fields:
        values["patterns"] = [r for child in ("pattern", "metadata/pattern") for r in _rules(e, RegexRule, child)]
    if "strip_between" in fields:
        values["strip_between"] = _rules(e, Between, "stripBetween")
    if "reduce" in fields:
        values["reduce"] = [c.text or "" for c in e.findall("reduce")]
    if "selectors" in fields:
        values["selectors"] = [c.get("selector") for c in e.findall("dom")]
    if "replacements" in fields:
        values["replacements"] = [(matcher(c.find("valueMatcher")), _text(c.find("toValue")) or "") for c in e.findall("replace")]
    if "copies" in fields:
        values["copies"] = [(matcher(c.find("fieldMatcher")), c.get("toField")) for c in e.findall("copy")]
    if "conditions" in fields:
        values["conditions"] = [(c.get("operator"), float(c.get("number")) if c.get("number") else c.get("date")) for c in e.findall("condition")]
    if "value_matchers" in fields:
        values["value_matchers"] = [(c.get("operator") or "eq", float(c.get("number")) if c.get("number") else c.get("date")) for c in e.findall("valueMatcher")]
        values.pop("value_matcher", None)
    if "script" in fields and "script" not in values:
        values["script"] = _text(e) or ""
    many = {"RenameTagger": "rename", "ReplaceTagger": "replace", "MergeTagger": "merge", "SplitTagger": "split", "HierarchyTagger": "hierarchy", "TextBetweenTagger": "textBetween"}.get(name)
    if many and e.findall(many):
        out = []
        for r in e.findall(many):
            part = ElementTree.Element("handler", {"class": name, **{k: v for k, v in e.attrib.items() if k != "class"}, **r.attrib})
            part.extend([*r, *e.findall("restrictTo")])
            out.append(handler(part))
        return out
    try:
        return cls(**values)
    except TypeError as x:
        raise ConfigError(f"{name}: {x}") from x


def condition(e: ElementTree.Element) -> Condition:
    if e.tag == "conditions":
        return (AnyOf if (e.get("operator") or "AND").upper() == "OR" else All)([condition(c) for c in e])
    part = ElementTree.Element("condition", {"class": "TextCondition", **e.attrib})
    part.text = e.text
    part.extend(list(e))
    found = handler(part)
    if not isinstance(found, Condition):
        raise ConfigError(f"{part.get('class')} is no condition")
    return found


def steps(e: ElementTree.Element | None) -> list:
    out: list = []
    for c in e if e is not None else ():
        if c.tag in ("handler", "filter", "tagger", "transformer", "splitter"):
            found = handler(c)
            out += found if isinstance(found, list) else [found]
        elif c.tag == "reject":
            out.append(Reject())
        elif c.tag in ("if", "ifNot"):
            test = next((condition(x) for x in c if x.tag in ("condition", "conditions")), None)
            if test is None:
                raise ConfigError(f"<{c.tag}> without a condition")
            out.append(If(test, steps(c.find("then")), steps(c.find("else")), negate=c.tag == "ifNot"))
        else:
            raise ConfigError(f"unknown element: {c.tag}")
    return out


def load_xml(source: str) -> Pipeline:
    """A pipeline of <preParseHandlers>, <documentParserFactory> and <postParseHandlers>."""
    root = ElementTree.fromstring(source)
    factory = root.find("documentParserFactory")
    parsers = ParserFactory()
    if factory is not None:
        embedded = factory.find("embedded")
        get = lambda parent, name: None if parent is None else _text(parent.find(name))
        parsers = ParserFactory(get(factory, "ignoredContentTypes"), get(embedded, "splitContentTypes"), get(embedded, "noExtractContainerContentTypes"), get(embedded, "noExtractEmbeddedContentTypes"))
    return Pipeline(steps(root.find("preParseHandlers")), steps(root.find("postParseHandlers")), parsers)


__all__ = ["ConfigError", "Handler", "dump_pipeline", "load_pipeline", "load_xml"]
